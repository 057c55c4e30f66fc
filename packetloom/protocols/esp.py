"""ESP sequence numbers per flow, SPI and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled, first_filled, marked, row_int
from packetloom.operators.keys import direction_label
from packetloom.operators.ordered import sequence_points
from packetloom.schemas import field

# Exported header fields of the tool.
FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "frame.len", "ip.src", "ipv6.src",
    "ip.dst", "ipv6.dst", "ip.len", "ipv6.plen", "ip.ttl", "ipv6.hlim", "ip.dsfield.dscp",
    "ipv6.tclass.dscp", "ip.flags.df", "ip.frag_offset", "ip.id", "udp.srcport", "udp.dstport",
    "udp.length", "esp.spi", "esp.sequence",
]
STREAM = ["flow_key", "esp_spi", "direction", "is_forward", "is_reverse"]


def _labelled(pk: DataFrame) -> DataFrame:
    c = F.col
    ahead = direction_label(c("endpoint_a"), c("port_a"), c("endpoint_b"), c("port_b"))
    back = direction_label(c("endpoint_b"), c("port_b"), c("endpoint_a"), c("port_a"))
    own = direction_label(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"))
    return pk.where(filled(c("esp_spi")) & c("esp_sequence").isNotNull()).select(
        "flow_key", "esp_spi", own.alias("direction"), (own == ahead).alias("is_forward"),
        (own == back).alias("is_reverse"), "esp_sequence", "frame_number")


def _summary(points: DataFrame, keys: list[str], seq: str) -> DataFrame:
    number, high = F.col(seq), F.col("highest_before")
    gap = F.when(number > high + 1, number - high - 1)
    return points.groupBy(*keys).agg(
        F.sum("copies").alias("packets"),
        F.count(F.lit(1)).alias("distinct_sequences"),
        F.min_by(seq, "first_at").alias("first_sequence"),
        F.max_by(seq, "last_at").alias("last_sequence"),
        F.max(seq).alias("highest_sequence"),
        (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"),
        F.count_if(number < high).alias("out_of_order"),
        F.count(gap).alias("gaps"),
        F.coalesce(F.max(gap), F.lit(0)).alias("largest_gap"),
    ).withColumn("missing", F.greatest(
        F.col("highest_sequence") - F.col("first_sequence") + 1 - F.col("distinct_sequences"),
        F.lit(0)))


def esp_sequences(pk: DataFrame) -> DataFrame:
    """One row per flow, SPI and direction text."""
    return _summary(sequence_points(_labelled(pk), STREAM, "esp_sequence"), STREAM, "esp_sequence")


def esp_gaps(pk: DataFrame) -> DataFrame:
    """Each gap of a stream in capture order: the numbers around it and how many are missing."""
    points = sequence_points(_labelled(pk), STREAM, "esp_sequence")
    missing = F.col("esp_sequence") - F.col("highest_before") - 1
    return points.where(missing > 0).select(
        "flow_key", "esp_spi", "direction", F.col("first_at").alias("frame_number"),
        F.col("highest_before").alias("after_sequence"),
        F.col("esp_sequence").alias("next_sequence"), missing.alias("missing"))


def esp_gap_distribution(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("flow_key", "esp_spi", "direction", "missing").agg(
        F.count(F.lit(1)).alias("n"))


def _over_udp_4500() -> Column:
    return F.coalesce(field("udp.srcport") == "4500", F.lit(False)) | F.coalesce(
        field("udp.dstport") == "4500", F.lit(False))


def _row_counters() -> list[Column]:
    return [
        F.count_if(_over_udp_4500()).alias("nat_t_packets"),
        F.count_if(marked(field("ip.flags.df"))).alias("df_set_packets"),
        F.count_if(row_int(field("ip.frag_offset")) > 0).alias("fragmented_packets"),
        F.array_join(F.array_sort(F.collect_set(_dscp())), ",").alias("dscp_values"),
    ]


def _dscp() -> Column:
    return first_filled(field("ip.dsfield.dscp"), field("ipv6.tclass.dscp"))


def esp_counts(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """Tunnel counters over header rows; a DSCP has at most 64 values."""
    length = row_int(first_filled(field("ip.len"), field("ipv6.plen")))
    stated = filled(field("ip.flags.df"))
    on = marked(field("ip.flags.df"))
    return fr.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("esp_packets"),
        *_row_counters(),
        F.min(F.when(length != 0, length)).alias("ip_length_min"),
        F.max(F.when(length != 0, length)).alias("ip_length_max"),
        F.count_if(stated & on).alias("_on"), F.count_if(stated & ~on).alias("_off"),
    ).withColumn("df_bit", F.when((F.col("_on") > 0) & (F.col("_off") > 0), "mixed")
                 .when(F.col("_on") > 0, "on").when(F.col("_off") > 0, "off")).drop("_on", "_off")


def esp_direction_stats(fr: DataFrame, order: str = "frame_number") -> DataFrame:
    """Bytes, sequence results, hop limits and markers per source and destination of a flow."""
    keys = ["flow_key", "direction"]
    rows = fr.withColumn("direction", F.concat(
        F.coalesce(F.col("src"), F.lit("unknown")), F.lit(" -> "),
        F.coalesce(F.col("dst"), F.lit("unknown"))))
    ttl = row_int(first_filled(field("ip.ttl"), field("ipv6.hlim")))
    size = row_int(first_filled(field("frame.len"), field("ip.len"), field("ipv6.plen")))
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.min(F.when(ttl != 0, ttl)).alias("ttl_min"),
        F.max(F.when(ttl != 0, ttl)).alias("ttl_max"), *_row_counters())
    numbered = rows.select(*keys, order, row_int(field("esp.sequence")).alias("sequence")).where(
        "sequence IS NOT NULL")
    points = sequence_points(numbered, keys, "sequence", order)
    return totals.join(_summary(points, keys, "sequence").drop("packets"), keys, "left")


def esp_direction_gaps(fr: DataFrame, order: str = "frame_number") -> DataFrame:
    """How often each gap size occurs per source and destination."""
    keys = ["flow_key", "direction"]
    rows = fr.select("flow_key", F.concat("src", F.lit(" -> "), "dst").alias("direction"), order,
                     row_int(field("esp.sequence")).alias("sequence")).where("sequence IS NOT NULL")
    gap = F.col("sequence") - F.col("highest_before") - 1
    return sequence_points(rows, keys, "sequence", order).where(gap > 0).groupBy(
        *keys, gap.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


