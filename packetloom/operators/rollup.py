"""Packets to flows: counters, rates inputs, frequency tables and ordered name lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.names import dns_success, smb_failed
from packetloom.functions.parse import filled
from packetloom.functions.protocols import field_names, known_mask, layer_names, mask_of, names_of, other_names
from packetloom.operators.keys import FLOW_COLUMNS
from packetloom.operators.ordered import ordered_distinct, place_in_packet, scan
from packetloom.operators.ranking import bucket, by_frequency, nearest_rank, rank_descending
from packetloom.settings import settle

CORE_COLUMNS = [*FLOW_COLUMNS, "packet_count", "byte_count", "first_seen", "last_seen", "first_frame",
                "a_to_b_packets", "b_to_a_packets", "a_to_b_bytes", "b_to_a_bytes"]
#: Flows that an ordered limit may hold in one task.
MOST_LISTED = 100_000
# Issue tags a packet can carry.
ISSUE_TAGS = ["tcp_retransmission", "tcp_out_of_order", "tcp_duplicate_ack", "tcp_lost_segment",
              "tcp_zero_window", "tcp_reset", "tls_alert", "tls_fatal_alert"]
# How many of each kind a saved summary keeps.
SAVED_MOST = {"protocol": 20, "port": 20, "issue": 30, "name": 50}


def capture_totals(pk: DataFrame) -> DataFrame:
    per_flow = pk.groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"))
    return per_flow.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("packet_count"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"),
        F.count(F.lit(1)).alias("flow_count"))


def _values(pk: DataFrame, out: str, columns: list[Column], keys: list[str] = ()) -> DataFrame:
    entries = F.array(*[
        F.struct(c.alias(out), place_in_packet(F.lit(i)).alias("at")) for i, c in enumerate(columns)])
    return pk.select(*keys, F.inline(entries))


def counter(values: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Counts per value from the most frequent; ties stay in order of first appearance."""
    kept = values.where(F.col(key).isNotNull())
    if not isinstance(values.schema[at].dataType, T.StructType):
        counts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"))
        return by_frequency(counts).select(key, "n", "rank")
    # the minimum of a struct makes Spark sort all rows; that of a frame for each slot is hashed
    frame = F.col(f"{at}.frame")
    slots = kept.groupBy(key, F.col(f"{at}.slot").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(frame) == F.count(F.lit(1)), F.min(frame)).alias("frame"))
    counts = slots.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.struct("frame", "slot")).alias("first_at"))
    return by_frequency(counts).select(key, "n", "rank")


def protocol_counts(pk: DataFrame) -> DataFrame:
    return counter(pk.select("protocol", F.col("frame_number").alias("at")), "protocol")


def port_counts(pk: DataFrame) -> DataFrame:
    return counter(_values(pk, "port", [F.col("src_port"), F.col("dst_port")]), "port")


def name_counts(pk: DataFrame) -> DataFrame:
    names = _values(pk, "name", [F.col("dns_query"), F.col("http_host"), F.col("tls_sni")])
    return counter(names.where(F.col("name") != ""), "name")


def _issues(pk: DataFrame, keys: list[str]) -> DataFrame:
    return pk.select(*keys, "frame_number", F.posexplode("issue_tags").alias("slot", "issue"))


def issue_counts(pk: DataFrame) -> DataFrame:
    tags = _issues(pk, []).withColumn("at", place_in_packet(F.col("slot")))
    return counter(tags, "issue")


def _tagged(tag: str) -> Column:
    tags = F.col("issue_tags")
    return F.coalesce(F.size(tags) - F.size(F.array_remove(tags, tag)), F.lit(0))


def flow_rollup(pk: DataFrame) -> DataFrame:
    """One row per flow with its counters; a single pass that combines before the shuffle."""
    forward = F.col("a_to_b")

    def both_ways(name: str, value: Column) -> list[Column]:
        return [F.coalesce(F.sum(F.when(forward, value)), F.lit(0)).alias(f"a_to_b_{name}"),
                F.coalesce(F.sum(F.when(~forward, value)), F.lit(0)).alias(f"b_to_a_{name}")]

    issues = [c for tag in ISSUE_TAGS for c in (
        F.coalesce(F.sum(_tagged(tag)), F.lit(0)).alias(tag), *both_ways(tag, _tagged(tag)))]
    failed = smb_failed(F.col("smb_status"))
    ack = F.upper("dhcp_message_type").contains("ACK")
    initial = F.col("initial_rtt_seconds")
    return pk.groupBy(*FLOW_COLUMNS).agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("length").alias("byte_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min("frame_number").alias("first_frame"),
        *both_ways("packets", F.lit(1)),
        *both_ways("bytes", F.col("length")),
        *issues,
        (F.max_by(initial, F.when(initial.isNotNull(), F.col("frame_number"))) * 1000).alias(
            "initial_rtt_ms"),
        F.count_if(filled(F.col("dns_query"))).alias("dns_queries"),
        F.count_if(filled(F.col("dns_response_code"))).alias("dns_responses"),
        F.count_if(F.size("dns_answers") > 0).alias("dns_answered"),
        F.count_if(filled(F.col("dns_response_code")) & ~dns_success(F.col("dns_response_code")))
        .alias("dns_errors"),
        F.count_if(filled(F.col("dhcp_message_type"))).alias("dhcp_messages"),
        F.count_if(F.coalesce(ack, F.lit(False))).alias("dhcp_acks"),
        F.count_if(filled(F.col("smb_command")) | (F.size("smb_commands_seen") > 0)).alias(
            "smb_commands"),
        F.count_if(filled(F.col("smb_status"))).alias("smb_statuses"),
        F.count_if(filled(F.col("smb_filename"))).alias("smb_named"),
        F.count_if("smb_encrypted").alias("smb_encrypted_packets"),
        F.count_if(failed).alias("smb_errors"),
        F.count_if(filled(F.col("tls_sni"))).alias("tls_snis"),
        F.count_if(filled(F.col("tls_alert_level")) | filled(F.col("tls_alert_description")))
        .alias("tls_alerts"),
        F.count_if(F.size("tls_certificates") > 0).alias("tls_certified"),
        F.count_if(F.col("rtp_ssrc").isNotNull() & F.col("rtp_sequence").isNotNull()).alias(
            "rtp_packets"),
        F.count_if(filled(F.col("esp_spi")) & F.col("esp_sequence").isNotNull()).alias(
            "esp_packets"),
        F.count_if(F.col("ike").isNotNull()).alias("ike_packets"),
        F.count_if(F.size("bgp_fields") > 0).alias("bgp_packets"),
        F.count_if(F.array_contains("decoded_protocols", "BGP")).alias("bgp_layers"),
        F.count_if(F.size("macsec_fields") > 0).alias("macsec_packets"),
        F.count_if(F.size("eapol_fields") > 0).alias("eapol_packets"),
        F.count_if(filled(F.col("sip_call_id")) | filled(F.col("sip_method"))
                   | F.col("sip_status_code").isNotNull()).alias("sip_packets"),
    )


def rank_flows(fl: DataFrame) -> DataFrame:
    """Number flows by bytes, first seen first among equals."""
    return rank_descending(fl, "byte_count", "first_frame", "flow_id")


def first_flows(fl: DataFrame, k: int) -> DataFrame:
    """The first k flows by bytes under their ids: an ordered limit, which keeps k rows of every task."""
    order = [F.desc("byte_count"), F.asc("first_frame")]
    return fl.orderBy(*order).limit(max(0, k)).withColumn("flow_id", F.row_number().over(
        Window.orderBy(*order)).cast("bigint"))  # k rows


def top_flows(fl: DataFrame, k: int) -> DataFrame:
    """The first k flows; flows that have no ids yet are not all ranked for it."""
    return fl.where(F.col("flow_id") <= k) if "flow_id" in fl.columns else first_flows(fl, k)


def select_flows(fl: DataFrame, k: int, include_id: int | None = None) -> DataFrame:
    """The first k flows and one more by id; an id outside the table adds nothing.

    Flows without ids are ranked as far as the last wanted one; beyond `MOST_LISTED` that is a rank of all.
    """
    if "flow_id" not in fl.columns:
        reach = max(k, include_id or 0)
        fl = first_flows(fl, reach) if reach <= MOST_LISTED else rank_flows(fl)
    wanted = F.col("flow_id") <= max(0, k)
    return fl.where(wanted if include_id is None else wanted | (F.col("flow_id") == include_id))


def direction_totals(pk: DataFrame) -> DataFrame:
    return flow_rollup(pk).select("flow_key", "a_to_b_packets", "b_to_a_packets", "a_to_b_bytes",
                                  "b_to_a_bytes")


def flow_issue_counts(pk: DataFrame) -> DataFrame:
    return _issues(pk, ["flow_key", "a_to_b"]).groupBy("flow_key", "a_to_b", "issue").agg(
        F.count(F.lit(1)).alias("n"))


def rtt_stats(pk: DataFrame) -> DataFrame:
    """Sample count, mean, median, 95th percentile and maximum of the round trips of a flow."""
    samples = pk.where(F.col("rtt_seconds").isNotNull()).select(
        "flow_key", (F.col("rtt_seconds") * 1000).alias("rtt_ms"))
    counts = settle(samples.groupBy("flow_key", "rtt_ms").agg(F.count(F.lit(1)).alias("n")), "rtt")
    exact = F.col("rtt_ms").cast("decimal(22,9)") * F.col("n").cast("decimal(12,0)")
    totals = counts.groupBy("flow_key").agg(
        F.sum("n").alias("rtt_samples"), F.sum(exact).alias("_sum"),
        F.max("rtt_ms").alias("rtt_max_ms"))
    ranked = nearest_rank(
        counts, ["flow_key"], "rtt_ms", bucket(F.floor(F.col("rtt_ms") * 1e6)),
        {"rtt_median_ms": 0.5, "rtt_p95_ms": 0.95}, weight="n")
    return totals.join(ranked, "flow_key").select(
        "flow_key", "rtt_samples",
        (F.col("_sum").cast("double") / F.col("rtt_samples")).alias("rtt_mean_ms"),
        "rtt_median_ms", "rtt_p95_ms", "rtt_max_ms")


def initial_rtt(pk: DataFrame) -> DataFrame:
    seconds = F.col("initial_rtt_seconds")
    return pk.where(seconds.isNotNull()).groupBy("flow_key").agg(
        (F.max_by(seconds, "frame_number") * 1000).alias("initial_rtt_ms"))


def max_interarrival(pk: DataFrame) -> DataFrame:
    """Largest wait since the latest time seen before in the flow; earlier times do not count."""
    now = F.unix_micros(F.col("timestamp").cast("timestamp"))
    timed = pk.select("flow_key", "frame_number", now.alias("now"))
    wait = F.col("now") - F.col("_latest")
    return scan(timed, ["flow_key"], "frame_number", highest={"_latest": F.col("now")}).where(
        wait >= 0).groupBy("flow_key").agg((F.max(wait) / F.lit(1e3)).alias("max_interarrival_ms"))


# Protocol evidence: (flow_key, mask, mask_a_to_b, mask_b_to_a, others, others_a_to_b, others_b_to_a). What is only in
# the undirected columns shows a protocol without showing its direction.
_WAYS = ("", "_a_to_b", "_b_to_a")


def _evidence(rows: DataFrame) -> DataFrame:
    """Evidence added up per flow: bits by `bit_or`, the few other names as a set."""
    def others(way: str) -> Column:
        listed = F.col(f"others{way}")
        return F.array_distinct(F.flatten(F.collect_set(F.when(F.size(listed) > 0, listed)))).alias(f"others{way}")

    return rows.groupBy("flow_key").agg(
        *[F.coalesce(F.bit_or(f"mask{way}"), F.lit(0).cast("bigint")).alias(f"mask{way}") for way in _WAYS],
        *[others(way) for way in _WAYS])


def _directed(rows: DataFrame, mask: Column, others: Column, forward: Column, backward: Column) -> DataFrame:
    """Evidence rows from a mask and other names, seen forward, backward or both."""
    nothing, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    return rows.select("flow_key", mask.alias("_mask"), others.alias("_others"), forward.alias("_f"), backward.alias("_b")).select(
        "flow_key", F.col("_mask").alias("mask"),
        F.when(F.col("_f"), F.col("_mask")).otherwise(nothing).alias("mask_a_to_b"),
        F.when(F.col("_b"), F.col("_mask")).otherwise(nothing).alias("mask_b_to_a"), F.col("_others").alias("others"),
        F.when(F.col("_f"), F.col("_others")).otherwise(none).alias("others_a_to_b"),
        F.when(F.col("_b"), F.col("_others")).otherwise(none).alias("others_b_to_a"))


def packet_evidence(pk: DataFrame) -> DataFrame:
    """What the packets of a flow show, by direction; one pass that combines before the shuffle."""
    names = F.concat(layer_names(), field_names())
    rows = pk.select("flow_key", "a_to_b", names.alias("names"))
    return _evidence(_directed(rows, known_mask(F.col("names")), other_names(F.col("names")), F.col("a_to_b"), ~F.col("a_to_b")))


def child_evidence(ike_sessions: DataFrame | None = None, rtp_streams: DataFrame | None = None,
                   bgp_packets: DataFrame | None = None) -> list[DataFrame]:
    """What the child tables of flows show without their packets, by direction."""
    c, none, found = F.col, F.array().cast("array<string>"), []
    if ike_sessions is not None:
        major = F.shiftright("version", 4)
        version = F.when(major == 1, mask_of("IKEV1")).when(major == 2, mask_of("IKEV2")).otherwise(mask_of("IKE"))
        other = F.when(major.isin(1, 2), none).otherwise(F.array(F.concat(F.lit("IKEV"), major.cast("string"))))
        found.append(_directed(ike_sessions, version.cast("bigint"), other, c("a_to_b_packets") > 0, c("b_to_a_packets") > 0))
    if rtp_streams is not None:
        media = F.when(c("srtp_packets") > 0, mask_of("SRTP")).otherwise(mask_of("RTP"))
        forward = c("direction") == "A_to_B"
        found.append(_directed(rtp_streams, media.cast("bigint"), none, forward, ~forward))
    if bgp_packets is not None:
        found.append(_directed(bgp_packets.where("packets > 0"), F.lit(mask_of("BGP")).cast("bigint"), none,
                               c("a_to_b_packets") > 0, c("b_to_a_packets") > 0))
    return found


def counter_evidence(fl: DataFrame) -> DataFrame:
    """What the counters of flows show: that a protocol is there, but not in which direction."""
    c, nothing = F.col, F.lit(0).cast("bigint")

    def any_of(*counters: str) -> Column:
        return F.greatest(*[c(n) for n in counters]) > 0

    secured = F.when(c("protocol") == "UDP", mask_of("DTLS")).otherwise(mask_of("TLS"))
    tests = [
        (any_of("dns_queries", "dns_responses", "dns_answered"), F.lit(mask_of("DNS"))),
        (c("dhcp_messages") > 0, F.lit(mask_of("DHCP"))), (c("sip_packets") > 0, F.lit(mask_of("SIP"))),
        (any_of("smb_commands", "smb_statuses", "smb_encrypted_packets"), F.lit(mask_of("SMB"))),
        (any_of("tls_snis", "tls_certified", "tls_alerts"), secured)]
    mask = reduce(Column.bitwiseOR, [F.when(t, m.cast("bigint")).otherwise(nothing) for t, m in tests])
    never = F.lit(False)
    return _directed(fl, mask, F.array().cast("array<string>"), never, never)


def transport_evidence(fl: DataFrame) -> DataFrame:
    """The transport a flow is keyed by belongs to both directions."""
    names = F.array("protocol")
    return _directed(fl, known_mask(names), other_names(names), F.lit(True), F.lit(True))


def protocol_sets(*evidence: DataFrame) -> DataFrame:
    """Sorted names per flow from any number of evidence tables, in all and by direction."""
    whole = _evidence(reduce(DataFrame.unionByName, evidence))
    return whole.select("flow_key", *[names_of(F.col(f"mask{way}"), F.col(f"others{way}")).alias(name) for way, name in zip(
        _WAYS, ("decoded_protocols", "protocols_a_to_b", "protocols_b_to_a"))])


def flow_protocol_sets(pk: DataFrame) -> DataFrame:
    """Sorted names per flow that its packets show, in all and by direction."""
    found = packet_evidence(pk)
    return found.select("flow_key", *[names_of(F.col(f"mask{way}"), F.col(f"others{way}")).alias(name) for way, name in zip(
        _WAYS, ("decoded_protocols", "protocols_a_to_b", "protocols_b_to_a"))])


def flow_protocol_names(pk: DataFrame) -> DataFrame:
    """Each protocol name seen in a flow."""
    return flow_protocol_sets(pk).select("flow_key", F.explode("decoded_protocols").alias("name"))


def flow_names(pk: DataFrame) -> DataFrame:
    """Names of a flow in order of first appearance, sorted within one packet."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.col("dns_query"), F.col("http_host"), F.col("tls_sni")))))
    listed = pk.select("flow_key", "frame_number", F.posexplode(names).alias("slot", "name"))
    return ordered_distinct(
        listed.withColumn("at", place_in_packet(F.col("slot"))),
        ["flow_key"], "name", "at").select("flow_key", "name", "position")


def redirect_locations(pk: DataFrame) -> DataFrame:
    return ordered_distinct(pk, ["flow_key"], "http_location").select(
        "flow_key", "http_location", "position")


def summary_from_flows(ranked: DataFrame, issues: DataFrame, names: DataFrame,
                       most: dict[str, int] | None = None) -> DataFrame:
    """Count tables of a chosen set of flows: (kind, value, n, rank), whole unless `most` cuts a kind.

    A saved summary keeps the first ones of each kind: `most=SAVED_MOST`.
    """
    fl = ranked.select("flow_key", "flow_id", "protocol", "port_a", "port_b", "packet_count")
    protocols = fl.groupBy(F.col("protocol").alias("value")).agg(
        F.sum("packet_count").alias("n"), F.min("flow_id").alias("first"))
    ports = fl.select("packet_count", F.inline(F.array(
        F.struct(F.col("port_a").alias("value"), place_in_packet(F.lit(0), "flow_id").alias("at")),
        F.struct(F.col("port_b").alias("value"), place_in_packet(F.lit(1), "flow_id").alias("at")))),
    ).where(F.col("value").isNotNull()).groupBy(F.col("value").cast("string").alias("value")).agg(
        F.sum("packet_count").alias("n"), F.min("at").alias("first"))
    tagged = issues.groupBy("flow_key", "issue").agg(F.sum("n").alias("n")).join(
        fl.select("flow_key", "flow_id"), "flow_key").groupBy(F.col("issue").alias("value")).agg(
            F.sum("n").alias("n"), F.min("flow_id").alias("first"))
    named = names.join(fl.select("flow_key", "flow_id"), "flow_key").groupBy(
        F.col("name").alias("value")).agg(
            F.min(F.struct("flow_id", "position")).alias("first"))

    def numbered(table: DataFrame, kind: str, *tie: str) -> DataFrame:
        """Values by count; ties by first appearance, then value."""
        counted = table.select("value", "n", F.struct(*tie, "value").alias("tie"))
        return cut(by_frequency(counted, "n", "tie"), kind)

    def cut(table: DataFrame, kind: str) -> DataFrame:
        kept = table.where(F.col("rank") <= most[kind]) if most and kind in most else table
        return kept.select(F.lit(kind).alias("kind"), "value", "n", "rank")

    in_order = scan(named, [], "first", position="rank").withColumn("n", F.lit(None).cast("bigint"))
    return (numbered(protocols, "protocol", "first")
            .unionByName(numbered(ports, "port", "first.frame", "first.slot"))
            .unionByName(numbered(tagged, "issue", "first"))
            .unionByName(cut(in_order, "name")))


def endpoint_inventory(fl: DataFrame) -> DataFrame:
    """Distinct endpoints and endpoint:port texts of a set of flows."""
    c = F.col

    def label(end: str) -> Column:
        return F.concat_ws(":", c(f"endpoint_{end}"), c(f"port_{end}").cast("string"))

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    return fl.select(F.inline(F.array(
        entry("endpoint", c("endpoint_a")), entry("endpoint", c("endpoint_b")),
        entry("endpoint_port", label("a")), entry("endpoint_port", label("b"))))).distinct()
