"""RTP and SRTP streams per flow, direction and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled, packet_time_ns, safe_int
from packetloom.operators.ordered import DEFAULT_PAUSE_MS, extend_sequence, gap_stats

# Exported header fields of the tool.
FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "frame.len", "ip.src", "ipv6.src",
    "ip.dst", "ipv6.dst", "udp.srcport", "udp.dstport", "udp.length", "rtp.version", "rtp.ssrc",
    "rtp.seq", "rtp.timestamp", "rtp.p_type", "rtp.marker", "_ws.col.Protocol",
]
STREAM = ["flow_key", "direction", "rtp_ssrc"]


def rtp_header(fields: dict[str, Column], protocol: Column, srtp_ports: list[int] = ()
               ) -> dict[str, Column]:
    """RTP columns of a packet: version 2 over UDP only.

    SRTP needs an explicitly named port or encrypted fields. `fields` holds the header texts:
    version, ssrc, seq, timestamp, p_type, marker, srtp_enc_payload, srtp_auth_tag, srcport, dstport.
    """
    usable = (protocol == "UDP") & (fields["version"] == "2")

    def kept(value: Column) -> Column:
        return F.when(usable, value)

    secure = fields["srtp_enc_payload"].isNotNull() | fields["srtp_auth_tag"].isNotNull()
    for end in ("srcport", "dstport"):
        if srtp_ports:
            secure = secure | F.coalesce(safe_int(fields[end]).isin(list(srtp_ports)), F.lit(False))
    return {
        "rtp_ssrc": kept(fields["ssrc"]),
        "rtp_sequence": kept(safe_int(fields["seq"])),
        "rtp_timestamp": kept(safe_int(fields["timestamp"])),
        "rtp_payload_type": kept(safe_int(fields["p_type"])),
        "rtp_marker": kept(F.lower(fields["marker"]).isin("true", "1").cast("int")),
        "srtp": F.coalesce(usable & secure, F.lit(False)),
    }


def stream_rows(pk: DataFrame) -> DataFrame:
    """Packets of RTP streams; a direction is the exact source address and port."""
    c = F.col
    forward = (c("src_ip") == c("endpoint_a")) & c("src_port").eqNullSafe(c("port_a"))
    return pk.where(c("rtp_ssrc").isNotNull() & c("rtp_sequence").isNotNull()).select(
        "flow_key", F.when(forward, "A_to_B").otherwise("B_to_A").alias("direction"), "rtp_ssrc",
        "rtp_sequence", "rtp_payload_type", F.coalesce("srtp", F.lit(False)).alias("srtp"),
        "frame_number", packet_time_ns().alias("time_ns"))


def rtp_streams(pk: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """One row per stream: copies, late packets, holes in the unrolled numbers, and packet gaps."""
    return streams_of(stream_rows(pk), threshold_ms)


def header_stream_rows(fr: DataFrame) -> DataFrame:
    """The rows of streams among header rows, in the shape of `stream_rows`."""
    from packetloom.functions.parse import nanoseconds, relative
    from packetloom.schemas import field

    rows = secured_rows(fr).select(
        "flow_key", F.when(F.col("a_to_b"), "A_to_B").otherwise("B_to_A").alias("direction"),
        field("rtp.ssrc").alias("rtp_ssrc"), safe_int(field("rtp.seq")).cast("bigint").alias("rtp_sequence"), "srtp",
        "frame_number", nanoseconds(relative(field("frame.time_relative"))).alias("time_ns"))
    return rows.where("rtp_ssrc IS NOT NULL AND rtp_sequence IS NOT NULL")


def streams_of(rows: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """Streams of rows that name their stream, number and time."""
    extended = extend_sequence(
        rows.select(*STREAM, "rtp_sequence", "frame_number", "srtp"), STREAM, "rtp_sequence")
    points = extended.groupBy(*STREAM, "extended").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if("srtp").alias("secured"),
        F.min_by("highest_before", "frame_number").alias("highest_before"))
    streams = points.groupBy(*STREAM).agg(
        F.sum("copies").alias("packets"), F.sum("secured").alias("srtp_packets"),
        (F.sum("copies") - F.count(F.lit(1))).alias("duplicates"),
        F.count_if(F.col("extended") < F.col("highest_before")).alias("out_of_order"),
        F.min("extended").alias("lowest_sequence"), F.max("extended").alias("highest_sequence"),
        F.count(F.lit(1)).alias("distinct_sequences"),
    ).withColumn("holes", F.greatest(
        F.lit(0), F.col("highest_sequence") - F.col("lowest_sequence") + 1
        - F.col("distinct_sequences")))
    gaps = gap_stats(rows.select(*STREAM, "time_ns", "frame_number"), STREAM, "time_ns",
                     threshold_ms=threshold_ms)
    return streams.join(gaps, STREAM)


def rtp_payload_types(pk: DataFrame) -> DataFrame:
    return stream_rows(pk).where("rtp_payload_type IS NOT NULL").groupBy(
        *STREAM, "rtp_payload_type").agg(F.count(F.lit(1)).alias("n"))


def secured_rows(fr: DataFrame, srtp_ports: list[int] = ()) -> DataFrame:
    """Header rows with the media security the dissector or a named port shows."""
    from packetloom.schemas import field

    named = F.upper(F.coalesce(field("_ws.col.Protocol"), F.lit(""))) == "SRTP"
    for end in ("udp.srcport", "udp.dstport"):
        if srtp_ports:
            named = named | F.coalesce(safe_int(field(end)).isin(list(srtp_ports)), F.lit(False))
    return fr.withColumns({
        "srtp": named & filled(field("rtp.ssrc")),
        "media_security": F.when(named, "SRTP (dissector or explicit port)").otherwise("unknown")})
