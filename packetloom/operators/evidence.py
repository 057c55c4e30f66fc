"""Where to look: rows that show a problem, and windows of rows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled, packet_time_ns
from packetloom.operators.folds import CONTEXT_ROWS, WINDOW_ROWS, window_openers
from packetloom.operators.ordered import (
    DEFAULT_PAUSE_MS, extend_sequence, packet_gaps, scan, sequence_anomalies)
from packetloom.operators.ranking import row_positions
from packetloom.settings import settle

# The tool that lists every packet of a transport.
PRIMARY_TOOLS = {"TCP": "deep_tcp_flow", "UDP": "deep_udp_flow", "ESP": "deep_esp_flow",
                 "MACSEC": "deep_macsec_flow", "EAPOL": "deep_eapol_flow"}

# Reasons of one packet are listed in this order; issue tags keep their own places below 100.
ISSUE, DNS, SIP, TLS, BGP, EAP, IKE, PAUSE, ESP_SEQUENCE, RTP_PAUSE, RTP_SEQUENCE = range(
    0, 1100, 100)


def evidence_tools() -> Column:
    """Tools whose rows include a packet, by its transport and decoded layers."""
    layers = F.split(F.upper(F.array_join(F.coalesce(
        F.col("decoded_protocols"), F.array().cast("array<string>")), ",")), ",")
    protocol = F.col("protocol")

    def has(name: str) -> Column:
        return F.array_contains(layers, name)

    primary = F
    for name, tool in PRIMARY_TOOLS.items():
        primary = primary.when(protocol == name, F.lit(tool))
    tcp, udp = protocol == "TCP", protocol == "UDP"
    return F.array_compact(F.array(
        primary.otherwise(F.lit(None)),
        F.when((tcp | udp) & (has("TLS") | has("DTLS")), F.lit("deep_tls_flow")),
        F.when(tcp & has("SMB2"), F.lit("deep_smb2_flow")),
        F.when(tcp & has("BGP"), F.lit("deep_bgp_flow")),
        F.when(udp & has("RTP"), F.lit("deep_rtp_flow")),
        F.when(udp & has("ISAKMP") & ~has("ESP"), F.lit("deep_ike_flow"))))


def evidence_positions(pk: DataFrame) -> DataFrame:
    """Place of every packet among the rows of each tool, both directions, before any filter."""
    listed = pk.select("flow_key", "frame_number", "a_to_b",
                       F.explode(evidence_tools()).alias("tool"))
    return row_positions(listed, ["flow_key", "tool"], "frame_number", "position")


def _reason(order: int, test: Column, text: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(order).alias("reason_order"), text.alias("reason"),
        F.lit(None).cast("double").alias("gap_ms")))


def packet_reasons() -> Column:
    """Reasons a packet shows by itself."""
    c = F.col
    null = F.lit(None).cast("double")
    tags = F.transform(
        F.coalesce(c("issue_tags"), F.array().cast("array<string>")),
        lambda tag, at: F.struct((F.lit(ISSUE) + at).alias("reason_order"), tag.alias("reason"),
                                 null.alias("gap_ms")))
    return F.concat(tags, F.array_compact(F.array(
        _reason(DNS, filled(c("dns_response_code")) & ~c("dns_response_code").isin("0", "No error"),
                F.concat(F.lit("DNS response code "), c("dns_response_code"))),
        _reason(SIP, c("sip_status_code") >= 400,
                F.concat(F.lit("SIP status "), c("sip_status_code").cast("string"))),
        _reason(TLS, c("tls_alert_level").isNotNull(),
                F.concat(F.lit("TLS alert "), c("tls_alert_level"), F.lit(": "),
                         F.coalesce(c("tls_alert_description"), F.lit("None")))),
        _reason(BGP, F.size(c("bgp_fields")["bgp.notify.major_error"]) > 0,
                F.concat(F.lit("BGP NOTIFICATION: "),
                         F.array_join(c("bgp_fields")["bgp.notify.major_error"], ","))),
        _reason(EAP, F.array_contains(c("eapol_fields")["eap.code"], "4"),
                F.lit("EAP Failure observed")),
        _reason(IKE, F.exists(c("ike.notify_types"), lambda n: (n > 0) & (n < 16384)),
                F.lit("IKE error notification observed")))))


def _sequence_reasons(rows: DataFrame, order: int, protocol: str, stream: str, seq: str,
                      duplicate: Column, late: Column) -> DataFrame:
    """Rows marked as copies, late, or behind a gap."""
    label = (F.when(duplicate, F.lit("duplicate sequence"))
             .when(late, F.lit("out-of-order sequence"))
             .when(F.col(seq) > F.col("highest_before") + 1, F.concat(
                 F.lit("sequence gap of "),
                 (F.col(seq) - F.col("highest_before") - 1).cast("string"))))
    return rows.withColumn("_label", label).where("_label IS NOT NULL").select(
        "frame_number", F.lit(order).alias("reason_order"),
        F.concat(F.lit(f"{protocol} "), F.col(stream), F.lit(": "), F.col("_label"),
                 F.lit(" observed (not proven loss)")).alias("reason"),
        F.lit(None).cast("double").alias("gap_ms"))


def esp_reasons(pk: DataFrame) -> DataFrame:
    keys = ["flow_key", "a_to_b", "esp_spi"]
    rows = sequence_anomalies(
        pk.where(F.col("esp_spi").isNotNull() & F.col("esp_sequence").isNotNull()).select(
            *keys, "esp_sequence", "frame_number"), keys, "esp_sequence")
    return _sequence_reasons(rows, ESP_SEQUENCE, "ESP", "esp_spi", "esp_sequence",
                             F.col("is_duplicate"), F.col("is_out_of_order"))


def rtp_reasons(pk: DataFrame) -> DataFrame:
    keys = ["flow_key", "a_to_b", "rtp_ssrc"]
    rows = pk.where(F.col("rtp_ssrc").isNotNull() & F.col("rtp_sequence").isNotNull()).select(
        *keys, "rtp_sequence", "frame_number")
    extended = settle(extend_sequence(rows, keys, "rtp_sequence"), "rtp-extended")
    nth = scan(extended, [*keys, "extended"], "frame_number", position="_nth")
    return _sequence_reasons(nth, RTP_SEQUENCE, "RTP", "rtp_ssrc", "extended",
                             F.col("_nth") > 1, F.col("extended") < F.col("highest_before"))


def pause_reasons(pk: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """Pauses of a direction and of an RTP source. The gap is a number; the text names its kind."""
    timed = pk.select("flow_key", "a_to_b", "rtp_ssrc", "frame_number",
                      packet_time_ns().alias("time_ns"))
    ways = packet_gaps(timed, ["flow_key", "a_to_b"], "time_ns").where(
        F.col("gap_ms") >= threshold_ms).select(
            "frame_number", F.lit(PAUSE).alias("reason_order"),
            F.lit("Direction packet gap").alias("reason"), "gap_ms")
    media = packet_gaps(timed.where("rtp_ssrc IS NOT NULL"), ["flow_key", "a_to_b", "rtp_ssrc"],
                        "time_ns").where(F.col("gap_ms") >= threshold_ms).select(
        "frame_number", F.lit(RTP_PAUSE).alias("reason_order"),
        F.concat(F.lit("RTP SSRC "), F.col("rtp_ssrc"), F.lit(" gap")).alias("reason"), "gap_ms")
    return ways.unionByName(media)


def evidence_reasons(pk: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """(frame_number, reason_order, reason, gap_ms): each reason a packet is worth a look."""
    own = pk.select("frame_number", F.inline(packet_reasons()))
    return (own.unionByName(esp_reasons(pk)).unionByName(rtp_reasons(pk))
            .unionByName(pause_reasons(pk, threshold_ms)))


def evidence_triggers(pk: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """Positions of the packets with reasons, per flow and tool; few reasons to a packet."""
    reasons = evidence_reasons(pk, threshold_ms).groupBy("frame_number").agg(
        F.array_distinct(F.transform(
            F.array_sort(F.collect_list(F.struct("reason_order", "reason", "gap_ms"))),
            lambda r: r["reason"])).alias("reasons"))
    return evidence_positions(pk).join(reasons, "frame_number")


def merge_windows(triggers: DataFrame) -> DataFrame:
    """One row per window of 1000 rows: its start, first trigger, trigger count, reasons, events.

    A window opens up to 100 rows before its first trigger and takes every trigger inside it.
    """
    keys = ["flow_key", "tool"]
    rows = settle(triggers, "triggers")
    opened = window_openers(rows, keys, "position")
    start = F.greatest(F.col("position") - CONTEXT_ROWS, F.lit(0))
    # A window touches two blocks of its own size; rows meet it in their block. A window takes the
    # rows from its first trigger on, so no row meets two.
    blocks = opened.select(
        *keys, F.col("position").alias("opener"), start.alias("sample_offset"),
        F.explode(F.sequence(F.floor(F.col("position") / WINDOW_ROWS),
                             F.floor((start + WINDOW_ROWS - 1) / WINDOW_ROWS))).alias("block"))
    inside = (F.col("position") >= F.col("opener")) & (
        F.col("position") < F.col("sample_offset") + WINDOW_ROWS)
    placed = rows.withColumn("block", F.floor(F.col("position") / WINDOW_ROWS)).join(
        blocks, [*keys, "block"]).where(inside)
    event = F.struct("position", "frame_number", "a_to_b", "reasons")
    windows = placed.groupBy("flow_key", "tool", "sample_offset").agg(
        F.array_sort(F.collect_list(event)).alias("events"))
    reasons = F.array_distinct(F.flatten(F.col("events.reasons")))
    return windows.select(
        "flow_key", "tool", "sample_offset",
        F.col("events")[0]["position"].alias("issue_packet_index"),
        F.col("events")[0]["frame_number"].alias("frame_number"),
        F.size("events").alias("issue_count"), F.lit(WINDOW_ROWS).alias("batch_size"),
        reasons.alias("reasons"),
        F.transform("events", lambda e: F.struct(
            e["position"].alias("issue_packet_index"), e["frame_number"].alias("frame_number"),
            e["a_to_b"].alias("a_to_b"),
            F.transform(e["reasons"], lambda r: F.array_position(reasons, r) - 1).alias(
                "reason_indices"))).alias("events"))


def reopen_windows(windows: DataFrame) -> DataFrame:
    """Triggers of windows that were merged before, so saved tables can be merged again."""
    return windows.select("flow_key", "tool", F.explode("events").alias("e"), "reasons").select(
        "flow_key", "tool", F.col("e.issue_packet_index").alias("position"),
        F.col("e.frame_number").alias("frame_number"), F.col("e.a_to_b").alias("a_to_b"),
        F.transform("e.reason_indices", lambda i: F.get("reasons", i.cast("int"))).alias("reasons"))
