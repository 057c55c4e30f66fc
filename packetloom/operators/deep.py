"""Header rows of a flow for one tool: which rows, what they add up to, and a page of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import nanoseconds, relative
from packetloom.operators import metrics
from packetloom.operators.filters import TOOL_TRANSPORTS, endpoint_pair, tool_predicate
from packetloom.operators.ordered import DEFAULT_PAUSE_MS, gap_stats, packet_gaps
from packetloom.operators.paging import PAGE_ROWS, page_descriptor, page_rows
from packetloom.schemas import field

# Tools from the one asked first, and the ports that suggest TLS or SMB.
TOOL_ORDER = ["deep_macsec_flow", "deep_eapol_flow", "deep_ike_flow", "deep_rtp_flow",
              "deep_tls_flow", "deep_smb2_flow", "deep_esp_flow", "deep_tcp_flow",
              "deep_udp_flow", "deep_bgp_flow"]
TLS_TCP_PORTS = [443, 853, 8443]
TLS_UDP_PORTS = [443, 853, 4433]
SMB_PORTS = [445, 139]
SLOW_PACKETS = 100


def attach(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Packets or header rows with the id of their flow."""
    return rows.join(ranked.select("flow_key", "flow_id"), "flow_key")


def tool_rows(headers: DataFrame, tool: str) -> DataFrame:
    """Rows of a tool in all flows it applies to."""
    has_ports = F.col("port_a").isNotNull() | F.col("port_b").isNotNull()
    return headers.where(
        F.col("protocol").isin(TOOL_TRANSPORTS[tool])
        & tool_predicate(tool, F.col("decoded_protocols"), has_ports))


def flow_rows(headers: DataFrame, tool: str, a: str, port_a: int | None, b: str,
              port_b: int | None) -> DataFrame:
    """Rows of a tool between two endpoints, filtered before anything else."""
    transport = "tcp" if "TCP" in TOOL_TRANSPORTS[tool] else "udp"
    bound = port_a is not None or port_b is not None
    return tool_rows(headers, tool).where(endpoint_pair(
        a, port_a, b, port_b, src=F.col("src"), dst=F.col("dst"),
        src_port=field(f"{transport}.srcport").try_cast("int") if bound else None,
        dst_port=field(f"{transport}.dstport").try_cast("int") if bound else None))


def row_time_ns() -> Column:
    return nanoseconds(relative(field("frame.time_relative")))


def annotated_rows(headers: DataFrame) -> DataFrame:
    """Rows with the gap to the previous row of their direction and RTP source.

    Gaps are taken over all rows of a flow, so a page keeps the gap to the row before it.
    """
    rows = headers.withColumn("_ns", row_time_ns())
    ways = packet_gaps(rows, ["flow_key", "a_to_b"], "_ns", out="direction_gap_ms").drop(
        "direction_gap_ms_backward")
    ways = ways.withColumn("_ssrc", field("rtp.ssrc"))
    media = packet_gaps(ways.where("_ssrc IS NOT NULL"), ["flow_key", "a_to_b", "_ssrc"], "_ns",
                        out="stream_gap_ms").drop("stream_gap_ms_backward")
    return media.unionByName(ways.where("_ssrc IS NULL").withColumn(
        "stream_gap_ms", F.lit(None).cast("double"))).drop("_ns", "_ssrc")


def recompute_gaps(headers: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """Gap statistics of stored rows under another threshold, per flow and direction."""
    rows = headers.select("flow_key", "a_to_b", "frame_number", row_time_ns().alias("time_ns"))
    return gap_stats(rows, ["flow_key", "a_to_b"], "time_ns", threshold_ms=threshold_ms)


def deep_reason(tool: str) -> Column:
    """Why a tool is worth running on a flow; null when it is not. Columns of the flow rollup."""
    c = F.col
    tcp, udp, esp = (c("protocol") == p for p in ("TCP", "UDP", "ESP"))
    slow = (c("packet_count") >= SLOW_PACKETS) & (metrics.total_rates()["mbps"] < 1)

    def on_port(numbers: list[int]) -> Column:
        return F.coalesce(c("port_a").isin(numbers), F.lit(False)) | F.coalesce(
            c("port_b").isin(numbers), F.lit(False))

    tcp_issues = sum((c(t) for t in ("tcp_retransmission", "tcp_out_of_order", "tcp_duplicate_ack",
                                     "tcp_lost_segment", "tcp_zero_window", "tcp_reset")), F.lit(0))
    # The reasons, from the first that holds.
    rules = {
        "deep_tcp_flow": [
            (tcp & (tcp_issues > 0), "TCP issue counters observed."),
            (tcp & metrics.is_one_way(), "One-way TCP flow observed; inspect headers for "
             "handshake/reset/window clues."),
            (tcp & slow, "Longer TCP flow has low throughput; inspect headers for transport "
             "constraints.")],
        "deep_udp_flow": [
            (udp & (c("dns_errors") > 0), "DNS error responses observed; inspect UDP/DNS "
             "transaction details."),
            (udp & ((c("dns_queries") > 0) | (c("dns_responses") > 0) | (c("dns_answered") > 0)),
             "DNS metadata observed; inspect UDP/DNS transaction timing and answers."),
            (udp & (c("dhcp_messages") > 0) & (c("dhcp_acks") == 0), "DHCP exchange appears "
             "incomplete; inspect UDP/DHCP transaction details."),
            (udp & (c("dhcp_messages") > 0), "DHCP metadata observed; inspect UDP/DHCP "
             "transaction, lease, and server details."),
            (udp & metrics.is_one_way(), "One-way UDP flow observed; inspect UDP headers and "
             "response visibility.")],
        "deep_tls_flow": [
            ((tcp | udp) & (c("tls_alerts") > 0), "TLS/DTLS alert observed; inspect TLS/DTLS "
             "handshake, alert, and transport headers."),
            ((tcp | udp) & (c("tls_certified") > 0), "TLS certificates observed; inspect complete "
             "TLS certificate chain and handshake fields."),
            ((tcp | udp) & (c("tls_snis") > 0), "TLS SNI observed; inspect TLS ClientHello and "
             "related transport headers."),
            (tcp & on_port(TLS_TCP_PORTS), "Likely TLS flow by TCP port; inspect TLS handshake "
             "and TCP headers."),
            (udp & on_port(TLS_UDP_PORTS), "Likely DTLS or encrypted UDP flow by port; inspect "
             "DTLS and UDP headers.")],
        "deep_smb2_flow": [
            (tcp & ((c("smb_commands") > 0) | (c("smb_statuses") > 0)
                    | (c("smb_encrypted_packets") > 0)), "SMB metadata observed; inspect SMB2 "
             "credit charge, request/grant, statuses, transfer headers, and related TCP "
             "symptoms."),
            (tcp & on_port(SMB_PORTS), "Likely SMB flow by TCP port; inspect SMB2 credit "
             "behavior, statuses, transfer headers, and related TCP symptoms.")],
        "deep_esp_flow": [
            (esp & (c("esp_packets") > 0), "ESP/IPsec flow observed; inspect fragmentation, DSCP, "
             "TTL/hop-limit, packet size, and NAT-T headers. Use the Top Flows ESP sequence "
             "summary for missing, duplicate, and out-of-order sequence findings."),
            (esp & slow, "Longer ESP/IPsec flow has low throughput; inspect ESP/IP headers for "
             "loss, reordering, fragmentation, or NAT-T visibility.")],
        "deep_rtp_flow": [(c("rtp_packets") > 0, "RTP/SRTP headers observed; inspect SSRC, "
                           "sequence, timestamps and payload types.")],
        "deep_ike_flow": [(c("ike_packets") > 0, "IKEv1/IKEv2 observed; inspect headers, visible "
                           "notifications and fragments.")],
        "deep_bgp_flow": [((c("bgp_packets") > 0) | (c("bgp_layers") > 0), "Inspect BGP messages, "
                           "OPEN parameters and NOTIFICATION errors.")],
        "deep_macsec_flow": [(c("macsec_packets") > 0, "Inspect visible MACsec SecTAG/SCI/PN "
                              "headers.")],
        "deep_eapol_flow": [(c("eapol_packets") > 0, "Inspect EAPOL, EAP status and MKA "
                             "headers.")],
    }
    result = F
    for test, text in rules[tool]:
        result = result.when(test, F.lit(text))
    return result.otherwise(F.lit(None).cast("string"))


def flow_reasons(flows: DataFrame) -> DataFrame:
    """(flow, tool, reason) for every tool worth running on a flow."""
    listed = F.array(*[F.struct(F.lit(t).alias("tool"), deep_reason(t).alias("reason"))
                       for t in TOOL_ORDER])
    return metrics.with_duration(flows).select("flow_key", F.inline(listed)).where(
        "reason IS NOT NULL")


def route_tools(ranked: DataFrame, most: int = 2) -> DataFrame:
    """The first tool of each flow, for the first flows that have one."""
    listed = F.array(*[F.struct(F.lit(t).alias("tool"), deep_reason(t).alias("reason"))
                       for t in TOOL_ORDER])
    first = F.get(F.filter(listed, lambda c: c["reason"].isNotNull()), F.lit(0))
    routed = metrics.with_duration(ranked).select("flow_id", "flow_key", first.alias("c")).where(
        "c IS NOT NULL")
    return routed.select("flow_id", "flow_key", "c.tool", "c.reason").orderBy("flow_id").limit(most)


def evidence_lookup(requests: DataFrame, ranked: DataFrame, headers: DataFrame,
                    limit: int = PAGE_ROWS) -> DataFrame:
    """Answer requests (request_id, tool, flow_id, offset) with a status, target flow and page.

    A tool outside the list is rejected, an unknown flow is not found, a tool that does not fit the
    flow's transport is skipped; one failing request leaves the others alone.
    """
    c = F.col
    known = requests.join(ranked.select(
        "flow_id", "flow_key", "protocol", "endpoint_a", "port_a", "endpoint_b", "port_b"),
        "flow_id", "left")
    fits = F
    for tool, transports in TOOL_TRANSPORTS.items():
        fits = fits.when(c("tool") == tool, F.coalesce(c("protocol").isin(transports), F.lit(False)))
    answered = known.withColumn("status", F.when(
        ~c("tool").isin(list(TOOL_TRANSPORTS)), "rejected").when(
        c("flow_key").isNull(), "not_found").when(~fits.otherwise(F.lit(False)), "skipped").otherwise(
            "ok"))
    asked = answered.where("status = 'ok'").select("flow_key", "tool").distinct()
    totals = listed_rows(headers).join(asked, ["flow_key", "tool"], "left_semi").groupBy(
        "flow_key", "tool").agg(F.count(F.lit(1)).alias("n"))
    counted = answered.join(totals, ["flow_key", "tool"], "left").withColumn(
        "total", F.when(c("status") == "ok", F.coalesce("n", F.lit(0))))
    return counted.select("request_id", "tool", "flow_id", "flow_key", "status", *page_descriptor(
        c("total"), c("offset"), F.lit(limit).cast("bigint")))


def listed_rows(headers: DataFrame) -> DataFrame:
    """(flow, tool, frame) for every tool a row belongs to."""
    has_ports = F.col("port_a").isNotNull() | F.col("port_b").isNotNull()
    tools = F.array_compact(F.array(*[F.when(
        F.col("protocol").isin(TOOL_TRANSPORTS[t])
        & tool_predicate(t, F.col("decoded_protocols"), has_ports), F.lit(t)) for t in TOOL_ORDER]))
    return headers.select("flow_key", "frame_number", F.explode(tools).alias("tool"))


def requested_rows(requests: DataFrame, ranked: DataFrame, headers: DataFrame,
                   limit: int = PAGE_ROWS) -> DataFrame:
    """The rows of the requested pages: (request_id, flow, tool, position, frame_number)."""
    targets = requests.join(ranked.select("flow_id", "flow_key"), "flow_id").select(
        "request_id", "tool", "flow_key", "offset")
    rows = listed_rows(headers).join(
        targets.select("flow_key", "tool").distinct(), ["flow_key", "tool"], "left_semi")
    from packetloom.operators.ranking import row_positions

    numbered = row_positions(rows, ["flow_key", "tool"], "frame_number", "position")
    return page_rows(numbered, targets, ["flow_key", "tool"], limit).select(
        "request_id", "flow_key", "tool", "position", "frame_number")


