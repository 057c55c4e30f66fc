"""Deep queries: many requests for a tool and a flow, answered in one call.

The header rows are scanned once: a row that any request asks for is stored once, with the tools that ask for it and the
fields that their counters read, and each tool adds up its rows from there. An answer has a status, the reason to ask,
a page descriptor and counters; a request that cannot be answered has a status only and leaves the others alone.
Counters are a long table (flow, tool, counter, item, value), where an item is what is counted apart: a field's value,
a stream, a session.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators import deep
from packetloom.operators.filters import TOOL_TRANSPORTS, tool_predicate
from packetloom.operators.ordered import DEFAULT_PAUSE_MS
from packetloom.operators.paging import PAGE_ROWS, page_descriptor, page_rows
from packetloom.operators.ranking import row_positions
from packetloom.protocols import bgp, esp, ike, link, rtp, smb, tcp, tls
from packetloom.schemas import field
from packetloom.settings import settle
from packetloom.sources.fields import with_fields

#: Header fields that the counters of a tool read, of those it exports.
TOOL_FIELDS = {
    "deep_tcp_flow": [*tcp.TCP_MARKERS, "tcp.window_size", "tcp.window_size_value", "tcp.analysis.bytes_in_flight",
                      "tcp.window_size_scalefactor", "tcp.options.mss_val"],
    "deep_udp_flow": ["dns.id", "dns.flags.response", "dns.flags.rcode", "bootp.id", "bootp.option.dhcp", "udp.checksum.status"],
    "deep_esp_flow": ["udp.srcport", "udp.dstport", "ip.flags.df", "ip.frag_offset", "ip.dsfield.dscp", "ipv6.tclass.dscp",
                      "ip.len", "ipv6.plen"],
    "deep_tls_flow": [
        "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport", "tcp.analysis.lost_segment", "tcp.analysis.retransmission",
        *[f"{p}.{n}" for p in ("tls", "dtls") for n in (
            "record.content_type", "handshake.type", "handshake.certificate", "alert_message.level", "alert_message.desc",
            *tls.ALGORITHMS)]],
    "deep_smb2_flow": [
        "tcp.analysis.retransmission", "tcp.analysis.lost_segment", "tcp.analysis.zero_window", "smb2.cmd",
        "smb2.flags.response", "smb2.nt_status", "smb2.credit.charge", "smb2.credit.request_response",
        "smb2.credits.requested", "smb2.credits.granted"],
    "deep_rtp_flow": ["rtp.ssrc", "rtp.seq", "frame.time_relative", "_ws.col.Protocol"],
    "deep_ike_flow": ike.FIELDS, "deep_bgp_flow": bgp.FIELDS,
    "deep_macsec_flow": link.MACSEC_FIELDS, "deep_eapol_flow": link.EAPOL_FIELDS,
}
COUNTERS = ["flow_key", "counter", "item", "value"]


class DeepAnswers(NamedTuple):
    """One row for each request, the rows of the pages they ask for, and the counters of their flows and tools."""

    answers: DataFrame
    rows: DataFrame
    counters: DataFrame


def _text(name: str, df: DataFrame) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.array_join(F.col(name).cast("array<string>"), ",") if kind == "array" else F.col(name).cast("string")


def _melted(df: DataFrame, item: Column | None = None, leave: tuple[str, ...] = ()) -> DataFrame:
    """Counter columns as rows; what is null is left out."""
    item = F.lit(None).cast("string") if item is None else item
    names = [n for n in df.columns if n != "flow_key" and n not in leave]
    return df.select("flow_key", item.alias("item"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("counter"), _text(n, df).alias("value")) for n in names]))).where(
            "value IS NOT NULL").select(*COUNTERS)


def _listed(df: DataFrame, counter: Column, item: Column, n: str = "n") -> DataFrame:
    return df.select("flow_key", counter.alias("counter"), item.alias("item"), F.col(n).cast("string").alias("value"))


def _rows(fr: DataFrame, name: str) -> DataFrame:
    return _melted(fr.groupBy("flow_key").agg(F.count(F.lit(1)).alias(name)))


def tcp_counters(fr: DataFrame, threshold_ms: float) -> list[DataFrame]:
    return [_listed(tcp.tcp_marker_counts(fr), F.col("field"), F.lit(None).cast("string")), _melted(tcp.tcp_window_stats(fr))]


def rtp_counters(fr: DataFrame, threshold_ms: float) -> list[DataFrame]:
    streams = rtp.streams_of(rtp.header_stream_rows(fr), threshold_ms)
    return [_rows(fr, "rtp_packets"), _melted(streams, F.concat_ws(" ", "direction", "rtp_ssrc"), ("direction", "rtp_ssrc"))]


def ike_counters(fr: DataFrame, threshold_ms: float) -> list[DataFrame]:
    headers = fr.withColumn("ike", ike.ike_metadata()).withColumns({
        "src_ip": F.col("src"), "src_port": F.expr("try_cast(`udp.srcport` AS int)")})
    session = F.concat_ws(" ", F.col("version").cast("string"), F.coalesce("initiator_spi", F.lit("-")),
                          F.coalesce("responder_spi", F.lit("-")))
    counted = ike.ike_counts(headers)
    return [_rows(headers.where("ike IS NOT NULL"), "ike_packets"), _melted(ike.ike_sessions(headers), session, (*ike.SESSION, "first_at")),
            _listed(counted, F.col("kind"), F.concat_ws(" ", session, F.col("value")))]


def bgp_counters(fr: DataFrame, threshold_ms: float) -> list[DataFrame]:
    rows = fr.withColumn("bgp_fields", bgp.field_map(bgp.FIELDS))
    values = bgp.field_values(rows, "bgp_fields", ["flow_key"]).groupBy("flow_key", "field", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return [_rows(fr, "bgp_packets"), _listed(values, F.col("field"), F.col("value"))]


def link_counters(protocol: str, names: list[str]):
    def count(fr: DataFrame, threshold_ms: float) -> list[DataFrame]:
        rows = fr.withColumn(link.COLUMNS[protocol], bgp.field_map(names))
        ranges = link.link_ranges(rows, protocol)
        return [_rows(fr, "packets"), _listed(link.link_counts(rows, protocol), F.col("field"), F.col("value")),
                _listed(ranges, F.col("field"), F.lit("low"), "low"), _listed(ranges, F.col("field"), F.lit("high"), "high")]
    return count


def _wide(hook):
    return lambda fr, threshold_ms: [_melted(hook(fr))]


TOOL_COUNTERS = {
    "deep_tcp_flow": tcp_counters, "deep_udp_flow": _wide(tcp.udp_counts), "deep_esp_flow": _wide(esp.esp_counts),
    "deep_tls_flow": _wide(tls.tls_counts), "deep_smb2_flow": _wide(smb.smb2_credits), "deep_rtp_flow": rtp_counters,
    "deep_ike_flow": ike_counters, "deep_bgp_flow": bgp_counters,
    "deep_macsec_flow": link_counters("MACSEC", link.MACSEC_FIELDS),
    "deep_eapol_flow": link_counters("EAPOL", link.EAPOL_FIELDS),
}


def tool_counters(rows: DataFrame, threshold_ms: float = DEFAULT_PAUSE_MS, tools: list[str] | None = None) -> DataFrame:
    """(flow, tool, counter, item, value) of header rows that carry their tool."""
    parts = [part.withColumn("tool", F.lit(tool)) for tool in tools or TOOL_COUNTERS
             for part in TOOL_COUNTERS[tool](rows.where(F.col("tool") == tool), threshold_ms)]
    return reduce(DataFrame.unionByName, parts).select("flow_key", "tool", "counter", "item", "value")


def deep_query(requests: DataFrame, flows: DataFrame, headers: DataFrame, limit: int = PAGE_ROWS,
               threshold_ms: float = DEFAULT_PAUSE_MS, tools: list[str] | None = None) -> DeepAnswers:
    """Answer requests (request_id, tool, flow_id, offset) over flows with ids and their header rows.

    The status is `rejected` for a tool outside the list, `not_found` for an unknown flow, `skipped` where the tool does
    not fit the flow's transport, `empty` where the flow has no rows of the tool, else `ok`. `tools` names the tools
    that may be asked for; by default all.
    """
    c, allowed = F.col, list(tools or TOOL_COUNTERS)
    known = requests.join(flows.select("flow_id", "flow_key", "protocol"), "flow_id", "left")
    fits = reduce(Column.__or__, [(c("tool") == t) & c("protocol").isin(TOOL_TRANSPORTS[t]) for t in allowed])
    judged = settle(known.withColumn("status", F.when(~c("tool").isin(allowed), "rejected").when(
        c("flow_key").isNull(), "not_found").when(~fits, "skipped").otherwise("ok")).drop("protocol"), "requests")
    # at most one entry a flow, with a name for each tool
    asked = judged.where("status = 'ok'").groupBy("flow_key").agg(F.collect_set("tool").alias("asked"))
    has_ports = c("port_a").isNotNull() | c("port_b").isNotNull()
    listed = F.array_compact(F.array(*[F.when(
        c("protocol").isin(TOOL_TRANSPORTS[t]) & tool_predicate(t, c("decoded_protocols"), has_ports), F.lit(t))
        for t in allowed]))
    fields = sorted({n for t in allowed for n in TOOL_FIELDS[t]})
    kept = headers.withColumn("tools", listed).select("tools", *[
        field(n) for n in headers.columns if "." not in n or n in fields])
    stored = settle(kept.join(asked, "flow_key").withColumn("tools", F.array_intersect("tools", "asked")).where(
        F.size("tools") > 0).drop("asked"), "tool_rows")
    rows = with_fields(stored.withColumn("tool", F.explode("tools")).drop("tools"), fields)

    totals = rows.groupBy("flow_key", "tool").agg(F.count(F.lit(1)).alias("n"))
    reasons = deep.flow_reasons(flows)
    answered = judged.join(totals, ["flow_key", "tool"], "left").join(reasons, ["flow_key", "tool"], "left").withColumn(
        "total", F.when(c("status") == "ok", F.coalesce("n", F.lit(0))))
    page = F.struct(*page_descriptor(c("total"), c("offset"), F.lit(limit).cast("bigint")))
    answers = answered.withColumn("page", F.when(c("total").isNotNull(), page)).select(
        "request_id", "tool", "flow_id", "flow_key", F.when(c("total") == 0, "empty").otherwise(c("status")).alias("status"),
        F.when(c("total") > 0, c("reason")).alias("reason"), "page.*")
    numbered = row_positions(rows.select("flow_key", "tool", "frame_number"), ["flow_key", "tool"], "frame_number", "position")
    targets = judged.where("status = 'ok'").select("request_id", "flow_key", "tool", "offset")
    shown = page_rows(numbered, targets, ["flow_key", "tool"], limit).select(
        "request_id", "flow_key", "tool", "position", "frame_number")
    return DeepAnswers(answers, shown, tool_counters(rows, threshold_ms, allowed))
