"""TCP and UDP counters over header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled, marked, row_int
from packetloom.schemas import field

# Analysis markers, and exported header fields of the TCP and UDP tools.
TCP_MARKERS = [
    "tcp.analysis.retransmission", "tcp.analysis.fast_retransmission",
    "tcp.analysis.lost_segment", "tcp.analysis.out_of_order", "tcp.analysis.duplicate_ack",
    "tcp.analysis.zero_window", "tcp.analysis.zero_window_probe", "tcp.analysis.window_update",
    "tcp.analysis.window_full", "tcp.analysis.window_full_segment", "tcp.options.mss.absent",
    "tcp.options.mss.present", "tcp.options.mss.exceeded",
]
TCP_FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "ip.src", "ipv6.src", "ip.dst",
    "ipv6.dst", "tcp.srcport", "tcp.dstport", "tcp.seq", "tcp.ack", "tcp.len",
    "tcp.window_size_value", "tcp.window_size", "tcp.window_size_scalefactor", "tcp.flags",
    "tcp.flags.syn", "tcp.flags.ack", "tcp.flags.fin", "tcp.flags.reset", "tcp.flags.push",
    "tcp.options.mss_val", "tcp.options.mss.absent", "tcp.options.mss.present",
    "tcp.options.mss.exceeded", "tcp.analysis.retransmission", "tcp.analysis.fast_retransmission",
    "tcp.analysis.lost_segment", "tcp.analysis.out_of_order", "tcp.analysis.duplicate_ack",
    "tcp.analysis.zero_window", "tcp.analysis.zero_window_probe", "tcp.analysis.window_update",
    "tcp.analysis.window_full", "tcp.analysis.window_full_segment", "tcp.analysis.bytes_in_flight",
    "tcp.analysis.initial_rtt",
]
UDP_FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "ip.src", "ipv6.src", "ip.dst",
    "ipv6.dst", "udp.srcport", "udp.dstport", "udp.length", "udp.checksum",
    "udp.checksum.status", "dns.id", "dns.flags.response", "dns.qry.name", "dns.qry.type",
    "dns.flags.rcode", "dns.resp.name", "dns.a", "dns.aaaa", "dns.cname", "dns.time", "bootp.id",
    "bootp.option.dhcp", "bootp.hw.mac_addr", "bootp.option.hostname",
    "bootp.option.requested_ip_address", "bootp.ip.your", "bootp.option.dhcp_server_id",
    "bootp.option.ip_address_lease_time",
]


def tcp_marker_counts(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """(flow, field, n) of the markers that are set; "0" and "False" are not."""
    present = F.array_compact(F.array(*[F.when(marked(field(n)), F.lit(n)) for n in TCP_MARKERS]))
    return fr.select(*keys, F.explode(present).alias("field")).groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("n"))


def tcp_window_stats(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """Window, flight and segment-size ranges. Scale factors and sizes are 16-bit sets."""
    def spread(name: str, out: str) -> list[Column]:
        value = row_int(field(name))
        return [F.min(value).alias(f"{out}_min"), F.max(value).alias(f"{out}_max")]

    def values(name: str) -> Column:
        return F.array_sort(F.collect_set(row_int(field(name))))

    return fr.groupBy(*keys).agg(
        *spread("tcp.window_size", "advertised_window"),
        *spread("tcp.window_size_value", "raw_advertised_window"),
        F.max(row_int(field("tcp.analysis.bytes_in_flight"))).alias("bytes_in_flight_max"),
        values("tcp.window_size_scalefactor").alias("window_scale_factors"),
        values("tcp.options.mss_val").alias("mss_values"),
        *spread("tcp.options.mss_val", "mss"))


def udp_counts(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """DNS, DHCP and checksum counters of UDP header rows."""
    code = field("dns.flags.rcode")
    checksum = F.lower(field("udp.checksum.status"))
    return fr.groupBy(*keys).agg(
        F.count_if(filled(field("dns.id"))).alias("dns_packets"),
        F.count_if(field("dns.flags.response").isin("1", "True", "true")).alias("dns_responses"),
        F.count_if(filled(code) & ~code.startswith("0")).alias("dns_error_responses"),
        F.count_if(filled(field("bootp.id")) | filled(field("bootp.option.dhcp"))).alias(
            "dhcp_packets"),
        F.count_if(filled(checksum) & ~checksum.isin("1", "good", "unverified")).alias(
            "udp_bad_checksum"))
