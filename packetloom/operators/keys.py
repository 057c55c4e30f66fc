"""Which packets count, what flow they belong to, and in which direction they run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.parse import filled, marked, safe_int

LINK_PROTOCOLS = ["MACSEC", "EAPOL"]
# Transports in the order they are looked for.
TRANSPORTS = ["tcp", "esp", "udp", "ah", "gre", "icmp", "icmpv6"]
# Columns that an inner protocol of a link-security frame would fill.
INNER_PREFIXES = ("dns_", "dhcp_", "tls_", "sip_", "smb_", "rtp_", "esp_")
INNER_COLUMNS = {"src_ip", "dst_ip", "src_port", "dst_port", "ike", "bgp_fields", "srtp", "issue_tags",
                 "rtt_seconds", "initial_rtt_seconds"}
FLOW_COLUMNS = ["flow_key", "address_type", "link_type", "vlan_ids", "protocol", "endpoint_a",
                "port_a", "endpoint_b", "port_b"]


def transport(layers: Column, highest: Column) -> Column:
    """First known transport among the layer names, else the highest layer."""
    lowered = F.transform(layers, lambda n: F.lower(n))
    result = F
    for name in TRANSPORTS:
        result = result.when(F.array_contains(lowered, name), F.lit(name.upper()))
    return result.otherwise(F.upper(F.coalesce(highest, F.lit("UNKNOWN"))))


def link_protocol(layers: Column) -> Column:
    lowered = F.transform(layers, lambda n: F.lower(n))
    return (F.when(F.array_contains(lowered, "macsec"), "MACSEC")
            .when(F.array_contains(lowered, "eapol"), "EAPOL"))


def link_override(df: DataFrame, layers: str = "decoded_protocols") -> DataFrame:
    """MACsec, then EAPOL, win over IP: MAC endpoints, no addresses, no ports, and nothing of the
    protocols inside; lists become empty and flags false."""
    link = link_protocol(F.col(layers))

    def nothing(kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.array().cast(kind)
        return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)

    cleared = {f.name: F.when(link.isNull(), F.col(f.name)).otherwise(nothing(f.dataType))
               for f in df.schema if f.name.startswith(INNER_PREFIXES) or f.name in INNER_COLUMNS}
    return df.withColumns({
        **cleared,
        "protocol": F.coalesce(link, F.col("protocol")),
        "link_type": F.when(link.isNotNull(), F.col("link_type")),
        "src_mac": F.lower("src_mac"), "dst_mac": F.lower("dst_mac"),
    })


def ports(tcp: tuple[Column, Column], udp: tuple[Column, Column], protocol: Column
          ) -> tuple[Column, Column]:
    """Source and destination port; ESP carried in UDP keeps the UDP ports."""
    return tuple(
        F.when(protocol == "TCP", safe_int(t)).when(protocol.isin("UDP", "ESP"), safe_int(u))
        .cast("int") for t, u in zip(tcp, udp))


def source_endpoint() -> Column:
    return F.when(F.col("protocol").isin(LINK_PROTOCOLS), F.col("src_mac")).otherwise(
        F.col("src_ip"))


def destination_endpoint() -> Column:
    return F.when(F.col("protocol").isin(LINK_PROTOCOLS), F.col("dst_mac")).otherwise(
        F.col("dst_ip"))


def analysable(df: DataFrame) -> DataFrame:
    """Packets with both addresses, or both MAC addresses for link security."""
    return df.where(F.coalesce(source_endpoint() != "", F.lit(False))
                    & F.coalesce(destination_endpoint() != "", F.lit(False)))


def endpoint_label(endpoint: Column, port: Column) -> Column:
    return F.concat_ws(":", endpoint, port.cast("string"))


def flow_label(protocol: Column, a: Column, port_a: Column, b: Column, port_b: Column) -> Column:
    return F.concat(protocol, F.lit(" "), endpoint_label(a, port_a), F.lit(" <-> "),
                    endpoint_label(b, port_b))


def direction_label(src: Column, src_port: Column, dst: Column, dst_port: Column) -> Column:
    return F.concat(endpoint_label(src, src_port), F.lit(" -> "), endpoint_label(dst, dst_port))


def flow_key_text() -> Column:
    """One text for the key columns of a flow, fresh or saved."""
    c = F.col
    link = c("protocol").isin(LINK_PROTOCOLS)

    def port_text(name: str) -> Column:
        return F.coalesce(c(name).cast("string"), F.lit(""))

    return F.concat_ws(
        "|", c("protocol"), c("endpoint_a"), port_text("port_a"), c("endpoint_b"), port_text("port_b"),
        F.when(link, F.coalesce(c("link_type"), F.lit(""))),
        F.when(link, F.array_join(c("vlan_ids").cast("array<string>"), ",")))


def with_flow(df: DataFrame) -> DataFrame:
    """Add the unordered endpoint pair, one text key for it, and the direction flag."""
    c = F.col
    link = c("protocol").isin(LINK_PROTOCOLS)
    source_first = F.struct(c("src_endpoint"), F.coalesce(c("src_port"), F.lit(-1))) <= F.struct(
        c("dst_endpoint"), F.coalesce(c("dst_port"), F.lit(-1)))

    ended = df.withColumns({"src_endpoint": source_endpoint(),
                            "dst_endpoint": destination_endpoint()})
    paired = ended.withColumns({
        "endpoint_a": F.when(source_first, c("src_endpoint")).otherwise(c("dst_endpoint")),
        "endpoint_b": F.when(source_first, c("dst_endpoint")).otherwise(c("src_endpoint")),
        "port_a": F.when(source_first, c("src_port")).otherwise(c("dst_port")),
        "port_b": F.when(source_first, c("dst_port")).otherwise(c("src_port")),
        "address_type": F.when(link, "mac").otherwise("ip"),
        "link_type": F.when(link, c("link_type")),
        "vlan_ids": F.when(link, F.coalesce(c("vlan_ids"), F.array().cast("array<int>"))).otherwise(
            F.array().cast("array<int>")),
    })
    return paired.withColumns({
        "flow_key": flow_key_text(),
        "a_to_b": F.coalesce(
            (c("src_endpoint") == c("endpoint_a"))
            & (c("port_a").isNull() | (c("src_port") == c("port_a"))), F.lit(False)),
    })


def tcp_issue_tags(present: dict[str, Column]) -> Column:
    """Tags of one TCP packet from its analysis markers, given as name → marker present."""
    tags = [
        ("tcp_retransmission", present["retransmission"] | present["fast_retransmission"]),
        ("tcp_out_of_order", present["out_of_order"]),
        ("tcp_duplicate_ack", present["duplicate_ack"]),
        ("tcp_lost_segment", present["lost_segment"]),
        ("tcp_zero_window", present["zero_window"] | present["zero_window_probe"]),
        ("tcp_reset", present["reset"]),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tags]))


def marker(value: Column) -> Column:
    """An analysis marker counts unless it reads as zero or false; an empty text is a marker too."""
    return F.coalesce(marked(value) | (value == ""), F.lit(False))


def tls_issue_tags(level: Column, description: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(level, F.lit("")), F.lit(" "),
                            F.coalesce(description, F.lit(""))))
    alert = filled(level) | filled(description)
    return F.array_compact(F.array(
        F.when(alert, F.lit("tls_alert")),
        F.when(alert & (text.contains("fatal") | text.startswith("2")), F.lit("tls_fatal_alert"))))
