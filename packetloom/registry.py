"""Protocols by name: their records, header-row tools and detail tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from packetloom.operators import deep
from packetloom.protocols import bgp, dhcp, dns, esp, ike, link, rtp, sip, smb, tcp, tls


@dataclass(frozen=True)
class Protocol:
    """What the library knows about one protocol. Hooks take and return DataFrames or columns."""

    name: str
    display_name: str
    record: Callable[..., DataFrame] | None = None
    detail: str | None = None
    metadata_key: str | None = None
    tools: tuple[str, ...] = ()
    counters: tuple[Callable[..., DataFrame], ...] = ()
    fields: tuple[str, ...] = ()
    reason: Callable[[str], Column] | None = None


_registered: dict[str, Protocol] = {}


def register(protocol: Protocol) -> Protocol:
    """Add a protocol; a name or tool may be registered once, and every tool needs its hooks."""
    if protocol.name in _registered:
        raise ValueError(f"protocol {protocol.name} is registered twice")
    if len(protocol.tools) != len(protocol.counters):
        raise ValueError(f"protocol {protocol.name} needs one counter hook for each tool")
    if protocol.tools and protocol.reason is None:
        raise ValueError(f"protocol {protocol.name} has a tool without a reason hook")
    for tool in protocol.tools:
        if protocol_of_tool(tool):
            raise ValueError(f"tool {tool} is registered twice")
    _registered[protocol.name] = protocol
    return protocol


def lookup(name: str) -> Protocol:
    return _registered[name]


def protocol_names() -> set[str]:
    return set(_registered)


def tool_names() -> set[str]:
    return {tool for p in _registered.values() for tool in p.tools}


def protocol_of_tool(tool: str) -> Protocol | None:
    return next((p for p in _registered.values() if tool in p.tools), None)


def deep_counters(headers: DataFrame, tool: str) -> DataFrame:
    """Counters of a tool over all its rows, per flow."""
    protocol = protocol_of_tool(tool)
    if protocol is None:
        raise ValueError(f"not a registered tool: {tool}")
    return protocol.counters[protocol.tools.index(tool)](deep.tool_rows(headers, tool))


def _rows(name: str) -> Callable[[DataFrame], DataFrame]:
    def count(headers: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        return headers.groupBy("flow_key").agg(F.count(F.lit(1)).alias(name))
    return count


def _tool(name: str, display: str, counter: Callable[..., DataFrame], **rest) -> Protocol:
    tool = rest.pop("tool", f"deep_{name}_flow")
    return Protocol(name=name, display_name=display, tools=(tool,), counters=(counter,),
                    reason=deep.deep_reason, **rest)


for _protocol in (
    _tool("bgp", "BGP", _rows("bgp_packets"), record=bgp.bgp_summary, detail="detail_bgp",
          metadata_key="bgp", fields=tuple(bgp.FIELDS)),
    _tool("macsec", "MACSEC", _rows("packets"), record=link.link_summary, detail="detail_link",
          metadata_key="macsec", fields=tuple(link.LINK_FIELDS + link.MACSEC_FIELDS)),
    _tool("eapol", "EAPOL", _rows("packets"), record=link.link_summary, detail="detail_link",
          metadata_key="eapol", fields=tuple(link.LINK_FIELDS + link.EAPOL_FIELDS)),
    _tool("ike", "IKE", _rows("ike_packets"), record=ike.ike_sessions, detail="detail_ike",
          metadata_key="ike", fields=tuple(ike.FIELDS)),
    _tool("rtp", "RTP", _rows("rtp_packets"), record=rtp.rtp_streams, detail="detail_rtp",
          metadata_key="rtp", fields=tuple(rtp.FIELDS)),
    _tool("tcp", "TCP", tcp.tcp_marker_counts, metadata_key="transport",
          fields=tuple(tcp.TCP_FIELDS)),
    _tool("udp", "UDP", tcp.udp_counts, metadata_key="transport", fields=tuple(tcp.UDP_FIELDS)),
    _tool("tls", "TLS/DTLS", tls.tls_counts, record=tls.tls_summary, detail="detail_tls",
          metadata_key="tls", fields=tuple(tls.FIELDS)),
    _tool("smb", "SMB", smb.smb2_credits, tool="deep_smb2_flow", record=smb.smb_summary,
          detail="detail_smb", metadata_key="smb", fields=tuple(smb.FIELDS)),
    Protocol("sip", "SIP", sip.sip_calls, "detail_sip", "sip"),
    Protocol("dns", "DNS", dns.dns_summary, "detail_dns", "dns"),
    Protocol("dhcp", "DHCP", dhcp.dhcp_summary, "detail_dhcp", "dhcp"),
    _tool("esp", "ESP/IPsec", esp.esp_counts, record=esp.esp_sequences, metadata_key="esp",
          fields=tuple(esp.FIELDS)),
):
    register(_protocol)
