"""Packet and flow selection by endpoint, peer, protocol, port and direction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.protocols import canonical_text, expanded, shows_any

MAC = r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"
PROTOCOL_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def _listed(value) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, Iterable) and not isinstance(value, str) else [value]


def check_protocol_name(text: str) -> str:
    if not PROTOCOL_NAME.fullmatch(text):
        raise ValueError(f"not a protocol name: {text!r}")
    return text


@dataclass(frozen=True)
class Ends:
    """The columns one direction is tested on."""

    src: Column
    dst: Column
    src_port: Column
    dst_port: Column
    shows: Callable[[list[str]], Column]
    observed: Column


def _is_any(actual: Column, wanted: list) -> Column:
    return F.coalesce(actual.isin(wanted), F.lit(False))


def _address_in(ends: Ends, actual: Column, wanted: list[str]) -> Column:
    """MAC addresses compare without case; the source address decides whether it is one."""
    return F.when(ends.src.rlike(MAC), _is_any(F.lower(actual), [w.lower() for w in wanted])
                  ).otherwise(_is_any(actual, wanted))


def host(ends: Ends, wanted: list[str]) -> Column:
    return _address_in(ends, ends.src, wanted) | _address_in(ends, ends.dst, wanted)


def opposite(ends: Ends, hosts: list[str], peers: list[str]) -> Column:
    return ((_address_in(ends, ends.src, hosts) & _address_in(ends, ends.dst, peers))
            | (_address_in(ends, ends.dst, hosts) & _address_in(ends, ends.src, peers)))


def protocol(ends: Ends, names: list[str]) -> Column:
    return ends.shows([canonical_text(check_protocol_name(n)) for n in names])


def port(ends: Ends, numbers: list[int]) -> Column:
    return _is_any(ends.src_port, numbers) | _is_any(ends.dst_port, numbers)


@dataclass(frozen=True)
class FlowFilter:
    """Options of one selection. Values inside an option are alternatives; options combine with AND,
    or with OR when `match_any` is set. No option selects everything."""

    host: object = None
    peer: object = None
    protocol: object = None
    port: object = None
    src: object = None
    dst: object = None
    src_port: object = None
    dst_port: object = None
    match_any: bool = False

    @property
    def is_directional(self) -> bool:
        return any(_listed(v) for v in (self.src, self.dst, self.src_port, self.dst_port))

    def condition(self, ends: Ends) -> Column:
        hosts, peers = _listed(self.host), _listed(self.peer)
        checks = []
        if hosts:
            checks.append(host(ends, hosts))
        if peers:
            checks.append(host(ends, peers))
        if hosts and peers and not self.match_any:
            checks.append(opposite(ends, hosts, peers))
        if _listed(self.protocol):
            checks.append(protocol(ends, _listed(self.protocol)))
        if _listed(self.port):
            checks.append(port(ends, _listed(self.port)))
        for actual, wanted in ((ends.src, self.src), (ends.dst, self.dst)):
            if _listed(wanted):
                checks.append(ends.observed & _address_in(ends, actual, _listed(wanted)))
        for actual, wanted in ((ends.src_port, self.src_port), (ends.dst_port, self.dst_port)):
            if _listed(wanted):
                checks.append(ends.observed & _is_any(actual, _listed(wanted)))
        if not checks:
            return F.lit(True)
        return reduce(lambda a, b: a | b if self.match_any else a & b, checks)


def filter_packets(pk: DataFrame, wanted: FlowFilter) -> DataFrame:
    """Packets with flow columns that match."""
    c = F.col
    return pk.where(wanted.condition(Ends(
        c("src_endpoint"), c("dst_endpoint"), c("src_port"), c("dst_port"), shows_any,
        F.lit(True))))


def filter_flows(fl: DataFrame, wanted: FlowFilter) -> DataFrame:
    """Whole flows with a matching direction.

    Directional options must hold together in one direction that was observed, on the protocol names
    recorded for it. `fl` carries the protocol sets of the flow.
    """
    c = F.col
    strict = wanted.is_directional and not wanted.match_any

    def names(column: str) -> Callable[[list[str]], Column]:
        recorded = expanded(F.concat(F.array(c("protocol")), F.coalesce(
            c(column), F.array().cast("array<string>"))))
        return lambda wanted: F.arrays_overlap(recorded, F.array(*[F.lit(w) for w in wanted]))

    def one_way(a: str, b: str, way: str) -> Column:
        observed = c(f"{way}_packets") > 0
        matched = wanted.condition(Ends(
            c(f"endpoint_{a}"), c(f"endpoint_{b}"), c(f"port_{a}"), c(f"port_{b}"),
            names(f"protocols_{way}" if strict else "decoded_protocols"), observed))
        return matched & observed if strict else matched

    return fl.where(one_way("a", "b", "a_to_b") | one_way("b", "a", "b_to_a"))


def endpoint_pair(a: str, port_a: int | None, b: str, port_b: int | None, *,
                  src: Column, dst: Column, src_port: Column | None = None,
                  dst_port: Column | None = None) -> Column:
    """Rows between two endpoints in either direction; only known ports are bound."""
    def one_way(s: str, sp: int | None, d: str, dp: int | None) -> Column:
        terms = [src == s, dst == d]
        if src_port is not None and sp is not None:
            terms.append(src_port == sp)
        if dst_port is not None and dp is not None:
            terms.append(dst_port == dp)
        return reduce(lambda x, y: x & y, terms)

    return F.coalesce(one_way(a, port_a, b, port_b) | one_way(b, port_b, a, port_a), F.lit(False))


# The rows a deep tool reads, by layers that must and must not be present.
TOOL_LAYERS = {
    "deep_tcp_flow": (["TCP"], [], []),
    "deep_udp_flow": (["UDP"], [], ["ESP"]),
    "deep_esp_flow": (["ESP"], [], []),
    "deep_tls_flow": ([], ["TLS", "DTLS"], []),
    "deep_smb2_flow": (["SMB2"], [], []),
    "deep_rtp_flow": (["RTP", "UDP"], [], []),
    "deep_ike_flow": (["ISAKMP"], [], ["ESP"]),
    "deep_bgp_flow": (["BGP"], [], []),
    "deep_macsec_flow": (["MACSEC"], [], []),
    "deep_eapol_flow": (["EAPOL"], [], []),
}
TOOL_TRANSPORTS = {
    "deep_tcp_flow": ["TCP"], "deep_udp_flow": ["UDP"], "deep_esp_flow": ["ESP"],
    "deep_tls_flow": ["TCP", "UDP"], "deep_smb2_flow": ["TCP"], "deep_rtp_flow": ["UDP"],
    "deep_ike_flow": ["UDP"], "deep_bgp_flow": ["TCP"], "deep_macsec_flow": ["MACSEC"],
    "deep_eapol_flow": ["EAPOL"],
}


def tool_predicate(tool: str, layers: Column, has_ports: Column | None = None) -> Column:
    """Rows of a tool by decoded layers. A flow of bare ESP, without ports, excludes UDP."""
    every, either, none = TOOL_LAYERS[tool]

    def has(name: str) -> Column:
        return F.array_contains(layers, name)

    terms = [has(n) for n in every] + [~has(n) for n in none]
    if either:
        terms.append(F.arrays_overlap(layers, F.array(*[F.lit(n) for n in either])))
    if tool == "deep_esp_flow" and has_ports is not None:
        terms.append(has_ports | ~has("UDP"))
    return reduce(lambda a, b: a & b, terms)


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")


def flows_by_phone(flow_table: DataFrame, sip_packets: DataFrame, number: str) -> DataFrame:
    """Flows with the wanted digits in a caller, callee or participant; no digits keep all."""
    wanted = re.sub(r"\D", "", number)
    if not wanted:
        return flow_table
    calling = sip_packets.where(
        digits(F.col("sip_from")).contains(wanted) | digits(F.col("sip_to")).contains(wanted))
    return flow_table.join(calling.select("flow_key").distinct(), "flow_key", "left_semi")


def flows_by_saved_phone(flow_table: DataFrame, number: str, calls: DataFrame | None = None,
                         participants: DataFrame | None = None) -> DataFrame:
    """Flows with the wanted digits in the caller or callee of a stored call (flow_key, caller, callee) or in a stored
    participant (flow_key, participant); no packets are needed. No digits keep all flows."""
    wanted = re.sub(r"\D", "", number)
    if not wanted:
        return flow_table
    named = [table.select("flow_key", F.col(column).alias("name")) for table, column in (
        (calls, "caller"), (calls, "callee"), (participants, "participant")) if table is not None]
    if not named:
        return flow_table.where(F.lit(False))
    found = reduce(DataFrame.unionByName, named).where(digits(F.col("name")).contains(wanted))
    return flow_table.join(found.select("flow_key").distinct(), "flow_key", "left_semi")
