"""Flow reports: one wide row per flow, and child tables joined by flow id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.protocols import packet_protocols
from packetloom.operators import metrics, rollup
from packetloom.operators.keys import endpoint_label, flow_label
from packetloom.protocols import bgp, dhcp, dns, esp, ike, link, rtp, sip, smb, tls
from packetloom.settings import settle

# Registry name of a protocol that goes by another one in a packet.
REGISTRY_NAMES = {"isakmp": "ike", "ikev1": "ike", "ikev2": "ike", "srtp": "rtp", "dtls": "tls",
                  "ssl": "tls", "smb2": "smb", "bootp": "dhcp", "mka": "eapol", "eap": "eapol"}
LIKELY_TLS_PORTS = [443, 853, 8443]


def hinted_flows(pk: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows with everything the hints look at."""
    return metrics.with_hint_inputs(
        flows, esp.esp_sequences(pk), smb.transfers_by_flow(smb.smb_transfer_ops(pk)),
        rollup.max_interarrival(pk))


def chosen_flows(ranked: DataFrame, k: int, include_id: int | None = None) -> DataFrame:
    """The first k flows and one more by id, stored: a report refers to them many times over."""
    return settle(rollup.select_flows(ranked, k, include_id), "chosen")


def flow_report(pk: DataFrame, ranked: DataFrame, k: int, include_id: int | None = None) -> DataFrame:
    """Rounded metrics and hints of the first k flows and one more by id.

    Only packets of the chosen flows reach the ordered passes.
    """
    c = F.col
    chosen = chosen_flows(ranked, k, include_id)
    own = pk.join(chosen.select("flow_key"), "flow_key", "left_semi")
    rows = hinted_flows(own, chosen)
    rates = {**metrics.retransmission_rates(), **metrics.loss_rates(), **metrics.out_of_order()}
    counted = rates.pop("out_of_order_count")
    return rows.select(
        "flow_id", "flow_key",
        flow_label(c("protocol"), c("endpoint_a"), c("port_a"), c("endpoint_b"), c("port_b")).alias(
            "flow_label"),
        "address_type", "link_type", "vlan_ids", "protocol", "endpoint_a", "port_a", "endpoint_b",
        "port_b", "packet_count", "byte_count", "first_seen", "last_seen",
        F.round("duration_s", 3).alias("duration_s"),
        *[F.struct(f"a_to_b_{n}", f"b_to_a_{n}").alias(f"{n}_by_direction")
          for n in ("packets", "bytes")],
        F.struct(*[v.alias(n) for n, v in metrics.packet_rates().items()]).alias("packet_rates"),
        F.struct(*[v.alias(n) for n, v in metrics.throughput_mbps().items()]).alias("throughput"),
        *[F.round(v, 4).alias(n) for n, v in rates.items()], counted.alias("out_of_order_count"),
        F.round("initial_rtt_ms", 3).alias("initial_rtt_ms"),
        F.struct(*[c(t) for t in rollup.ISSUE_TAGS if t.startswith("tcp_")]).alias(
            "tcp_issue_counts"),
        metrics.is_one_way().alias("one_way"),
        metrics.diagnostic_hints().alias("diagnostic_hints"))


def report_children(pk: DataFrame, chosen: DataFrame) -> dict[str, DataFrame]:
    """Lists and sub-records of the chosen flows as tables keyed by flow id; lists are not cut."""
    own = pk.join(chosen.select("flow_key"), "flow_key", "left_semi")
    ids = chosen.select("flow_key", "flow_id")
    tables = {
        "names": rollup.flow_names(own), "redirects": rollup.redirect_locations(own),
        "issues": rollup.flow_issue_counts(own), "esp_sequences": esp.esp_sequences(own),
        "esp_gaps": esp.esp_gaps(own), "rtp_streams": rtp.rtp_streams(own),
        "dns": dns.dns_counts(own), "dns_answers": dns.dns_answer_list(own),
        "dhcp": dhcp.dhcp_summary(own), "sip_calls": sip.sip_calls(own),
        "sip_trace": sip.sip_trace(own), "smb": smb.smb_summary(own),
        "tls_snis": tls.tls_sni_list(own), "tls_alerts": tls.tls_alerts(own),
        "tls_certificates": tls.tls_certificates(own), "ike_sessions": ike.ike_sessions(own),
        "bgp": bgp.bgp_summary(own), "macsec": link.link_counts(own, "MACSEC"),
        "eapol": link.link_counts(own, "EAPOL"),
    }
    return {name: table.join(ids, "flow_key") for name, table in tables.items()}


def flow_throughput(ranked: DataFrame, flow_id: int, direction: str | None = None) -> DataFrame:
    """Average throughput of one flow, both ways or one of `a_to_b` and `b_to_a`."""
    c = F.col
    wanted = [direction] if direction else ["a_to_b", "b_to_a"]
    ends = {"a_to_b": ("endpoint_a", "endpoint_b"), "b_to_a": ("endpoint_b", "endpoint_a")}
    rates = metrics.throughput_mbps()
    rows = F.array(*[F.struct(
        F.concat(c(ends[w][0]), F.lit(" -> "), c(ends[w][1])).alias("way"),
        rates[f"{w}_mbps"].alias("mbps")) for w in wanted])
    return metrics.with_duration(ranked.where(c("flow_id") == flow_id)).select(
        "flow_id", F.inline(rows))


def _own(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return pk.join(chosen.select("flow_key", "flow_id"), "flow_key")


def _with_ids(table: DataFrame, chosen: DataFrame) -> DataFrame:
    return table.join(chosen.select("flow_key", "flow_id"), "flow_key")


def detail_sip(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    """The calls of each chosen flow, numbered in order."""
    from packetloom.operators.ordered import scan

    calls = scan(sip.sip_calls(_own(pk, chosen)), ["flow_key"], "first_at", position="place")
    return _with_ids(calls, chosen)


def detail_dns(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(dns.dns_summary(_own(pk, chosen)), chosen)


def detail_dhcp(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(dhcp.dhcp_summary(_own(pk, chosen)), chosen)


def detail_smb(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    own = _own(pk, chosen)
    moved = smb.transfers_by_flow(smb.smb_transfer_ops(own))
    return _with_ids(smb.smb_summary(own).join(moved, "flow_key", "left"), chosen)


def detail_rtp(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(rtp.rtp_streams(_own(pk, chosen)), chosen)


def detail_ike(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(ike.ike_sessions(_own(pk, chosen)), chosen)


def detail_bgp(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(bgp.bgp_summary(_own(pk, chosen)), chosen)


def detail_link(pk: DataFrame, chosen: DataFrame, protocol: str) -> DataFrame:
    own = _own(pk, chosen)
    values = link.link_counts(own, protocol).select(
        "flow_key", "field", "value", "n", F.lit(None).cast("bigint").alias("low"),
        F.lit(None).cast("bigint").alias("high"))
    ranges = link.link_ranges(own, protocol).select(
        "flow_key", "field", F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("bigint").alias("n"), "low", "high")
    return _with_ids(values.unionByName(ranges), chosen)


def detail_tls(pk: DataFrame, chosen: DataFrame) -> DataFrame:
    """Certificates per flow, role and endpoint; other flows that show or suggest TLS once."""
    c = F.col
    certified = tls.tls_certificates(_own(pk, chosen)).groupBy(
        "flow_key", "role", endpoint_label(c("presenter_ip"), c("presenter_port")).alias("endpoint")
    ).agg(F.count(F.lit(1)).alias("certificates"))
    likely = (c("protocol") == "TCP") & (F.coalesce(c("port_a").isin(LIKELY_TLS_PORTS), F.lit(False))
                                         | F.coalesce(c("port_b").isin(LIKELY_TLS_PORTS), F.lit(False)))
    bare = chosen.where((c("tls_certified") == 0) & (
        (c("tls_snis") > 0) | (c("tls_alerts") > 0) | likely)).select(
            "flow_key", F.lit("-").alias("role"), F.concat(
                endpoint_label(c("endpoint_a"), c("port_a")), F.lit(" <-> "),
                endpoint_label(c("endpoint_b"), c("port_b"))).alias("endpoint"),
            F.lit(0).cast("bigint").alias("certificates"))
    return _with_ids(certified.unionByName(bare), chosen)


def detail_evidence(windows: DataFrame, chosen: DataFrame) -> DataFrame:
    return _with_ids(windows, chosen).select(
        "flow_id", "tool", "sample_offset", "issue_packet_index", "frame_number", "issue_count",
        F.array_join("reasons", "; ").alias("reasons"))


def protocols_present(pk: DataFrame) -> DataFrame:
    """Registry names of the protocols any packet shows."""
    from packetloom.registry import protocol_names

    name = F.lower("name")
    standard = F
    for other, registered in REGISTRY_NAMES.items():
        standard = standard.when(name == other, F.lit(registered))
    return pk.select(F.explode(packet_protocols()).alias("name")).distinct().select(
        standard.otherwise(name).alias("protocol")).where(
            F.col("protocol").isin(sorted(protocol_names()))).distinct()


def protocol_markers(pk: DataFrame, flows: DataFrame) -> DataFrame:
    """Counts per flow that tell which protocols it carries."""
    calls = sip.sip_summary(pk).select("flow_key", F.col("calls").alias("sip_calls"),
                                       F.col("methods").alias("sip_methods"),
                                       F.col("statuses").alias("sip_statuses"))
    named = tls.tls_summary(pk).select("flow_key", F.col("snis").alias("tls_snis"))
    return flows.select(
        "flow_key", "smb_commands", "smb_statuses", "dns_queries",
        F.col("dns_responses").alias("dns_rcodes"), "dns_errors", "dhcp_messages", "tls_alerts",
    ).join(calls, "flow_key", "left").join(named, "flow_key", "left").na.fill(0)
