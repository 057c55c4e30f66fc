"""Many requests for tools and flows in one call, on literal header rows."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import deep_query, rollup
from packetloom.sources.headers import control_header_rows, header_rows

UDP = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 4000, "dst_port": 5004, "protocol": "UDP"}
TCP = {"src_ip": "10.0.0.3", "dst_ip": "10.0.0.4", "src_port": 4001, "dst_port": 443, "protocol": "TCP"}


@pytest.fixture
def answered(spark, packets):
    media = [{**UDP, "decoded_protocols": ["RTP", "UDP"], "rtp_ssrc": "0x1", "rtp_sequence": n, "length": 100,
              "timestamp": None} for n in (65534, 65535, 0, 0, 3, 2)]
    plain = [{**TCP, "decoded_protocols": ["TCP"], "issue_tags": ["tcp_reset", "tcp_zero_window"]} for _ in range(3)]
    pk = packets([*media, *plain]).withColumns({
        "kind": F.when(F.col("protocol") == "UDP", "rtp").otherwise("web"), "rev": ~F.col("a_to_b"),
        "k": F.col("frame_number"), "timestamp": F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, frame_number)")})
    flows = rollup.rank_flows(rollup.flow_rollup(pk))
    requests = spark.createDataFrame(
        [("a", "deep_rtp_flow", 1, 0), ("b", "deep_rtp_flow", 1, 4), ("c", "deep_tcp_flow", 2, 1), ("d", "deep_tcp_flow", 1, 0),
         ("e", "deep_tls_flow", 2, 0), ("f", "nothing", 1, 0), ("g", "deep_udp_flow", 77, 0), ("h", "deep_udp_flow", 1, 99)],
        "request_id string, tool string, flow_id long, offset long")
    return deep_query.deep_query(requests, flows, header_rows(pk), limit=4)


def test_every_request_has_one_answer(answered):
    found = {r.request_id: r for r in answered.answers.collect()}
    assert {k: r.status for k, r in found.items()} == {
        "a": "ok", "b": "ok", "c": "ok", "d": "skipped", "e": "empty", "f": "rejected", "g": "not_found", "h": "ok"}
    pages = {k: (r.total_matching, r.returned, r.has_more, r.next_offset) for k, r in found.items()}
    assert pages == {"a": (6, 4, True, 4), "b": (6, 2, False, None), "c": (3, 2, False, None), "d": (None,) * 4,
                     "e": (0, 0, False, None), "f": (None,) * 4, "g": (None,) * 4, "h": (6, 0, False, None)}
    assert found["a"].reason.startswith("RTP/SRTP") and found["c"].reason == "TCP issue counters observed."
    assert found["e"].reason is None
    rows = sorted((r.request_id, r.position, r.frame_number) for r in answered.rows.collect())
    assert rows == [("a", k, k + 1) for k in range(4)] + [("b", 4, 5), ("b", 5, 6), ("c", 1, 8), ("c", 2, 9)]


def test_counters_of_streams_and_markers(answered):
    found = {(r.tool, r.counter, r.item): r.value for r in answered.counters.collect()}
    stream = {k[1]: v for k, v in found.items() if k[2] == "A_to_B 0x1"}
    assert {n: stream[n] for n in ("packets", "duplicates", "out_of_order", "holes", "interval_count")} == {
        "packets": "6", "duplicates": "1", "out_of_order": "1", "holes": "1", "interval_count": "5"}
    assert found["deep_tcp_flow", "tcp.analysis.zero_window", None] == "3"
    assert found["deep_udp_flow", "dns_packets", None] == "0"
    assert not any(tool == "deep_tls_flow" for tool, _, _ in found)


def test_header_rows_are_stored_once_with_the_fields_that_are_counted(spark, packets, monkeypatch):
    stored = {}
    settle = deep_query.settle

    def kept(df, name):
        stored[name] = settle(df, name)
        return stored[name]

    monkeypatch.setattr(deep_query, "settle", kept)
    pk = packets([{**TCP, "decoded_protocols": ["TCP", "TLS"]}] * 3 + [{**UDP, "decoded_protocols": ["UDP"]}] * 2).withColumns({
        "kind": F.lit("web"), "rev": ~F.col("a_to_b"), "k": F.lit(7)})
    flows = rollup.rank_flows(rollup.flow_rollup(pk))
    tcp = flows.where("protocol = 'TCP'").first().flow_id
    asked = spark.createDataFrame([("x", "deep_tcp_flow", tcp, 0), ("y", "deep_tls_flow", tcp, 0), ("z", "deep_tls_flow", tcp, 1)],
                                  "request_id string, tool string, flow_id long, offset long")
    found = deep_query.deep_query(asked, flows, header_rows(pk))
    assert {r.request_id: r.total_matching for r in found.answers.collect()} == {"x": 3, "y": 3, "z": 3}
    assert [sorted(r.tools) for r in stored["tool_rows"].collect()] == [["deep_tcp_flow", "deep_tls_flow"]] * 3
    assert not {"rtp.timestamp", "smb2.file_id", "dns.resp.name", "tcp.seq"} & set(stored["tool_rows"].columns)
    counted = {(r.tool, r.counter): r.value for r in found.counters.collect()}
    assert counted["deep_tls_flow", "tls_packets"] == "3" and counted["deep_tcp_flow", "advertised_window_max"] == str(7 * 512)


def test_control_tools_and_empty_requests(spark, packets):
    bgp = {**TCP, "dst_port": 179, "decoded_protocols": ["BGP", "TCP"], "bgp_fields": {"bgp.type": ["2", "2", "4"]}}
    pk = packets([bgp, bgp]).withColumn("k", F.lit(0))
    flows = rollup.rank_flows(rollup.flow_rollup(pk))
    asked = spark.createDataFrame([("x", "deep_bgp_flow", 1, 0), ("y", "deep_ike_flow", 1, 0)],
                                  "request_id string, tool string, flow_id long, offset long")
    tools = ["deep_ike_flow", "deep_bgp_flow"]
    found = deep_query.deep_query(asked, flows, control_header_rows(pk), tools=tools)
    assert {(r.counter, r.item, r.value) for r in found.counters.collect()} == {
        ("bgp_packets", None, "2"), ("bgp.type", "2", "4"), ("bgp.type", "4", "2")}
    none = deep_query.deep_query(asked.where("false"), flows, control_header_rows(pk), tools=tools)
    assert none.answers.count() == none.rows.count() == none.counters.count() == 0
