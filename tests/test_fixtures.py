"""Literal packets and header rows with their exact results."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from packetloom import registry
from packetloom.functions import names, parse, protocols as protocol_functions
from packetloom.operators import deep, evidence, filters, metrics, paging, related, rollup
from packetloom.operators.filters import FlowFilter
from packetloom.protocols import dhcp, esp, ike, link, rtp, smb, tcp, tls
from packetloom.sources import captures, fields, tables

A, B = "10.0.0.1", "10.0.0.2"


def between(a=A, b=B, pa=5000, pb=6000, protocol="UDP", **rest):
    return {"src_ip": a, "dst_ip": b, "src_port": pa, "dst_port": pb, "protocol": protocol, **rest}


def back(**rest):
    return between(B, A, 6000, 5000, **rest)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("numbers,expected", [
    ([1, 2, 5, 5, 4], dict(packets=5, first_sequence=1, last_sequence=4, missing=1, largest_gap=2,
                           duplicates=1, out_of_order=1)),
    ([1, 3, 2, 2], dict(highest_sequence=3, missing=0, largest_gap=1, out_of_order=1, duplicates=1)),
])
def test_esp_sequences(packets, small_chunks, numbers, expected):
    pk = packets([between(protocol="ESP", pa=None, pb=None, esp_spi="0x1", esp_sequence=n, length=10)
                  for n in numbers])
    row = one(esp.esp_sequences(pk)).asDict()
    assert {k: row[k] for k in expected} == expected
    if numbers[1] == 2:
        gap = one(esp.esp_gaps(pk))
        assert (gap.after_sequence, gap.next_sequence, gap.missing) == (2, 5, 2)
        assert one(esp.esp_gap_distribution(esp.esp_gaps(pk))).n == 1
    else:
        fl = metrics.with_esp(rollup.flow_rollup(pk), esp.esp_sequences(pk))
        rates = one(fl.select(*[c.alias(n) for n, c in metrics.out_of_order().items()]))
        assert (rates.out_of_order_rate, rates.a_to_b_out_of_order_rate,
                rates.b_to_a_out_of_order_rate) == (0.25, 0.25, 0)


def test_rtp_rollover_late_packets_copies_and_directions(packets, small_chunks):
    start = dt.datetime(2026, 1, 1)
    pk = packets([between(rtp_ssrc="0x1", rtp_sequence=n, rtp_payload_type=0, srtp=True, length=100,
                          timestamp=start + dt.timedelta(seconds=i))
                  for i, n in enumerate([65534, 0, 65535, 1, 1, 3])]
                 + [back(rtp_ssrc="0x1", rtp_sequence=65534, srtp=True, timestamp=start)])
    forward, reverse = sorted(rtp.rtp_streams(pk).collect(), key=lambda r: r.direction)
    assert (forward.holes, forward.duplicates, forward.out_of_order, forward.srtp_packets,
            forward.pause_count) == (1, 1, 1, 6, 5)
    assert (reverse.direction, reverse.packets) == ("B_to_A", 1)


def test_round_trips(packets):
    pk = packets([between(protocol="TCP", rtt_seconds=x, initial_rtt_seconds=i)
                  for x, i in ((0.0002, 0.5), (0.02, None), (0.0928, 0.02))])
    stats = one(rollup.rtt_stats(pk))
    assert (stats.rtt_median_ms, stats.rtt_p95_ms, stats.rtt_max_ms, stats.rtt_samples) == (
        20, 92.8, 92.8, 3)
    assert one(rollup.initial_rtt(pk)).initial_rtt_ms == 20


def test_evidence_positions_count_rows_per_tool(packets):
    pk = packets([between(protocol="TCP", decoded_protocols=["TCP", "TLS"] if i % 2 == 0 else ["TCP"],
                          issue_tags=["tcp_reset"] if i == 300 else []) for i in range(301)])
    windows = evidence.merge_windows(evidence.evidence_triggers(pk))
    assert {(w.tool, w.issue_packet_index, w.sample_offset) for w in windows.collect()} == {
        ("deep_tcp_flow", 300, 200), ("deep_tls_flow", 150, 50)}


def test_evidence_reasons_of_each_kind(packets):
    start = dt.datetime(2026, 1, 1)
    ike_error = {"version": 32, "notify_types": [16388, 24], "proposal_fields": {}}
    pk = packets([
        between(dns_response_code="noerror", timestamp=start),
        between(sip_status_code=404, timestamp=start + dt.timedelta(milliseconds=300)),
        between(ike=tuple(ike_error.get(n) for n in (
            "version", "initiator_spi", "responder_spi", "exchange_type", "message_id", "flags",
            "next_payload", "length", "notify_types", "fragment_number", "fragment_total",
            "fragment_id", "fragment_last", "proposal_fields"))),
        between(protocol="TCP", bgp_fields={"bgp.notify.major_error": ["6", "2"]}),
        {"protocol": "EAPOL", "src_mac": "02:00:00:00:00:01", "dst_mac": "02:00:00:00:00:02",
         "link_type": "eth", "vlan_ids": [], "eapol_fields": {"eap.code": ["4"]}},
        between(tls_alert_level="2", tls_alert_description="40", issue_tags=["tls_alert"],
                timestamp=start + dt.timedelta(seconds=9)),
    ])
    found = {r.frame_number: r.reasons for r in evidence.evidence_triggers(pk).collect()}
    assert found == {
        1: ["DNS response code noerror"], 2: ["SIP status 404", "Direction packet gap"],
        3: ["IKE error notification observed"], 4: ["BGP NOTIFICATION: 6,2"],
        5: ["EAP Failure observed"], 6: ["tls_alert", "TLS alert 2: 40"]}


def smb_packet(**rest):
    base = {"smb_commands_seen": [rest.get("smb_command")]}
    return between(pa=50000, pb=445, protocol="TCP", **{**base, **rest})


def test_writes_without_length_take_it_from_the_offset(packets):
    pk = packets([smb_packet(smb_command="SMB2write", smb_message_id=str(i), smb_file_id="0xabc",
                             smb_filename="upload.bin", smb_file_offset=o)
                  for i, o in enumerate((0, 4096))])
    moved = one(smb.smb_transfers(smb.smb_transfer_ops(pk)))
    assert (moved.kind, moved.ops, moved.bytes, moved.inferred_ops, moved.unknown_ops) == (
        "write", 2, 4096, 1, 1)


def test_file_ids_take_the_name_of_their_create(packets, small_chunks):
    pk = packets([
        smb_packet(smb_command="SMB2create", smb_message_id="1", smb_filename="upload.bin",
                   smb_create_desired_access=2),
        smb_packet(smb_command="SMB2create", smb_message_id="1", smb_file_id="0xabc",
                   smb_is_response=True, smb_status="0x00000000"),
        *[smb_packet(smb_command="SMB2write", smb_message_id=str(2 + i), smb_file_id="0xabc",
                     smb_file_offset=4096 * i) for i in range(2)],
        smb_packet(smb_command="SMB2write", smb_message_id="9", smb_is_response=True,
                   smb_status="0xc0000022", smb_write_length=10)])
    assert one(smb.smb_create_bindings(pk)).filename == "upload.bin"
    ops = smb.smb_transfer_ops(pk)
    file = one(smb.smb_file_bytes(ops))
    assert (file.filename, file.bytes, one(smb.smb_transfers(ops)).ops) == ("upload.bin", 4096, 2)
    assert smb.large_files(smb.smb_file_bytes(ops)).count() == 0


def test_a_message_counts_once_and_a_late_answer_needs_a_length(packets):
    pk = packets([
        smb_packet(smb_command="SMB2read", smb_message_id="1", smb_read_length=10),
        smb_packet(smb_command="SMB2read", smb_message_id="1", smb_is_response=True),
        smb_packet(smb_command="SMB2read", smb_is_response=True),
        smb_packet(smb_command="SMB2read", smb_is_response=True, smb_read_length=5),
        smb_packet(smb_command="SMB2read")])
    moved = one(smb.smb_transfers(smb.smb_transfer_ops(pk)))
    assert (moved.ops, moved.bytes, moved.unknown_ops) == (3, 15, 1)


def test_calls_by_phone(packets):
    pk = packets([
        between(sip_call_id="call-123", sip_from="sip:+1-555-0100@x"),
        between(sip_call_id="call-456", sip_from="sip:+1-555-0999@x"),
        between(sip_call_id="call-123", sip_status_code=200), between(sip_to="sip:0100@y"),
        between()])
    kept = sorted(r.frame_number for r in related.calls_by_phone(pk, "0100").collect())
    assert kept == [1, 3, 4]
    assert related.calls_by_phone(pk, "none").count() == 5


def test_redirects_bring_in_the_target_flows(packets):
    pk = packets([
        between(protocol="TCP", pb=80, http_location="https://Login.example:8443/x"),
        between(pb=53, dns_query="login.example.", dns_answers=["203.0.113.9"]),
        between(b="203.0.113.9", pb=8443, protocol="TCP"), between(b="203.0.113.50", protocol="TCP")])
    seed = pk.where("frame_number = 1")
    kept = sorted(r.frame_number for r in related.with_redirects(pk, seed).collect())
    assert kept == [1, 2, 3]
    bare = pk.where("frame_number = 4")
    assert [r.frame_number for r in related.with_redirects(pk, bare).collect()] == [4]


def test_url_hosts_lose_case_and_brackets(spark):
    urls = ["https://[2001:DB8::1]:8443/x", "http://Host.Example/", "/relative", "not a url"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    hosts = [r.h for r in df.select(related.url_host(F.col("u")).alias("h")).collect()]
    assert hosts == ["2001:db8::1", "host.example", None, None]


def header_frame(spark, rows, keys=("flow_key",)):
    names_ = sorted({k for r in rows for k in r})
    schema = "frame_number bigint, flow_key string, " + ", ".join(f"`{n}` string" for n in names_)
    return spark.createDataFrame(
        [(i, "f", *[r.get(n) for n in names_]) for i, r in enumerate(rows)], schema)


def test_smb2_credits(spark):
    credit, shared = "smb2.credit.charge", "smb2.credit.request_response"
    rows = fields.with_fields(header_frame(spark, [
        {"smb2.cmd": "8", "smb2.flags.response": "0", credit: "2", shared: "128"},
        {"smb2.cmd": "8", "smb2.flags.response": "1", credit: "2", shared: "64",
         "smb2.nt_status": "0x00000000"},
        {"smb2.cmd": "9", "smb2.flags.response": "1", credit: "1", shared: "0",
         "smb2.nt_status": "0xc0000022", "tcp.analysis.retransmission": "1",
         "tcp.analysis.zero_window": "1"}]), smb.FIELDS)
    counts = one(smb.smb2_credits(rows)).asDict()
    del counts["flow_key"]
    assert counts == {
        "smb2_packets": 3, "smb2_requests": 1, "smb2_responses": 2, "credit_charge_total": 5,
        "credit_charge_max": 2, "credit_request_total": 128, "credit_request_max": 128,
        "credit_grant_total": 64, "credit_grant_max": 64, "credit_grant_zero_packets": 1,
        "read_packets": 2, "write_packets": 1, "status_error_packets": 1,
        "tcp_loss_or_retransmission_packets": 1, "tcp_zero_window_packets": 1}


def test_esp_tunnel_rows(spark, small_chunks):
    ends = {"src": A, "dst": B, "frame.len": "1500"}
    rows = fields.with_fields(header_frame(spark, [
        {**ends, "ip.len": "1480", "ip.ttl": "63", "ip.dsfield.dscp": "46", "ip.flags.df": "1",
         "udp.dstport": "4500", "esp.sequence": "1"},
        {**ends, "ip.len": "1400", "ip.ttl": "62", "ip.dsfield.dscp": "46", "ip.frag_offset": "1",
         "esp.sequence": "4"},
        {**ends, "ip.len": "1200", "esp.sequence": "3"}, {**ends, "ip.len": "1480", "esp.sequence": "4"},
    ]), esp.FIELDS)
    counts = one(esp.esp_counts(rows))
    assert (counts.esp_packets, counts.nat_t_packets, counts.df_set_packets,
            counts.fragmented_packets, counts.dscp_values, counts.ip_length_min,
            counts.ip_length_max, counts.df_bit) == (4, 1, 1, 1, "46", 1200, 1480, "on")
    way = one(esp.esp_direction_stats(rows))
    assert (way.rows, way.bytes, way.first_sequence, way.last_sequence, way.highest_sequence,
            way.missing, way.largest_gap, way.out_of_order, way.duplicates, way.ttl_min,
            way.ttl_max) == (4, 6000, 1, 4, 4, 1, 2, 1, 1, 62, 63)
    gap = one(esp.esp_direction_gaps(rows))
    assert (gap.missing, gap.n) == (2, 1)


def test_marker_tests_differ_by_tool(spark):
    row = {"tcp.analysis.retransmission": "0", "tcp.analysis.zero_window": "False",
           "tcp.analysis.lost_segment": "1", "tls.handshake.type": "0", "tcp.window_size": "010"}
    rows = fields.with_fields(header_frame(spark, [row]), [*tcp.TCP_FIELDS, *tls.FIELDS])
    assert [(r.field, r.n) for r in tcp.tcp_marker_counts(rows).collect()] == [
        ("tcp.analysis.lost_segment", 1)]
    counted = one(tls.tls_counts(rows))
    assert (counted.tls_handshake_packets, counted.tcp_loss_or_retransmission_packets) == (1, 1)
    assert one(tcp.tcp_window_stats(rows)).advertised_window_min is None


def test_every_row_is_delivered_once(spark, small_chunks):
    df = spark.range(2005).withColumnRenamed("id", "n")
    seen = []
    for offset, returned, following in ((0, 1000, 1000), (1000, 1000, 2000), (2000, 5, None)):
        described = one(paging.describe_page(df, offset))
        assert (described.returned, described.next_offset, described.total_matching) == (
            returned, following, 2005)
        seen += [r.n for r in paging.page(df, "n", offset).collect()]
    assert sorted(seen) == list(range(2005))
    for offset, limit in ((-1, 10), (0, 0)):
        with pytest.raises(ValueError):
            paging.page(df, "n", offset, limit)


def test_filters_agree_on_packets_and_flows(packets):
    pk = packets([between(protocol="TCP", pa=0, pb=443, decoded_protocols=["TCP", "TLS"])])
    fl = rollup.flow_rollup(pk).join(rollup.flow_protocol_sets(pk), "flow_key")
    for option in (dict(host=["x", A]), dict(peer=B), dict(protocol=["ssl", "x"]), dict(port=[0, 9]),
                   dict(src=A), dict(dst=B), dict(src_port=[0]), dict(dst_port=443),
                   dict(host=A, peer=B), {}):
        assert filters.filter_packets(pk, FlowFilter(**option)).count() == 1, option
        assert filters.filter_flows(fl, FlowFilter(**option)).count() == 1, option
    for option in (dict(host=A, peer=A), dict(src=B), dict(dst_port=0), dict(src=A, dst_port=80)):
        assert filters.filter_packets(pk, FlowFilter(**option)).count() == 0, option
        assert filters.filter_flows(fl, FlowFilter(**option)).count() == 0, option
    assert filters.filter_flows(fl, FlowFilter(host=A, peer=A, match_any=True)).count() == 1
    assert filters.filter_flows(fl, FlowFilter(src=B, dst_port=80, match_any=True)).count() == 0
    with pytest.raises(ValueError):
        filters.filter_packets(pk, FlowFilter(protocol="tcp or udp"))


@pytest.mark.parametrize("record,name", [
    (dict(dns_query="x"), "DNS"), (dict(dhcp_transaction_id="1"), "DHCP"), (dict(sip_method="ACK"), "SIP"),
    (dict(smb_status="0"), "SMB"), (dict(http_host="x"), "HTTP"), (dict(tls_sni="x"), "DTLS"),
    (dict(tls_sni="x", protocol="TCP"), "TLS"), (dict(srtp=True), "RTP"), (dict(rtp_ssrc="1"), "RTP"),
    (dict(decoded_protocols=["ISAKMP"]), "IKE"), (dict(decoded_protocols=["SMB2"]), "SMB"),
    (dict(decoded_protocols=["MKA"]), "EAPOL"), (dict(decoded_protocols=["bootp"]), "DHCP"),
    (dict(bgp_fields={"bgp.type": ["1"]}), "BGP")])
def test_protocols_of_a_packet(packets, record, name):
    pk = packets([between(**{"protocol": "UDP", **record})])
    row = one(pk.select(protocol_functions.packet_protocols().alias("names"),
                        protocol_functions.shows_any([name]).alias("shown"),
                        protocol_functions.shows_any(["GRE"]).alias("other")))
    assert name in row.names and row.shown and not row.other


def test_rates_without_duration_and_one_way(packets):
    start = dt.datetime(2026, 1, 1)
    alone = packets([between(length=100, timestamp=start)])
    rates = {**metrics.packet_rates(), **metrics.throughput_mbps(), **metrics.total_rates()}
    row = one(metrics.with_duration(rollup.flow_rollup(alone)).withColumns(rates))
    assert row.a_to_b_mbps is None and row.b_to_a_packets_per_s is None and row.mbps == 0
    timed = packets([between(length=1_000_000, timestamp=start),
                     between(length=0, timestamp=start + dt.timedelta(seconds=2))])
    row = one(metrics.with_duration(rollup.flow_rollup(timed)).withColumns(rates))
    assert (row.a_to_b_mbps, row.b_to_a_mbps, row.b_to_a_packets_per_s) == (4, 0, 0)


def test_safe_numbers(spark):
    texts = ["12", "0x1F", "-3", "010", "0b11", "0o17", "1.5", "", "x", "False", " 7 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(parse.safe_int(F.col("t")).alias("s"), parse.row_int(F.col("t")).alias("r")).collect()
    assert [r.s for r in rows] == [12, 31, -3, 10, 3, 15, None, None, None, None, 7]
    assert [r.r for r in rows] == [12, 31, -3, None, 3, 15, None, None, None, None, 7]


def test_names_of_codes(spark):
    row = spark.range(1).select(
        names.tls_alert_label(F.lit("2"), F.lit("40")).alias("alert"),
        names.tls_alert_label(F.lit("Fatal"), F.lit(None).cast("string")).alias("text"),
        names.tls_alert_label(F.lit("9"), F.lit("")).alias("odd"),
        names.smb_status_text(F.lit("0xC0000022")).alias("denied"),
        names.smb_status_text(F.lit("0xc0ffee00")).alias("unknown"),
        names.smb_command_text(F.lit("0x2e")).alias("command"),
        names.ike_exchange(F.lit(1), F.lit(2)).alias("main"),
        names.ike_exchange(F.lit(2), F.lit(None).cast("int")).alias("none")).first()
    assert row.asDict() == {
        "alert": "fatal (2) handshake_failure (40)", "text": "Fatal", "odd": "unknown_alert_9 (9)",
        "denied": "STATUS_ACCESS_DENIED", "unknown": "NTSTATUS_UNKNOWN(0xc0ffee00)",
        "command": "SMBreadX(0x2e)", "main": "2: Main Mode", "none": "None: Unknown"}


def test_ike_rows_become_sessions(spark, packets):
    names_ = ["isakmp.version", "isakmp.ispi", "isakmp.rspi", "isakmp.exchangetype", "isakmp.flags",
              "isakmp.notify.msgtype", "isakmp.nextpayload", "isakmp.frag.seq", "isakmp.tf.id.encr"]
    values = ["0x20", "AA:bb", "", "34", "0x08", "16388,24", "46", "1", "12,,20"]
    rows = fields.with_fields(header_frame(spark, [dict(zip(names_, values)),
                                                   {"isakmp.version": "0x30"}]), ike.FIELDS)
    first, second = [r.m for r in rows.orderBy("frame_number").select(
        ike.ike_metadata().alias("m")).collect()]
    assert second is None
    assert (first.version, first.initiator_spi, first.responder_spi, first.notify_types,
            first.fragment_number, first.proposal_fields) == (
                32, "aabb", None, [16388, 24], 1, {"tf.id.encr": ["12", "20"]})
    pk = packets([between(ike=tuple(first)), back(ike=tuple(first))])
    session = one(ike.ike_sessions(pk))
    assert (session.a_to_b_packets, session.b_to_a_packets, session.encrypted_packets,
            session.fragmented_packets, session.v2_requests) == (1, 1, 2, 2, 2)
    counted = {(r.kind, r.value): r.n for r in ike.ike_counts(pk).collect()}
    assert counted[("notification", "24: AUTHENTICATION_FAILED")] == 2
    assert counted[("exchange", "34: IKE_SA_INIT")] == 2


def test_link_security_values_and_ranges(packets):
    ends = {"src_mac": "02:00:00:00:00:02", "dst_mac": "02:00:00:00:00:01", "link_type": "eth",
            "vlan_ids": [7], "protocol": "EAPOL"}
    pk = packets([{**ends, "eapol_fields": {"mka.actor_mn": [v], "eap.code": ["1"]}}
                  for v in ("00:00:00:0a", "00:00:01:00", "zz")])
    low, high = one(link.link_ranges(pk, "EAPOL").select("low", "high"))
    assert (low, high, one(link.link_counts(pk, "EAPOL")).n) == (10, 256, 3)
    assert pk.first().flow_key == "EAPOL|02:00:00:00:00:01||02:00:00:00:00:02||eth|7"


def test_lists_are_whole_unless_a_cap_is_asked_for(packets):
    pk = packets([between(dhcp_message_type="Discover", dhcp_transaction_id=f"x{i}") for i in range(40)])
    row = one(dhcp.dhcp_summary(pk))
    assert row.transaction_ids == [f"x{i}" for i in range(40)] and not row.has_ack
    row = one(dhcp.dhcp_summary(pk, cap=25))
    assert row.transaction_ids == [f"x{i}" for i in range(25)] and row.n_transaction_ids == 40


def test_certificates_roles_and_validity(spark, packets):
    def certificate(subject, serial, until="2030-01-01T00:00:00+00:00"):
        return (None, None, None, subject, subject[3:], "CN=Root", "Root", serial,
                "2020-01-01T00:00:00Z", until, ["a"], None)

    pk = packets([
        between(B, A, 443, 5000, "TCP", tls_certificates=[certificate("CN=s", "1"), certificate("CN=i", "2")]),
        between(A, B, 5000, 443, "TCP", tls_certificates=[certificate("CN=c", "3", "2021-01-01")]),
        between(B, A, 443, 5000, "TCP", tls_certificates=[certificate("CN=s", "1", "2099-01-01")])])
    rows = {r.subject: r for r in tls.tls_certificates(pk).withColumn("issues", tls.certificate_issues(
        F.col("not_before"), F.col("not_after"),
        F.lit("2024-06-01 00:00:00").cast("timestamp"))).collect()}
    assert {s: r.role for s, r in rows.items()} == {"CN=s": "server", "CN=i": "server", "CN=c": "client"}
    assert rows["CN=c"].issues == ["certificate expired 2021-01-01"] and rows["CN=s"].issues == []
    assert rows["CN=s"].not_after.startswith("2030")


def test_field_export(spark, tmp_path):
    wanted = ["frame.number", "ip.src", "ipv6.src", "ip.dst", "ipv6.dst", "esp.spi"]
    (tmp_path / "rows.tsv").write_text("1\t10.0.0.1\t\t10.0.0.2\t\t0x1\n2\t\t::1\t\t::2\n")
    rows = sorted(fields.read_field_rows(spark, str(tmp_path), wanted).collect())
    assert [(r.src, r.dst, r["esp.spi"]) for r in rows] == [(A, B, "0x1"), ("::1", "::2", None)]


def test_header_rows_become_packets(spark):
    rows = header_frame(spark, [
        {"frame.number": "1", "frame.time_epoch": "1700000000.123456789", "frame.len": "60",
         "frame.protocols": "eth:ip:tcp:tls", "ip.src": A, "ip.dst": B, "tcp.srcport": "443",
         "tcp.dstport": "5000", "tcp.analysis.retransmission": "1", "tcp.flags.reset": "True",
         "tls.alert_message.level": "2", "tls.alert_message.desc": "40", "frame.time_relative": "0.5 s"},
        {"frame.number": "2", "frame.protocols": "eth:macsec", "eth.src": "AA:00:00:00:00:01",
         "eth.dst": "aa:00:00:00:00:02", "vlan.id": "5,x,7", "macsec.AN": "1"},
        {"frame.number": "3", "frame.protocols": "eth:arp"},
        {"frame.number": "4", "frame.protocols": "eth:ip:udp:dns", "ip.src": A, "ip.dst": B,
         "udp.srcport": "53", "udp.dstport": "5000", "dns.a": "1.2.3.4,5.6.7.8", "dns.flags.rcode": "0"},
        {"frame.number": "5", "frame.protocols": "eth:ip:udp:esp", "ip.src": A, "ip.dst": B,
         "udp.srcport": "4500", "udp.dstport": "4500", "esp.spi": "0x9", "esp.sequence": "0x10"},
        {"frame.number": "6", "frame.protocols": "eth:ip:tcp:smb2", "ip.src": A, "ip.dst": B,
         "tcp.srcport": "445", "tcp.dstport": "5000", "smb2.cmd": "8,9", "smb2.flags.response": "0",
         "smb2.read_length": "7", "smb2.file_offset": "16"},
    ]).drop("frame_number", "flow_key")
    found = {r.frame_number: r for r in fields.observe(rows).collect()}
    assert sorted(found) == [1, 2, 4, 5, 6]
    first = found[1]
    assert (first.issue_tags, first.src_port, first.length, first.time_relative[:3]) == (
        ["tcp_retransmission", "tcp_reset", "tls_alert", "tls_fatal_alert"], 443, 60, "0.5")
    assert (found[2].protocol, found[2].src_mac, found[2].vlan_ids, found[2].macsec_fields) == (
        "MACSEC", "aa:00:00:00:00:01", [5, 7], {"macsec.AN": ["1"]})
    assert found[4].dns_answers == ["1.2.3.4", "5.6.7.8"]
    assert (found[5].protocol, found[5].src_port, found[5].esp_sequence) == ("ESP", 4500, 16)
    assert (found[6].smb_commands_seen, found[6].smb_is_response, found[6].smb_read_length,
            found[6].smb_file_offset) == (["SMB2read", "SMB2write"], False, 7, 16)


def test_capture_files_are_counted(spark, tmp_path):
    record = struct.pack("<IIII", 1, 2, 3, 3) + b"abc"
    big = struct.pack(">IIII", 1, 2, 4, 4) + b"abcd"
    section = struct.pack("<II4sHHqI", 0x0A0D0D0A, 28, b"\x4d\x3c\x2b\x1a", 1, 0, -1, 28)
    block = struct.pack("<II", 6, 16) + b"....\x10\0\0\0"
    other = struct.pack("<II", 1, 12) + b"\x0c\0\0\0"
    files = {"a.pcap": b"\xd4\xc3\xb2\xa1" + bytes(20) + record * 3,
             "b.pcap": b"\xa1\xb2\x3c\x4d" + bytes(20) + big * 2,
             "c.pcapng": section + block + other + block, "cut.pcap": b"\xd4\xc3\xb2\xa1" + bytes(20) + record + b"123",
             "text.txt": b"no capture"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    counts = {r.path.rsplit("/", 1)[1]: r.packets for r in captures.capture_counts(spark, str(tmp_path)).collect()}
    assert counts == {"a.pcap": 3, "b.pcap": 2, "c.pcapng": 2, "cut.pcap": None, "text.txt": None}


def test_saved_summaries_old_and_new(spark, tmp_path):
    import json

    key = {"endpoint_a": A, "endpoint_b": B, "port_a": 1, "port_b": 2, "protocol": "TCP"}
    window = [{"tool": "deep_tcp_flow", "sample_offset": max(0, p - 100), "issue_packet_index": p,
               "frame_number": p + 1, "direction": "A_to_B", "reasons": ["tcp_reset"]} for p in (100, 200)]
    bare = {"packet_count": 3, "flows": [{"key": key, "packet_count": 3, "dns_error_count": 4,
                                          "recommended_evidence_offsets": window}]}
    wrapped = {"summary": {"flows": [{"key": key, "packet_count": 9, "dns": {"error_count": 5}}]},
               "source_capture_path": "/x.pcap"}
    (tmp_path / "a.json").write_text(json.dumps(bare, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(wrapped, indent=1))
    flows = tables.read_summary(spark, str(tmp_path))
    rows = sorted(flows.collect(), key=lambda r: r.packet_count)
    assert [(r.packet_count, r.dns.error_count, r.flow_id, r.source_capture_path, r.protocol)
            for r in rows] == [(3, 4, 1, None, "TCP"), (9, 5, 1, "/x.pcap", "TCP")]
    merged = one(evidence.merge_windows(tables.saved_triggers(flows)))
    assert (merged.sample_offset, merged.issue_count, merged.reasons) == (0, 2, ["tcp_reset"])


def test_tables_are_never_replaced(spark, tmp_path, packets):
    pk = packets([between(), back()])
    tables.write_new(pk, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        tables.write_new(pk, str(tmp_path / "t"))
    again = tables.read_packets(spark, str(tmp_path / "t"))
    assert again.count() == 2 and tables.packet_limit(again, 1).count() == 1


def test_requests_are_answered_one_by_one(spark, packets):
    from packetloom.sources.headers import FIELD_NAMES

    pk = packets([between(protocol="TCP", decoded_protocols=["TCP"], length=9) for _ in range(5)]
                 + [between(decoded_protocols=["UDP"])])
    ranked = rollup.rank_flows(rollup.flow_rollup(pk))
    headers = fields.with_fields(pk, FIELD_NAMES)
    requests = spark.createDataFrame(
        [(1, "deep_tcp_flow", 1, 3), (2, "deep_tcp_flow", 2, 0), (3, "deep_tcp_flow", 9, 0),
         (4, "deep_any_flow", 1, 0), (5, "deep_tls_flow", 1, 0)],
        "request_id int, tool string, flow_id bigint, offset bigint")
    answers = {r.request_id: r for r in deep.evidence_lookup(requests, ranked, headers).collect()}
    assert [answers[i].status for i in range(1, 6)] == ["ok", "skipped", "not_found", "rejected", "ok"]
    assert (answers[1].returned, answers[1].total_matching, answers[5].total_matching) == (2, 5, 0)
    rows = deep.requested_rows(requests.where("request_id = 1"), ranked, headers).collect()
    assert sorted(r.position for r in rows) == [3, 4]
    assert one(deep.route_tools(ranked, 1)).tool == "deep_tcp_flow"


def test_registry_refuses_inconsistent_protocols():
    assert len(registry.protocol_names()) == 13 and len(registry.tool_names()) == 10
    assert registry.protocol_of_tool("deep_smb2_flow").name == "smb"
    for bad in (registry.Protocol("dns", "DNS"), registry.Protocol("new", "New", tools=("deep_new_flow",)),
                registry.Protocol("new", "New", tools=("deep_tcp_flow",), counters=(print,),
                                  reason=deep.deep_reason),
                registry.Protocol("new", "New", tools=("deep_new_flow",), counters=(print,))):
        with pytest.raises(ValueError):
            registry.register(bad)
    with pytest.raises(ValueError):
        registry.deep_counters(None, "deep_any_flow")


def test_phone_and_unverified_addresses(spark, packets):
    pk = packets([between(sip_from="sip:555-0100@x", sip_call_id="c"), between(pa=1, pb=2)])
    assert filters.flows_by_phone(rollup.flow_rollup(pk), pk, "5550100").count() == 1
    texts = spark.createDataFrame([(1, f"{A} and 8.8.8.8, 999.1.1.1, 01.2.3.4 and 8.8.8.8.")],
                                  "id int, text string")
    seen = spark.createDataFrame([(A,)], "address string")
    assert [tuple(r) for r in related.unverified_addresses(texts, "id", "text", seen).collect()] == [
        (1, "8.8.8.8")]


def test_hosts_of_redirects(spark):
    from packetloom.operators.related import url_host

    cases = {"https://my_host.example/x": "my_host.example", "http://H.example/a|b": "h.example", "//h.example/a b": "h.example",
             "http://u:p@h.example:8080?q={x}": "h.example", "http://h.example/%zz": "h.example",
             "http://[2001:DB8::1]:80/x": "2001:db8::1", "/only/path": None, "h.example/x": None, "": None}
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", url_host(F.col("url")).alias("host"))
    assert {r.url: r.host for r in df.collect()} == cases


def test_link_frames_hold_nothing_of_inner_protocols(packets):
    from packetloom.operators.keys import link_override

    inner = {"dns_query": "a.example", "dns_response_code": "3", "dns_answers": ["192.0.2.1"], "tls_sni": "x",
             "smb_encrypted": True, "issue_tags": ["tcp_reset"], "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2",
             "src_mac": "AA:00", "dst_mac": "bb:00"}
    df = packets([{**inner, "decoded_protocols": ["eth", "macsec", "dns"]}, {**inner, "decoded_protocols": ["ip", "dns"]}])
    first, second = link_override(df.drop("flow_key")).orderBy("frame_number").collect()
    assert (first.protocol, first.dns_query, first.dns_answers, first.tls_sni, first.smb_encrypted, first.src_ip) == (
        "MACSEC", None, [], None, False, None)
    assert (second.dns_query, second.dns_answers, second.smb_encrypted) == ("a.example", ["192.0.2.1"], True)


def test_summary_cut_only_where_asked(spark):
    from packetloom.operators import rollup

    flows = spark.createDataFrame([(f"f{k}", k, "TCP", 1000 + k, 443, 5) for k in range(1, 61)],
                                  "flow_key string, flow_id long, protocol string, port_a int, port_b int, packet_count long")
    issues = spark.createDataFrame([], "flow_key string, a_to_b boolean, issue string, n long")
    names = spark.createDataFrame([(f"f{k}", f"n{k}", 1) for k in range(1, 61)], "flow_key string, name string, position long")
    whole = rollup.summary_from_flows(flows, issues, names)
    assert whole.where("kind = 'port'").count() == 61 and whole.where("kind = 'name'").count() == 60
    saved = rollup.summary_from_flows(flows, issues, names, rollup.SAVED_MOST)
    assert saved.where("kind = 'port'").count() == 20 and saved.where("kind = 'name'").count() == 50
    first = saved.where("kind = 'port'").orderBy("rank").limit(3).collect()
    assert [(r.value, r.n) for r in first] == [("443", 300), ("1001", 5), ("1002", 5)]
