"""Protocols of flows from packets, counters and child tables, by direction."""

from pyspark.sql import functions as F

from packetloom.functions.protocols import BELONGS_TO, KNOWN, MASKS, known_mask, names_of, other_names
from packetloom.operators import filters, rollup

WAY = {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "src_port": 5000, "dst_port": 443, "protocol": "UDP"}
BACK = {"src_ip": "10.0.0.2", "dst_ip": "10.0.0.1", "src_port": 443, "dst_port": 5000, "protocol": "UDP"}


def sets_of(df):
    return {r.flow_key: (r.decoded_protocols, r.protocols_a_to_b, r.protocols_b_to_a) for r in df.collect()}


def test_masks_and_other_names_give_back_all_names(spark):
    assert len(KNOWN) < 63 and set(BELONGS_TO) <= set(KNOWN) and max(MASKS.values()) < 1 << 62
    rows = [(["ssl", " Isakmp ", "smb2", "", None, "odd.Name", "ODD.NAME", "mka"],), ([],), (["weird"],)]
    found = spark.createDataFrame(rows, "n array<string>").select(
        names_of(known_mask(F.col("n")), other_names(F.col("n"))).alias("names")).collect()
    assert [r.names for r in found] == [["EAPOL", "IKE", "MKA", "ODD.NAME", "SMB", "SMB2", "TLS"], [], ["WEIRD"]]


def test_packets_show_names_by_direction(packets):
    pk = packets([{**WAY, "decoded_protocols": ["ETH", "X-ONE"]}, {**WAY, "decoded_protocols": ["X-TWO", "X-ONE"]},
                  {**BACK, "dns_query": "a", "decoded_protocols": ["bootp"]}])
    (found,) = sets_of(rollup.flow_protocol_sets(pk)).values()
    assert found == (["DHCP", "DNS", "ETH", "UDP", "X-ONE", "X-TWO"], ["ETH", "UDP", "X-ONE", "X-TWO"], ["DHCP", "DNS", "UDP"])
    assert sorted(r.name for r in rollup.flow_protocol_names(pk).collect()) == found[0]


def test_counters_show_a_protocol_without_its_direction(packets):
    pk = packets([{**WAY, "tls_sni": "a.example"}, {**BACK, "smb_encrypted": True}])
    fl = rollup.flow_rollup(pk)
    (found,) = sets_of(rollup.protocol_sets(rollup.transport_evidence(fl), rollup.counter_evidence(fl))).values()
    assert found == (["DTLS", "SMB", "UDP"], ["UDP"], ["UDP"])


def test_child_tables_show_direction_without_packets(spark, packets):
    fl = rollup.flow_rollup(packets([WAY, BACK]))
    key = fl.first().flow_key
    ike = spark.createDataFrame([(key, 0x20, 2, 0), (key, 0x30, 0, 1), ("other", 0x10, 0, 0)],
                                "flow_key string, version int, a_to_b_packets long, b_to_a_packets long")
    rtp = spark.createDataFrame([(key, "B_to_A", 3)], "flow_key string, direction string, srtp_packets long")
    bgp = spark.createDataFrame([(key, 4, 0, 4), ("other", 0, 0, 0)],
                                "flow_key string, packets long, a_to_b_packets long, b_to_a_packets long")
    sets = rollup.protocol_sets(rollup.transport_evidence(fl), *rollup.child_evidence(ike, rtp, bgp))
    assert sets_of(sets) == {
        key: (["BGP", "IKE", "IKEV2", "IKEV3", "RTP", "SRTP", "UDP"], ["IKE", "IKEV2", "UDP"],
              ["BGP", "IKE", "IKEV3", "RTP", "SRTP", "UDP"]),
        "other": (["IKE", "IKEV1"], [], [])}
    flows = fl.join(sets, "flow_key")
    assert filters.filter_flows(flows, filters.FlowFilter(protocol="srtp", src="10.0.0.2")).count() == 1
    assert filters.filter_flows(flows, filters.FlowFilter(protocol="srtp", src="10.0.0.1")).count() == 0


def test_phone_search_in_stored_calls(spark, packets):
    fl = rollup.flow_rollup(packets([WAY, {**WAY, "src_ip": "10.0.0.9"}]))
    keys = sorted(r.flow_key for r in fl.collect())
    calls = spark.createDataFrame([(keys[0], "sip:+1 (555) 010@x", None)], "flow_key string, caller string, callee string")
    people = spark.createDataFrame([(keys[1], "tel:555-010-7")], "flow_key string, participant string")
    found = lambda *a: sorted(r.flow_key for r in filters.flows_by_saved_phone(fl, *a).collect())
    assert found("555 010", calls, people) == keys and found("5550107", calls, people) == keys[1:]
    assert found("555010", calls) == keys[:1] and found("555010") == [] and found("no digits", calls) == keys
