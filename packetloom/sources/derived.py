"""Packet tables derived from the `events` table, one packet per event in `event_id` order.

The column rules are plain functions of an event, so the same packets can be written in any SQL.
The derived tables are written once per session to the shared folder and read back as Parquet, like
any captured packet table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.names import SMB2_CAPABILITY_BITS
from packetloom.operators.keys import analysable, with_flow
from packetloom.operators.ordered import scan
from packetloom.schemas import conform
from packetloom.settings import scratch_path

_written: dict[tuple[str, str, str], str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS i", "ts", "user_id AS u", "event_type AS t", "value AS v",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "event_id % 3 = 0 AS rev")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `rn`, their number within (user, type), and the sequence number `sq` from it."""
    return scan(events(spark, sf_dir), ["u", "t"], "i", position="rn").selectExpr(
        "*",
        """CASE t WHEN 'error' THEN 'web' WHEN 'click' THEN 'rtp' WHEN 'purchase' THEN 'smb'
           WHEN 'signup' THEN 'esp'
           ELSE CASE u % 4 WHEN 1 THEN 'sip' WHEN 3 THEN 'dhcp' ELSE 'dns' END END AS kind""",
        "rn + CASE k % 10 WHEN 0 THEN 3 WHEN 1 THEN -2 ELSE 0 END AS sq",
    )


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


CLIENT_IP = "concat('10.0.', u div 250, '.', u % 250 + 1)"
SERVER_IP = "concat('192.0.2.', u % 5 + 1)"
CLIENT_PORT = "CASE WHEN kind <> 'esp' THEN 40000 + u % 1000 END"
SERVER_PORT = ("CASE kind WHEN 'web' THEN 443 WHEN 'smb' THEN 445 WHEN 'rtp' THEN 5004 "
               "WHEN 'dns' THEN 53 WHEN 'sip' THEN 5060 WHEN 'dhcp' THEN 67 END")
TLS_ALERT = "kind = 'web' AND k % 15 = 0"
ISSUE = """CASE k % 12 WHEN 0 THEN 'tcp_retransmission' WHEN 1 THEN 'tcp_out_of_order'
           WHEN 2 THEN 'tcp_lost_segment' WHEN 3 THEN 'tcp_zero_window' WHEN 4 THEN 'tcp_reset' END"""

PACKET_EXPRESSIONS = {
    "frame_number": "i + 1",
    "timestamp": "ts",
    "protocol": "CASE kind WHEN 'web' THEN 'TCP' WHEN 'smb' THEN 'TCP' WHEN 'esp' THEN 'ESP' "
                "ELSE 'UDP' END",
    "src_ip": f"CASE WHEN rev THEN {SERVER_IP} ELSE {CLIENT_IP} END",
    "dst_ip": f"CASE WHEN rev THEN {CLIENT_IP} ELSE {SERVER_IP} END",
    "src_port": f"CASE WHEN rev THEN {SERVER_PORT} ELSE {CLIENT_PORT} END",
    "dst_port": f"CASE WHEN rev THEN {CLIENT_PORT} ELSE {SERVER_PORT} END",
    "length": "60 + floor(v)",
    "decoded_protocols": "CASE kind WHEN 'web' THEN array('TCP', 'TLS') "
                         "WHEN 'smb' THEN array('SMB2', 'TCP') WHEN 'rtp' THEN array('RTP', 'UDP') "
                         "WHEN 'dns' THEN array('DNS', 'UDP') WHEN 'sip' THEN array('SIP', 'UDP') "
                         "WHEN 'dhcp' THEN array('DHCP', 'UDP') ELSE array('ESP') END",
    "issue_tags": f"""array_compact(array(
        CASE WHEN kind IN ('web', 'smb') THEN {ISSUE} END,
        CASE WHEN {TLS_ALERT} THEN 'tls_alert' END,
        CASE WHEN {TLS_ALERT} AND k % 2 = 0 THEN 'tls_fatal_alert' END))""",
    "rtt_seconds": _when("kind IN ('web', 'smb') AND k % 2 = 0", "v / 1e3"),
    "initial_rtt_seconds": _when("kind IN ('web', 'smb') AND rn = 1", "v / 5e2"),
    "esp_spi": _when("kind = 'esp'", "concat('0x0000000', u % 2)"),
    "esp_sequence": _when("kind = 'esp'", "greatest(1, sq)"),
    "rtp_ssrc": _when("kind = 'rtp'", "concat('0x0000000', u % 3)"),
    "rtp_sequence": _when("kind = 'rtp'", "(65530 + sq) % 65536"),
    "rtp_payload_type": _when("kind = 'rtp'", "CASE WHEN k % 2 = 0 THEN 0 ELSE 96 END"),
    "srtp": "kind = 'rtp' AND k % 4 = 0",
    "dns_query": _when("kind = 'dns'", "concat('host', k % 20, '.example')"),
    "dns_query_type": _when("kind = 'dns'", "CASE WHEN k % 2 = 0 THEN 'A' ELSE 'AAAA' END"),
    "dns_response_code": _when("kind = 'dns' AND rev", "CASE k % 5 WHEN 2 THEN '3' WHEN 3 THEN '2' "
                               "WHEN 4 THEN '5' ELSE '0' END"),
    "dns_answers": "CASE WHEN kind = 'dns' AND rev AND k % 5 < 2 "
                   "THEN array(concat('203.0.113.', k)) ELSE array() END",
    "http_host": _when("kind = 'web' AND NOT rev", "concat('host', k % 20, '.example')"),
    "http_location": _when("kind = 'web' AND rev AND k % 25 = 0",
                           "concat('https://Host', k % 20, '.example:8443/new')"),
    "tls_sni": _when("kind = 'web' AND NOT rev AND rn <= 2", "concat('host', k % 20, '.example')"),
    "tls_alert_level": _when(TLS_ALERT, "CASE WHEN k % 2 = 0 THEN '2' ELSE '1' END"),
    "tls_alert_description": _when(TLS_ALERT, "CASE WHEN k % 2 = 0 THEN '40' ELSE '0' END"),
    "sip_call_id": _when("kind = 'sip'", "concat('call-', u, '-', rn div 4)"),
    "sip_method": _when("kind = 'sip' AND NOT rev", "CASE k % 3 WHEN 0 THEN 'INVITE' "
                        "WHEN 1 THEN 'ACK' ELSE 'BYE' END"),
    "sip_status_code": _when("kind = 'sip' AND rev", "CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 180 "
                             "WHEN 2 THEN 404 WHEN 3 THEN 486 WHEN 4 THEN 503 ELSE 603 END"),
    "sip_reason": _when("kind = 'sip' AND rev AND k % 6 = 2", "'Not Found'"),
    "sip_from": _when("kind = 'sip' AND NOT rev", "concat('sip:+1-555-', 1000 + u, '@example.com')"),
    "sip_to": _when("kind = 'sip' AND NOT rev", "concat('sip:+1-555-', 2000 + k % 5, '@example.com')"),
    "dhcp_message_type": _when("kind = 'dhcp'", "CASE k % 4 WHEN 0 THEN 'Discover (1)' "
                               "WHEN 1 THEN 'Offer (2)' WHEN 2 THEN 'Request (3)' "
                               "ELSE 'ACK (5)' END"),
    "dhcp_transaction_id": _when("kind = 'dhcp'", "concat('x', rn div 4)"),
    "dhcp_client_mac": _when("kind = 'dhcp'", "concat('02:00:00:00:00:', 10 + u % 80)"),
    "dhcp_hostname": _when("kind = 'dhcp' AND k % 4 = 2", "concat('pc', u % 7)"),
    "dhcp_requested_ip": _when("kind = 'dhcp' AND k % 4 = 2", "concat('10.1.0.', k)"),
    "dhcp_your_ip": _when("kind = 'dhcp' AND k % 4 = 1", "concat('10.1.0.', k)"),
    "dhcp_server_id": _when("kind = 'dhcp' AND k % 4 = 3", "'192.0.2.1'"),
    "dhcp_lease_time": _when("kind = 'dhcp' AND k % 4 = 3", "'86400'"),
    "smb_command": _when("kind = 'smb'", "CASE k % 4 WHEN 0 THEN 'SMB2create' WHEN 3 THEN "
                         "'SMB2write' ELSE 'SMB2read' END"),
    "smb_message_id": _when("kind = 'smb'", "CAST(rn div 2 AS STRING)"),
    "smb_is_response": _when("kind = 'smb'", "rev"),
    "smb_status": _when("kind = 'smb' AND rev",
                        "CASE WHEN k % 9 = 0 THEN '0xc0000022' ELSE '0x00000000' END"),
    "smb_session_id": _when("kind = 'smb'", "concat('s', u % 3)"),
    "smb_tree_id": _when("kind = 'smb'", "concat('t', k % 40)"),
    "smb_file_id": _when("kind = 'smb' AND (k % 4 <> 0 OR rev)", "concat('f', k % 3)"),
    "smb_filename": _when("kind = 'smb' AND k % 4 = 0", "concat('file', k % 3)"),
    "smb_create_desired_access": _when("kind = 'smb' AND k % 4 = 0", "1 + k % 3"),
    "smb_read_length": _when("kind = 'smb' AND k % 4 = 1", "k * 1024"),
    "smb_write_length": _when("kind = 'smb' AND k % 4 = 3", "k * 2048"),
    "smb_file_offset": _when("kind = 'smb' AND k % 4 = 2", "rn * 4096"),
    "smb_encrypted": "kind = 'smb' AND k % 50 = 7",
    "mask": "k % 256",
    "kind": "kind",
    "rev": "rev",
    "v": "v",
    "k": "k",
    "u": "u",
}

CONTROL_EXPRESSIONS = {
    "frame_number": "i + 1",
    "timestamp": "ts",
    "protocol": "CASE i % 4 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TCP' WHEN 2 THEN 'MACSEC' "
                "ELSE 'EAPOL' END",
    "src_ip": "CASE WHEN i % 4 < 2 THEN concat('10.2.0.', 1 + CASE WHEN rev THEN 100 + u % 9 "
              "ELSE u % 9 END) END",
    "dst_ip": "CASE WHEN i % 4 < 2 THEN concat('10.2.0.', 1 + CASE WHEN rev THEN u % 9 "
              "ELSE 100 + u % 9 END) END",
    "src_port": "CASE i % 4 WHEN 0 THEN 500 WHEN 1 THEN IF(rev, 179, 50000 + u % 7) END",
    "dst_port": "CASE i % 4 WHEN 0 THEN 500 WHEN 1 THEN IF(rev, 50000 + u % 7, 179) END",
    "src_mac": "CASE WHEN i % 4 >= 2 THEN concat('02:00:00:00:00:0', IF(rev, 9, u % 5)) END",
    "dst_mac": "CASE WHEN i % 4 >= 2 THEN concat('02:00:00:00:00:0', IF(rev, u % 5, 9)) END",
    "link_type": "CASE WHEN i % 4 >= 2 THEN 'eth' END",
    "vlan_ids": "CASE WHEN i % 4 = 2 THEN array(CAST(u % 3 AS INT), 7) ELSE array() END",
    "length": "60 + floor(v)",
    "decoded_protocols": "CASE i % 4 WHEN 0 THEN array('ISAKMP', 'UDP') WHEN 1 THEN "
                         "array('BGP', 'TCP') WHEN 2 THEN array('MACSEC') ELSE array('EAPOL') END",
    "issue_tags": "CAST(array() AS ARRAY<STRING>)",
    "ike": """CASE WHEN i % 4 = 0 THEN named_struct(
        'version', CASE WHEN u % 2 = 0 THEN 32 ELSE 16 END,
        'initiator_spi', concat('a', u % 3), 'responder_spi', CASE WHEN k % 2 = 0 THEN 'b0' END,
        'exchange_type', CASE WHEN u % 2 = 0 THEN 34 + k % 5 ELSE 1 + k % 7 END,
        'message_id', k, 'flags', CASE WHEN k % 11 <> 0 THEN k % 64 END,
        'next_payload', CASE k % 6 WHEN 0 THEN 46 WHEN 1 THEN 53 ELSE 33 END,
        'length', CAST(60 + floor(v) AS BIGINT),
        'notify_types', CASE k % 10 WHEN 0 THEN array(24) WHEN 1 THEN array(16388, 16389)
                        WHEN 2 THEN array(36136, 36136) ELSE array() END,
        'fragment_number', CASE WHEN k % 7 = 1 THEN k % 4 END,
        'fragment_total', CASE WHEN k % 7 = 1 THEN 4 END,
        'fragment_id', CASE WHEN k % 7 = 1 THEN k END, 'fragment_last', NULL,
        'proposal_fields', CASE WHEN k % 5 = 2 THEN map('tf.id.encr', array('12', '12', '20'),
            'tf.type', array(CAST(k % 4 AS STRING))) ELSE map() END) END""",
    "bgp_fields": """CASE WHEN i % 4 = 1 THEN map_concat(
        map('bgp.type', array(CAST(1 + k % 5 AS STRING), '4')),
        CASE WHEN k % 5 = 2 THEN map('bgp.notify.major_error', array(CAST(1 + k % 6 AS STRING)))
        ELSE map() END) END""",
    "macsec_fields": """CASE WHEN i % 4 = 2 THEN map('macsec.AN', array(CAST(k % 4 AS STRING)),
        'macsec.PN', array(CAST(i AS STRING))) END""",
    "eapol_fields": """CASE WHEN i % 4 = 3 THEN map('eap.code', array(CAST(1 + k % 4 AS STRING)),
        'mka.actor_mn', array(concat('00:00:0', lower(hex(k % 16)), ':', lpad(lower(hex(k)), 2, '0')))
        ) END""",
    "k": "k",
    "u": "u",
}


def smb_capability_column() -> Column:
    mask = F.col("k")
    return F.when(F.expr("kind = 'smb' AND k % 10 = 3"), F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << b)) != 0, F.lit(n))
        for b, n in enumerate(SMB2_CAPABILITY_BITS)])))


def _build(df: DataFrame, expressions: dict[str, str], extra: dict[str, Column]) -> DataFrame:
    return conform(df.select(
        *[F.expr(e).alias(n) for n, e in expressions.items()],
        *[c.alias(n) for n, c in extra.items()]))


def _table(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web, SMB, RTP, DNS, SIP, DHCP and ESP packets with their flow and direction."""
    return _table(spark, sf_dir, "packets", lambda: with_flow(analysable(_build(
        numbered_events(spark, sf_dir), PACKET_EXPRESSIONS,
        {"smb_capabilities": smb_capability_column()}))))


def control_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IKE, BGP, MACsec and EAPOL packets with their flow and direction."""
    return _table(spark, sf_dir, "control", lambda: with_flow(analysable(_build(
        events(spark, sf_dir), CONTROL_EXPRESSIONS, {}))))
