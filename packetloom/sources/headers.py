"""Header rows derived from the derived packets, in the shape of an exported capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.protocols import bgp, esp, ike, link, rtp, smb, tcp, tls
from packetloom.sources.fields import with_fields

FIELD_NAMES = sorted({*esp.FIELDS, *rtp.FIELDS, *smb.FIELDS, *tcp.TCP_FIELDS, *tcp.UDP_FIELDS,
                      *tls.FIELDS})
TCP = "protocol = 'TCP'"


def _marker(tag: str) -> str:
    return f"CASE WHEN array_contains(issue_tags, '{tag}') THEN '1' END"


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN CAST({value} AS STRING) END"


EXPRESSIONS = {
    "frame.number": "CAST(frame_number AS STRING)",
    "frame.len": "CAST(length AS STRING)",
    "frame.time_relative": "CAST(CAST(unix_micros(CAST(timestamp AS TIMESTAMP)) AS DECIMAL(20,0)) "
                           "/ 1000000 AS STRING)",
    "ip.src": "src_ip", "ip.dst": "dst_ip",
    "ip.len": "CAST(length AS STRING)",
    "tcp.srcport": _when(TCP, "src_port"), "tcp.dstport": _when(TCP, "dst_port"),
    "udp.srcport": _when("protocol = 'UDP'", "src_port"),
    "udp.dstport": _when("protocol = 'UDP'", "dst_port"),
    "tcp.window_size": _when(TCP, "k * 512"), "tcp.window_size_value": _when(TCP, "k * 4"),
    "tcp.window_size_scalefactor": _when(TCP, "shiftleft(1, CAST(k % 4 AS INT))"),
    "tcp.options.mss_val": _when(f"{TCP} AND k % 10 = 0", "1400 + k % 3"),
    "tcp.analysis.bytes_in_flight": _when(f"{TCP} AND rev", "k * 100"),
    "tcp.analysis.retransmission": _marker("tcp_retransmission"),
    "tcp.analysis.out_of_order": _marker("tcp_out_of_order"),
    "tcp.analysis.lost_segment": _marker("tcp_lost_segment"),
    "tcp.analysis.zero_window": _marker("tcp_zero_window"),
    "tcp.analysis.window_update": _when(f"{TCP} AND k % 7 = 0", "k % 2"),
    "udp.checksum.status": _when("protocol = 'UDP'", "CASE WHEN k % 30 = 0 THEN '0' ELSE '1' END"),
    "dns.id": _when("kind = 'dns'", "k"),
    "dns.flags.response": _when("kind = 'dns'", "CASE WHEN rev THEN '1' ELSE '0' END"),
    "dns.flags.rcode": "dns_response_code",
    "bootp.id": "dhcp_transaction_id", "bootp.option.dhcp": "dhcp_message_type",
    "tls.record.content_type": _when("kind = 'web'", "20 + k % 4"),
    "tls.handshake.type": _when("tls_sni IS NOT NULL", "1"),
    "tls.handshake.ciphersuite": _when("tls_sni IS NOT NULL", "'0x1301'"),
    "tls.handshake.certificate": _when("kind = 'web' AND rev AND k % 20 = 0",
                                       "CASE WHEN k % 40 = 0 THEN 'aa|bb' ELSE 'aa' END"),
    "tls.alert_message.level": "tls_alert_level", "tls.alert_message.desc": "tls_alert_description",
    "smb2.cmd": _when("kind = 'smb'", "k % 19"),
    "smb2.flags.response": _when("kind = 'smb'", "CASE WHEN rev THEN '1' ELSE '0' END"),
    "smb2.credit.charge": _when("kind = 'smb'", "1 + k % 4"),
    "smb2.credit.request_response": _when("kind = 'smb'", "k % 64"),
    "smb2.nt_status": "smb_status",
    "ip.ttl": "CAST(60 + k % 5 AS STRING)",
    "ip.dsfield.dscp": "CASE WHEN k % 2 = 0 THEN '46' ELSE '0' END",
    "ip.flags.df": "CAST(k % 2 AS STRING)",
    "ip.frag_offset": "CASE WHEN k % 50 = 0 THEN '1' ELSE '0' END",
    "esp.spi": "esp_spi", "esp.sequence": "CAST(esp_sequence AS STRING)",
    "rtp.version": _when("kind = 'rtp'", "2"),
    "rtp.ssrc": "rtp_ssrc", "rtp.seq": "CAST(rtp_sequence AS STRING)",
    "rtp.p_type": "CAST(rtp_payload_type AS STRING)",
    "_ws.col.Protocol": _when("kind = 'rtp'", "CASE WHEN srtp THEN 'SRTP' ELSE 'RTP' END"),
}
KEPT = ["flow_key", "a_to_b", "frame_number", "protocol", "decoded_protocols", "endpoint_a",
        "port_a", "endpoint_b", "port_b"]


def header_rows(pk: DataFrame) -> DataFrame:
    rows = pk.select(*KEPT, F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"),
                     *[F.expr(e).alias(n) for n, e in EXPRESSIONS.items()])
    return with_fields(rows, FIELD_NAMES)


_LISTED = {"bgp_fields": bgp.FIELDS, "macsec_fields": link.MACSEC_FIELDS, "eapol_fields": link.EAPOL_FIELDS}
CONTROL_EXPRESSIONS = {n: EXPRESSIONS[n] for n in ("frame.number", "frame.len", "frame.time_relative", "ip.src", "ip.dst")} | {
    "tcp.srcport": EXPRESSIONS["tcp.srcport"], "tcp.dstport": EXPRESSIONS["tcp.dstport"],
    "udp.srcport": EXPRESSIONS["udp.srcport"], "udp.dstport": EXPRESSIONS["udp.dstport"],
    "eth.src": "src_mac", "eth.dst": "dst_mac",
    "isakmp.version": "CAST(ike.version AS STRING)", "isakmp.ispi": "upper(ike.initiator_spi)",
    "isakmp.rspi": "ike.responder_spi", "isakmp.exchangetype": "CAST(ike.exchange_type AS STRING)",
    "isakmp.messageid": "concat('0x', lower(hex(ike.message_id)))", "isakmp.flags": "CAST(ike.flags AS STRING)",
    "isakmp.nextpayload": "CAST(ike.next_payload AS STRING)", "isakmp.length": "CAST(ike.length AS STRING)",
    "isakmp.notify.msgtype": "array_join(ike.notify_types, ',')",
    "isakmp.frag.number": "CAST(ike.fragment_number AS STRING)", "isakmp.frag.total": "CAST(ike.fragment_total AS STRING)",
    "isakmp.frag.packetid": "CAST(ike.fragment_id AS STRING)",
    "isakmp.tf.id.encr": "array_join(ike.proposal_fields['tf.id.encr'], ',')",
    "isakmp.tf.type": "array_join(ike.proposal_fields['tf.type'], ',')",
} | {name: f"array_join({column}['{name}'], ',')" for column, names in _LISTED.items() for name in names}


def control_header_rows(pk: DataFrame) -> DataFrame:
    """Header rows of IKE, BGP, MACsec and EAPOL packets."""
    rows = pk.select(*KEPT, F.coalesce("src_ip", "src_mac").alias("src"), F.coalesce("dst_ip", "dst_mac").alias("dst"),
                     *[F.expr(e).alias(n) for n, e in CONTROL_EXPRESSIONS.items()])
    return with_fields(rows, sorted({*ike.FIELDS, *bgp.FIELDS, *link.MACSEC_FIELDS, *link.EAPOL_FIELDS}))
