"""Header rows exported as tab-separated text, and the packet columns they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.names import smb_command
from packetloom.functions.parse import first_filled, marked, relative, safe_float, safe_int, vlan_stack
from packetloom.operators.keys import (
    analysable, link_override, marker, ports, tcp_issue_tags, tls_issue_tags, transport)
from packetloom.protocols.bgp import FIELDS as BGP_FIELDS
from packetloom.protocols.bgp import field_map
from packetloom.protocols.dns import dns_answers
from packetloom.protocols.ike import ike_metadata
from packetloom.protocols.link import EAPOL_FIELDS, MACSEC_FIELDS
from packetloom.protocols.rtp import rtp_header
from packetloom.protocols.smb import (
    smb_capabilities, smb_encrypted, smb_length, smb_offset)
from packetloom.protocols.tls import certificate_rows
from packetloom.schemas import CERTIFICATE, conform, field

SOURCES = ["ip.src", "ipv6.src", "eth.src", "wlan.sa"]
DESTINATIONS = ["ip.dst", "ipv6.dst", "eth.dst", "wlan.da"]


def read_field_rows(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of an export without a header line, one text column per field; empty text is null.

    A line with fewer values leaves the last fields null. `src` and `dst` are the first address of
    IPv4, IPv6, Ethernet and wireless.
    """
    schema = ", ".join(f"`{name}` string" for name in fields)
    rows = spark.read.csv(path, sep="\t", schema=schema, quote="", nullValue="", mode="PERMISSIVE")
    return with_ends(rows)


def with_ends(rows: DataFrame) -> DataFrame:
    present = set(rows.columns)

    def first(names: list[str]) -> Column:
        known = [field(n) for n in names if n in present]
        return first_filled(*known) if known else F.lit(None).cast("string")

    return rows.withColumns({"src": first(SOURCES), "dst": first(DESTINATIONS)})


def with_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """Fields that the export does not have, as null text."""
    present = set(rows.columns)
    return rows.withColumns({n: F.lit(None).cast("string") for n in names if n not in present})


# Packet columns by protocol, each from the first of its alternative fields.
PROJECTIONS: dict[str, dict[str, list[str]]] = {
    "dns": {"dns_query": ["dns.qry.name"], "dns_query_type": ["dns.qry.type"],
            "dns_response_code": ["dns.flags.rcode"]},
    "dhcp": {
        "dhcp_message_type": ["dhcp.option.dhcp", "bootp.option.dhcp"],
        "dhcp_transaction_id": ["dhcp.id", "bootp.id"],
        "dhcp_client_mac": ["dhcp.hw.mac_addr", "bootp.hw.mac_addr"],
        "dhcp_hostname": ["dhcp.option.hostname", "bootp.option.hostname"],
        "dhcp_requested_ip": ["dhcp.option.requested_ip_address",
                              "bootp.option.requested_ip_address"],
        "dhcp_your_ip": ["dhcp.ip.your", "bootp.ip.your"],
        "dhcp_server_id": ["dhcp.option.dhcp_server_id", "bootp.option.dhcp_server_id"],
        "dhcp_lease_time": ["dhcp.option.ip_address_lease_time",
                            "bootp.option.ip_address_lease_time"],
    },
    "sip": {"sip_call_id": ["sip.Call-ID", "sip.call_id"], "sip_method": ["sip.Method", "sip.method"],
            "sip_reason": ["sip.reason_phrase"], "sip_from": ["sip.from.addr", "sip.from"],
            "sip_to": ["sip.to.addr", "sip.to"]},
    "http": {"http_host": ["http.host"], "http_location": ["http.location"]},
    "esp": {"esp_spi": ["esp.spi"]},
    "tls": {"tls_sni": ["tls.handshake.extensions_server_name",
                        "ssl.handshake.extensions_server_name"],
            "tls_alert_level": ["tls.alert_message.level", "ssl.alert_message.level",
                                "dtls.alert_message.level"],
            "tls_alert_description": ["tls.alert_message.desc", "ssl.alert_message.desc",
                                      "dtls.alert_message.desc"]},
    "smb": {
        "smb_status": ["smb2.nt_status", "smb.nt_status", "smb.status"],
        "smb_message_id": ["smb2.msg_id", "smb.mid"],
        "smb_session_id": ["smb2.sesid", "smb2.session_id"],
        "smb_tree_id": ["smb2.tid", "smb.tid"],
        "smb_file_id": ["smb2.file_id", "smb2.fid", "smb.fid", "smb2.fid_hash"],
        "smb_filename": ["smb2.file", "smb.file", "smb2.filename"],
    },
}
NUMBERS = {
    "sip_status_code": ["sip.Status-Code", "sip.status_code"], "esp_sequence": ["esp.sequence"],
    "smb_create_desired_access": ["smb2.create.desired_access", "smb.create.desired_access"],
    "smb_create_file_attributes": ["smb2.create.file_attributes", "smb.file_attributes"],
}
TCP_MARKERS = ["retransmission", "fast_retransmission", "out_of_order", "duplicate_ack",
               "lost_segment", "zero_window", "zero_window_probe"]
# Certificate columns, each from the first of its alternative fields that is filled.
CERTIFICATE_FIELDS = {
    "subject": ["x509af.subject", "x509sat.printableString"], "issuer": ["x509af.issuer"],
    "serial": ["x509af.serialNumber"], "not_before": ["x509af.utcTime", "x509af.notBefore"],
    "not_after": ["x509af.generalizedTime", "x509af.notAfter"], "san": ["x509ce.dNSName"],
    "fingerprint_sha256": ["x509af.fingerprint_sha256"],
}
CERTIFICATE_NAMES = [n for names in CERTIFICATE_FIELDS.values() for n in names]


def project(rows: DataFrame, protocol: str) -> dict[str, Column]:
    """Packet columns of one protocol; only the listed fields are read."""
    present = set(rows.columns)

    def first(names: list[str]) -> Column:
        known = [field(n) for n in names if n in present]
        return first_filled(*known) if known else F.lit(None).cast("string")

    return {column: first(names) for column, names in PROJECTIONS[protocol].items()}


def layer_fields(rows: DataFrame, layer: str) -> Column:
    """Set fields of a layer by their short name, dots as underscores."""
    names = [n for n in rows.columns if n.startswith(f"{layer}.")]
    if not names:
        return F.lit(None).cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n.removeprefix(f"{layer}.").replace(".", "_")).alias("key"),
                 field(n).alias("value")) for n in names]),
        lambda e: F.coalesce(e["value"] != "", F.lit(False))))


def observe(rows: DataFrame, srtp_ports: list[int] = ()) -> DataFrame:
    """Packet observations from header rows with all protocol fields; packets that cannot be
    analysed are left out. `frame.protocols` lists the layers with colons."""
    needed = [
        "frame.number", "frame.time_epoch", "frame.time_relative", "frame.len", "frame.protocols",
        *SOURCES, *DESTINATIONS, "vlan.id", "tcp.srcport", "tcp.dstport", "udp.srcport",
        "udp.dstport", *[f"tcp.analysis.{m}" for m in TCP_MARKERS], "tcp.flags.reset",
        "tcp.analysis.ack_rtt", "tcp.analysis.initial_rtt", "rtp.version", "rtp.ssrc", "rtp.seq",
        "rtp.timestamp", "rtp.p_type", "rtp.marker", "srtp.enc_payload", "srtp.auth_tag", "dns.a",
        "dns.aaaa", "dns.resp.addr", "smb2.cmd", "smb.cmd", "smb2.flags.response",
        "smb.flags.response", *BGP_FIELDS, *MACSEC_FIELDS, *EAPOL_FIELDS,
        *CERTIFICATE_NAMES, "isakmp.version",
    ]
    from packetloom.protocols.ike import FIELDS as IKE_FIELDS

    df = with_fields(rows, [*needed, *IKE_FIELDS])
    layers = F.array_sort(F.array_distinct(F.filter(
        F.split(F.upper(F.coalesce(field("frame.protocols"), F.lit(""))), ":"), lambda n: n != "")))
    names = F.split(field("frame.protocols"), ":")
    protocol = transport(layers, F.element_at(names, -1))
    src_port, dst_port = ports((field("tcp.srcport"), field("tcp.dstport")),
                               (field("udp.srcport"), field("udp.dstport")), protocol)
    base = df.withColumns({
        "decoded_protocols": layers, "protocol": protocol, "_src_port": src_port,
        "_dst_port": dst_port, "_smb2": layer_fields(df, "smb2"), "_smb": layer_fields(df, "smb"),
    }).withColumn("_any_smb", F.coalesce("_smb2", "_smb"))
    is_tcp, is_udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    present = {m: marker(field(f"tcp.analysis.{m}")) for m in TCP_MARKERS}
    present["reset"] = marked(field("tcp.flags.reset"))
    rtp = rtp_header({
        "version": field("rtp.version"), "ssrc": field("rtp.ssrc"), "seq": field("rtp.seq"),
        "timestamp": field("rtp.timestamp"), "p_type": field("rtp.p_type"),
        "marker": field("rtp.marker"), "srtp_enc_payload": field("srtp.enc_payload"),
        "srtp_auth_tag": field("srtp.auth_tag"), "srcport": field("udp.srcport"),
        "dstport": field("udp.dstport")}, F.col("protocol"), srtp_ports)
    smb2, smb, any_smb = F.col("_smb2"), F.col("_smb"), F.col("_any_smb")
    commands = F.when(field("smb2.cmd").isNotNull(), F.transform(
        F.split(field("smb2.cmd"), ","), lambda c: smb_command(c, True))).otherwise(
            F.split(field("smb.cmd"), ","))
    empty = F.array().cast("array<string>")
    columns: dict[str, Column] = {}
    for name in PROJECTIONS:
        columns |= project(df, name)
    known = set(df.columns)
    for column, fields in NUMBERS.items():
        texts = [field(n) for n in fields if n in known]
        columns[column] = safe_int(first_filled(*texts)) if texts else F.lit(None)
    response = first_filled(field("smb2.flags.response"), field("smb.flags.response"))
    columns |= {
        "frame_number": safe_int(field("frame.number")),
        "timestamp_epoch": field("frame.time_epoch"),
        "time_relative": relative(field("frame.time_relative")).cast("string"),
        "timestamp": F.timestamp_micros((field("frame.time_epoch").try_cast("decimal(20,9)")
                                         * 1_000_000).cast("bigint")).cast("timestamp_ntz"),
        "length": F.coalesce(safe_int(field("frame.len")), F.lit(0)),
        "src_ip": first_filled(field("ip.src"), field("ipv6.src")),
        "dst_ip": first_filled(field("ip.dst"), field("ipv6.dst")),
        "src_mac": first_filled(field("eth.src"), field("wlan.sa")),
        "dst_mac": first_filled(field("eth.dst"), field("wlan.da")),
        "link_type": F.when(F.array_contains(F.col("decoded_protocols"), "ETH"), "eth").otherwise(
            "wlan"),
        "vlan_ids": F.coalesce(vlan_stack(field("vlan.id")), F.array().cast("array<int>")),
        "src_port": F.col("_src_port"), "dst_port": F.col("_dst_port"),
        "protocol": F.col("protocol"), "decoded_protocols": F.col("decoded_protocols"),
        "rtt_seconds": safe_float(field("tcp.analysis.ack_rtt")),
        "initial_rtt_seconds": safe_float(field("tcp.analysis.initial_rtt")),
        **rtp,
        "dns_answers": dns_answers(field("dns.a"), field("dns.aaaa"), field("dns.resp.addr")),
        "issue_tags": F.concat(
            F.when(is_tcp, tcp_issue_tags(present)).otherwise(empty),
            tls_issue_tags(columns["tls_alert_level"], columns["tls_alert_description"])),
        "smb_commands_seen": F.coalesce(commands, empty),
        "smb_command": F.get(commands, F.lit(0)),
        "smb_is_response": F.when(response.isNotNull(), marked(response)),
        "smb_read_length": smb_length(any_smb, "read"),
        "smb_write_length": smb_length(any_smb, "write"),
        "smb_file_offset": smb_offset(any_smb),
        "smb_encrypted": smb_encrypted(smb2),
        "smb_capabilities": smb_capabilities(smb2, smb),
        "ike": F.when(is_udp, ike_metadata()),
        "bgp_fields": F.when(is_tcp, field_map(BGP_FIELDS)),
        "macsec_fields": field_map(MACSEC_FIELDS), "eapol_fields": field_map(EAPOL_FIELDS),
    }
    observed = base.select(*[c.alias(n) for n, c in columns.items()])
    return analysable(link_override(conform(observed)))


def with_certificates(pk: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach the certificates of header rows (fields joined by `|`) to their packets."""
    df = with_fields(rows, CERTIFICATE_NAMES).select(
        safe_int(field("frame.number")).alias("frame_number"),
        *[field(n) for n in CERTIFICATE_NAMES])
    lists = {name: F.split(first_filled(*[field(n) for n in names]), r"\|") for name, names in CERTIFICATE_FIELDS.items()}
    per_packet = certificate_rows(df, lists, ["frame_number"])
    null = F.lit(None).cast("string")
    entry = F.struct("slot", F.struct(
        null.alias("presenter_ip"), F.lit(None).cast("int").alias("presenter_port"),
        null.alias("presenter_role"), F.col("subject"), F.col("subject_cn"), F.col("issuer"),
        F.col("issuer_cn"), F.col("serial"), F.col("not_before"), F.col("not_after"),
        F.col("san_dns"), F.col("fingerprint_sha256")).alias("c"))
    grouped = per_packet.groupBy("frame_number").agg(F.transform(
        F.array_sort(F.collect_list(entry)), lambda e: e["c"]).cast(f"array<{CERTIFICATE}>").alias(
            "tls_certificates"))
    return pk.drop("tls_certificates").join(grouped, "frame_number", "left")
