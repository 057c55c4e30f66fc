"""Queries over single packets: normalisation, names, and filters."""

from pyspark.sql import functions as F

from packetloom.functions import names, parse
from packetloom.functions.protocols import canonical, expanded, packet_protocols
from packetloom.operators import filters, keys, metrics, rollup
from packetloom.operators.filters import FlowFilter
from packetloom.plans.catalog import query
from packetloom.plans.sql import FLOWS, PROTOCOL_NAMES, pk
from packetloom.protocols import dns, rtp, sip
from packetloom.settings import scratch_path, settle
from packetloom.sources import tables


@query("s01_packet_source", pk("""
SELECT frame_number, protocol, src_ip, dst_ip, src_port, dst_port, length,
  array_to_string(layers, ',') AS decoded_protocols, us FROM pk"""))
def packet_source(t):
    return t.captured.select(
        "frame_number", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "length",
        F.array_join("decoded_protocols", ",").alias("decoded_protocols"),
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))


@query("s05_detailed_tables", pk("""
SELECT flow_key, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes,
  count(*) FILTER (protocol = 'TCP') AS tcp_rows FROM pk GROUP BY flow_key"""))
def detailed_tables(t):
    path = scratch_path(t.spark, "details")
    tables.write_details(t.packets.select("flow_key", "frame_number", "length"),
                         t.headers.select("flow_key", "frame_number", "`tcp.srcport`"), path)
    stored = t.spark.read.parquet(f"{path}/packets").join(
        t.spark.read.parquet(f"{path}/headers"), ["flow_key", "frame_number"])
    return stored.groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"),
        F.count("`tcp.srcport`").alias("tcp_rows"))


@query("s06_packet_limit", pk("""
SELECT frame_number, flow_key FROM pk WHERE frame_number <= 500 AND src_ip <> '192.0.2.1'"""))
def packet_limit(t):
    first = tables.packet_limit(t.packets, 500)
    return first.where("src_ip <> '192.0.2.1'").select("frame_number", "flow_key")


@query("p01_analysable", pk("""
SELECT frame_number, src_ip FROM pk WHERE k % 13 <> 0"""))
def analysable(t):
    partial = t.packets.withColumn("dst_ip", F.expr("CASE WHEN k % 13 <> 0 THEN dst_ip END"))
    return keys.analysable(partial).select("frame_number", "src_ip")


@query("p02_transport", pk("""
SELECT frame_number, CASE kind WHEN 'web' THEN 'TCP' WHEN 'smb' THEN 'TCP' WHEN 'esp' THEN 'ESP'
  ELSE 'UDP' END AS transport FROM pk"""))
def transport(t):
    return t.packets.select("frame_number", keys.transport(
        F.col("decoded_protocols"), F.element_at("decoded_protocols", -1)).alias("transport"))


CONTROL = """WITH ct AS (SELECT event_id AS i, event_id + 1 AS frame_number, user_id AS u,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS rev, value AS v
  FROM events),
lk AS (SELECT *, CASE i % 4 WHEN 2 THEN 'MACSEC' ELSE 'EAPOL' END AS protocol,
    concat('02:00:00:00:00:0', CASE WHEN rev THEN 9 ELSE u % 5 END) AS src_mac,
    concat('02:00:00:00:00:0', CASE WHEN rev THEN u % 5 ELSE 9 END) AS dst_mac,
    concat('02:00:00:00:00:0', u % 5) AS endpoint_a, '02:00:00:00:00:09' AS endpoint_b
  FROM ct WHERE i % 4 >= 2),
lf AS (SELECT *, concat_ws('|', protocol, endpoint_a, '', endpoint_b, '', 'eth',
    CASE WHEN protocol = 'MACSEC' THEN concat(u % 3, ',7') ELSE '' END) AS flow_key,
    NOT rev AS a_to_b FROM lk)"""


@query("p03_link_override", CONTROL + """
SELECT frame_number, protocol, src_mac, dst_mac, 'eth' AS link_type FROM lk""")
def link_override(t):
    undecided = t.control.withColumns({
        "protocol": keys.transport(F.col("decoded_protocols"), F.lit("ETH")),
        "src_mac": F.upper("src_mac"), "dst_mac": F.upper("dst_mac")})
    return keys.analysable(keys.link_override(undecided)).where(
        F.col("protocol").isin(keys.LINK_PROTOCOLS)).select(
            "frame_number", "protocol", "src_mac", "dst_mac", "link_type")


@query("p04_ports", pk("SELECT frame_number, src_port, dst_port FROM pk"))
def ports(t):
    def text(name, test):
        return F.when(test, F.concat(F.lit("0x"), F.lower(F.hex(F.col(name).cast("bigint")))))

    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    src, dst = keys.ports((text("src_port", tcp), text("dst_port", tcp)),
                          (text("src_port", udp), text("dst_port", udp)), F.col("protocol"))
    return t.packets.select("frame_number", src.alias("src_port"), dst.alias("dst_port"))


@query("p05_vlan_stack", CONTROL + """
SELECT frame_number, concat(u % 3, ',', 7) AS vlan_ids FROM lk WHERE protocol = 'MACSEC'""")
def vlan_stack(t):
    text = F.concat(F.expr("u % 3").cast("string"), F.lit(",x,7,"))
    return t.control.where("protocol = 'MACSEC'").select("frame_number", F.array_join(
        parse.vlan_stack(text).cast("array<string>"), ",").alias("vlan_ids"))


@query("p06_safe_numbers", pk("""
SELECT frame_number, CASE k % 4 WHEN 3 THEN NULL ELSE k END AS number,
  CASE WHEN k % 4 = 3 THEN NULL ELSE v END AS decimal_number FROM pk"""))
def safe_numbers(t):
    text = F.expr("""CASE k % 4 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN concat('0x', hex(k))
        WHEN 2 THEN concat('00', k) ELSE 'n/a' END""")
    floating = F.expr("CASE WHEN k % 4 = 3 THEN 'n/a' ELSE CAST(v AS STRING) END")
    return t.packets.select("frame_number", parse.safe_int(text).alias("number"),
                            parse.safe_float(floating).alias("decimal_number"))


@query("p07_precise_times", pk("""
SELECT frame_number, CAST(us * 1000 + k AS VARCHAR) AS epoch_ns,
  CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(us * 1000 AS VARCHAR) END AS relative_ns FROM pk"""))
def precise_times(t):
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    whole = F.floor(us / 1_000_000).cast("string")
    part = F.lpad((us % 1_000_000).cast("string"), 6, "0")
    epoch = F.concat(whole, F.lit("."), part, F.lpad(F.col("k").cast("string"), 3, "0"))
    shown = F.when(F.expr("k % 7 = 0"), F.lit("unknown")).otherwise(
        F.concat(whole, F.lit("."), part, F.lit(" seconds")))
    return t.packets.select(
        "frame_number", parse.nanoseconds(parse.epoch(epoch)).cast("string").alias("epoch_ns"),
        parse.nanoseconds(parse.relative(shown)).cast("string").alias("relative_ns"))


@query("p08_flow_key", pk("""
SELECT frame_number, flow_key, endpoint_a, port_a, endpoint_b, port_b FROM pk"""))
def flow_key(t):
    return keys.with_flow(t.captured).select(
        "frame_number", "flow_key", "endpoint_a", "port_a", "endpoint_b", "port_b")


@query("p08_link_flow_key", CONTROL + "SELECT frame_number, flow_key, a_to_b FROM lf")
def link_flow_key(t):
    return t.control.where("address_type = 'mac'").select("frame_number", "flow_key", "a_to_b")


@query("p09_direction", pk("SELECT frame_number, a_to_b FROM pk"))
def direction(t):
    return keys.with_flow(t.captured).select("frame_number", "a_to_b")


@query("p10_labels", pk("""
SELECT frame_number, src_label AS endpoint, concat(src_label, ' -> ', dst_label) AS direction,
  concat(protocol, ' ', concat_ws(':', endpoint_a, CAST(port_a AS VARCHAR)), ' <-> ',
    concat_ws(':', endpoint_b, CAST(port_b AS VARCHAR))) AS flow FROM pk"""))
def labels(t):
    c = F.col
    return t.packets.select(
        "frame_number", keys.endpoint_label(c("src_ip"), c("src_port")).alias("endpoint"),
        keys.direction_label(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port")).alias("direction"),
        keys.flow_label(c("protocol"), c("endpoint_a"), c("port_a"), c("endpoint_b"),
                        c("port_b")).alias("flow"))


@query("p11_tcp_issue_tags", pk("""
SELECT frame_number, array_to_string([x FOR x IN [
  CASE WHEN k % 12 = 0 OR k % 5 = 0 THEN 'tcp_retransmission' END,
  CASE WHEN k % 12 = 1 THEN 'tcp_out_of_order' END, CASE WHEN k % 11 = 0 THEN 'tcp_duplicate_ack' END,
  CASE WHEN k % 12 = 2 THEN 'tcp_lost_segment' END, CASE WHEN k % 12 = 3 OR k % 13 = 0
  THEN 'tcp_zero_window' END, CASE WHEN k % 12 = 4 THEN 'tcp_reset' END] IF x IS NOT NULL], ',')
  AS tags FROM pk WHERE protocol = 'TCP'"""))
def tcp_issue_tags(t):
    def text(rest, of):
        return F.expr(f"CASE WHEN k % {of} = {rest} THEN '1' WHEN k % 2 = 0 THEN '0' END")

    fields = {"retransmission": (0, 12), "fast_retransmission": (0, 5), "out_of_order": (1, 12),
              "duplicate_ack": (0, 11), "lost_segment": (2, 12), "zero_window": (3, 12),
              "zero_window_probe": (0, 13), "reset": (4, 12)}
    present = {name: keys.marker(text(*rule)) for name, rule in fields.items()}
    return t.packets.where("protocol = 'TCP'").select(
        "frame_number", F.array_join(keys.tcp_issue_tags(present), ",").alias("tags"))


@query("p12_tls_issue_tags", pk("""
SELECT frame_number, CASE WHEN fatal THEN 'tls_alert,tls_fatal_alert' WHEN alerted
  THEN 'tls_alert' ELSE '' END AS tags FROM pk"""))
def tls_issue_tags(t):
    return t.packets.select("frame_number", F.array_join(keys.tls_issue_tags(
        F.col("tls_alert_level"), F.col("tls_alert_description")), ",").alias("tags"))


NAME = "CASE k % 6 WHEN 0 THEN ' isakmp' WHEN 1 THEN 'BootP' WHEN 2 THEN 'ssl' WHEN 3 THEN 'ikev2' WHEN 4 THEN 'icmp6' ELSE 'srtp' END"


@query("p13_canonical_names", pk(f"""
SELECT frame_number, CASE k % 6 WHEN 0 THEN 'IKE' WHEN 1 THEN 'DHCP' WHEN 2 THEN 'TLS'
  WHEN 3 THEN 'IKEV2' WHEN 4 THEN 'ICMPV6' ELSE 'SRTP' END AS name,
  CASE k % 6 WHEN 0 THEN 'IKE,SMB,SMB2' WHEN 1 THEN 'DHCP,SMB,SMB2' WHEN 2 THEN 'SMB,SMB2,TLS'
  WHEN 3 THEN 'IKE,IKEV2,SMB,SMB2' WHEN 4 THEN 'ICMPV6,SMB,SMB2' ELSE 'RTP,SMB,SMB2,SRTP' END
  AS closure FROM pk"""))
def canonical_names(t):
    name = F.expr(NAME)
    return t.packets.select("frame_number", canonical(name).alias("name"), F.array_join(
        expanded(F.array(name, F.lit("smb2"), F.lit(""))), ",").alias("closure"))


@query("p14_packet_protocols", pk(PROTOCOL_NAMES + """
SELECT frame_number, string_agg(name, ',' ORDER BY name) AS names FROM pn GROUP BY frame_number"""))
def packet_protocol_names(t):
    return t.packets.select("frame_number", F.array_join(packet_protocols(), ",").alias("names"))


def by_way(sets):
    return sets.select("flow_key", *[F.array_join(c, ",").alias(c) for c in sets.columns[1:]])


@query("p15_flow_protocols", pk(PROTOCOL_NAMES + FLOWS + """
, n AS (SELECT flow_key, name, a_to_b, NOT a_to_b AS b_to_a FROM pn
  UNION ALL SELECT flow_key, protocol, TRUE, TRUE FROM fl
  UNION ALL SELECT flow_key, 'DNS', FALSE, FALSE FROM pk WHERE dns_query IS NOT NULL),
m AS (SELECT flow_key, name, bool_or(a_to_b) AS ab, bool_or(b_to_a) AS ba FROM n GROUP BY ALL)
SELECT flow_key, string_agg(name, ',' ORDER BY name) AS decoded_protocols,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ab), '') AS protocols_a_to_b,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ba), '') AS protocols_b_to_a FROM m GROUP BY flow_key"""))
def flow_protocols(t):
    return by_way(rollup.protocol_sets(
        rollup.packet_evidence(t.packets), rollup.transport_evidence(t.flows), rollup.counter_evidence(t.flows)))


@query("p15_media_from_streams", pk(FLOWS + """
, m AS (SELECT flow_key, src_label, a_to_b, bool_or(srtp) AS srtp FROM pk WHERE kind = 'rtp' GROUP BY ALL),
n AS (SELECT flow_key, 'RTP' AS name, a_to_b AS ab, NOT a_to_b AS ba FROM m
  UNION ALL SELECT flow_key, 'SRTP', a_to_b, NOT a_to_b FROM m WHERE srtp
  UNION ALL SELECT flow_key, protocol, TRUE, TRUE FROM fl),
x AS (SELECT flow_key, name, bool_or(ab) AS ab, bool_or(ba) AS ba FROM n GROUP BY ALL)
SELECT flow_key, string_agg(name, ',' ORDER BY name) AS decoded_protocols,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ab), '') AS protocols_a_to_b,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ba), '') AS protocols_b_to_a FROM x GROUP BY flow_key"""))
def media_from_streams(t):
    """Protocols of flows without looking at packets: their transport and their stored streams."""
    return by_way(rollup.protocol_sets(
        rollup.transport_evidence(t.flows), *rollup.child_evidence(rtp_streams=rtp.rtp_streams(t.packets))))


def sql_case(column, mapping, otherwise):
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


@query("p16_smb_names", pk(f"""
, x AS (SELECT frame_number, CAST(k AS VARCHAR) AS code, CASE WHEN k % 9 = 0 THEN '0xc0000022'
  WHEN k % 9 = 1 THEN concat('0xc00000', lpad(lower(hex(k)), 2, '0'))
  WHEN k % 9 = 2 THEN 'STATUS_PENDING (0x00000103)' ELSE 'n/a' END AS status FROM pk)
SELECT frame_number, {sql_case("code", names.SMB1_NAMES, "code")} AS smb1,
  {sql_case("code", names.SMB2_NAMES, "code")} AS smb2,
  CASE WHEN status LIKE 'STATUS_PENDING%' THEN 'STATUS_PENDING' WHEN status = 'n/a' THEN status
    ELSE {sql_case("status", names.NT_STATUSES, "concat('NTSTATUS_UNKNOWN(', status, ')')")} END
    AS status FROM x"""))
def smb_names(t):
    code = F.col("k").cast("string")
    status = F.expr("""CASE WHEN k % 9 = 0 THEN '0xc0000022' WHEN k % 9 = 1 THEN
        concat('0xc00000', lpad(lower(hex(k)), 2, '0')) WHEN k % 9 = 2
        THEN 'STATUS_PENDING (0x00000103)' ELSE 'n/a' END""")
    return t.packets.select(
        "frame_number", names.smb1_label(code).alias("smb1"),
        names.smb_command(code, True).alias("smb2"), names.smb_status_text(status).alias("status"))


ALERT = sql_case("CAST(k AS VARCHAR)", names.TLS_ALERT_DESCRIPTIONS, "concat('unknown_alert_', k)")


@query("p17_tls_alert_labels", pk(f"""
SELECT frame_number, concat(CASE WHEN k % 3 = 1 THEN 'warning' WHEN k % 3 = 2 THEN 'fatal'
    ELSE 'unknown_alert_0' END, ' (', k % 3, ') ', {ALERT}, ' (', k, ')') AS label FROM pk"""))
def tls_alert_labels(t):
    return t.packets.select("frame_number", names.tls_alert_label(
        F.expr("CAST(k % 3 AS STRING)"), F.concat(F.lit("code "), F.col("k").cast("string"))
    ).alias("label"))


def ike_case(table, column):
    return (f"CASE WHEN u % 2 = 0 THEN {sql_case(column, table[1], chr(39) + 'Unknown' + chr(39))} "
            f"ELSE {sql_case(column, table[2], chr(39) + 'Unknown' + chr(39))} END")


@query("p18_ike_names", pk(f"""
SELECT frame_number, concat(k, ': ', {ike_case(names.IKE_EXCHANGES, 'CAST(k AS VARCHAR)')}) AS exchange,
  concat(16360 + k, ': ', {ike_case(names.IKE_NOTIFICATIONS, 'CAST(16360 + k AS VARCHAR)')})
  AS notification FROM pk"""))
def ike_names(t):
    major = F.expr("CASE WHEN u % 2 = 0 THEN 1 ELSE 2 END")
    return t.packets.select(
        "frame_number", names.ike_exchange(major, F.col("k")).alias("exchange"),
        names.ike_notification(major, F.col("k") + 16360).alias("notification"))


@query("p19_dns_codes", pk("""
, x AS (SELECT frame_number, CASE k % 9 WHEN 0 THEN '0' WHEN 1 THEN 'No error' WHEN 2 THEN '3'
  WHEN 3 THEN 'SERVFAIL (2)' WHEN 4 THEN '5' WHEN 5 THEN '4' WHEN 6 THEN 'FormErr' WHEN 7
  THEN '0 ok' ELSE '9' END AS code FROM pk)
SELECT frame_number, code IN ('0', 'No error', '0 ok') AS success,
  CASE code WHEN '3' THEN 'NXDOMAIN: queried name does not exist' WHEN 'SERVFAIL (2)'
  THEN 'SERVFAIL: DNS server failed to answer' WHEN '5' THEN 'REFUSED: DNS server refused the query'
  WHEN '4' THEN 'NOTIMP: DNS server does not support the requested operation' WHEN 'FormErr'
  THEN 'FORMERR: DNS server could not understand the query'
  ELSE concat('DNS error response: ', code) END AS explanation FROM x"""))
def dns_codes(t):
    code = F.expr("""CASE k % 9 WHEN 0 THEN '0' WHEN 1 THEN 'No error' WHEN 2 THEN '3'
        WHEN 3 THEN 'SERVFAIL (2)' WHEN 4 THEN '5' WHEN 5 THEN '4' WHEN 6 THEN 'FormErr'
        WHEN 7 THEN '0 ok' ELSE '9' END""")
    return t.packets.select("frame_number", names.dns_success(code).alias("success"),
                            names.dns_explain(code).alias("explanation"))


@query("p20_sip_statuses", pk("""
SELECT frame_number, concat_ws(' ', CAST(sip_status_code AS VARCHAR), sip_reason) AS status,
  CASE WHEN sip_status_code < 400 THEN NULL WHEN sip_status_code < 500
  THEN 'client failure response' WHEN sip_status_code < 600 THEN 'server failure response'
  ELSE 'global failure response' END AS class FROM pk WHERE sip_status_code IS NOT NULL"""))
def sip_statuses(t):
    code = F.col("sip_status_code")
    return t.packets.where(code.isNotNull()).select(
        "frame_number", names.sip_status(code, F.col("sip_reason")).alias("status"),
        names.sip_class(code).alias("class"))


MASK = "array_to_string([x FOR x IN [" + ", ".join(
    f"CASE WHEN (k & {1 << b}) <> 0 THEN '{n}' END"
    for b, n in enumerate(names.SMB2_CAPABILITY_BITS)) + "] IF x IS NOT NULL], ',')"


@query("p21_capability_masks", pk(f"SELECT frame_number, {MASK} AS labels FROM pk"))
def capability_masks(t):
    return t.packets.select("frame_number", F.array_join(
        names.smb_mask_labels(F.col("mask")), ",").alias("labels"))


@query("p22_smb_wide_numbers", pk("""
SELECT frame_number, CASE WHEN k % 3 = 0 THEN k ELSE 7 END + CASE WHEN k % 5 = 0
  THEN 2 * 4294967296 ELSE 0 END AS length, k * 16 + CASE WHEN k % 5 = 0 THEN 4294967296 ELSE 0 END
  AS file_offset FROM pk WHERE kind = 'smb'"""))
def smb_wide_numbers(t):
    from packetloom.protocols.smb import smb_length, smb_offset

    fields = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.expr(test), F.struct(F.lit(name).alias("key"), F.expr(value).alias("value")))
        for name, test, value in (
            ("read_length", "k % 3 = 0", "CAST(k AS STRING)"),
            ("read_length_high", "k % 3 = 0 AND k % 5 = 0", "'2'"),
            ("count_low", "TRUE", "'7'"), ("count_high", "k % 5 = 0", "'2'"),
            ("offset_low", "TRUE", "concat('0x', hex(k * 16))"), ("offset_high", "k % 5 = 0", "'1'"),
        )])))
    return t.packets.where("kind = 'smb'").withColumn("fields", fields).select(
        "frame_number", smb_length(F.col("fields"), "read").alias("length"),
        smb_offset(F.col("fields")).alias("file_offset"))


@query("p23_create_intents", pk("""
SELECT frame_number, CASE WHEN k % 7 = 0 THEN '' ELSE array_to_string([x FOR x IN [
  CASE WHEN (smb_access & 1) <> 0 THEN 'read' END, CASE WHEN (smb_access & 6) <> 0 THEN 'write' END]
  IF x IS NOT NULL], ',') END AS intents FROM pk WHERE smb_access IS NOT NULL"""))
def create_intents(t):
    attributes = F.expr("CASE WHEN k % 7 = 0 THEN 16L ELSE 1L END")
    return t.packets.where("smb_create_desired_access IS NOT NULL").select(
        "frame_number", F.array_join(names.smb_create_intents(
            F.col("smb_create_desired_access"), attributes), ",").alias("intents"))


@query("p24_certificate_rows", pk("""
, x AS (SELECT frame_number, unnest(CASE WHEN k % 3 = 0 THEN [0, 1] ELSE [0] END) AS slot, k
    FROM pk WHERE kind = 'web' AND rev)
SELECT frame_number, CASE WHEN slot = 0 THEN concat('host', k, '.example') ELSE 'Root' END AS subject_cn,
  CASE WHEN slot = 0 THEN CAST(k AS VARCHAR) END AS serial, CASE WHEN slot = 0
  THEN concat('a', k, '|b') ELSE '' END AS san FROM x"""))
def certificate_rows(t):
    from packetloom.protocols import tls

    def texts(value):
        return F.split(F.expr(value), r"\|")

    lists = {
        "subject": texts("concat('O=X, CN=host', k, '.example', CASE WHEN k % 3 = 0 "
                         "THEN '|cn=Root' ELSE '' END)"),
        "issuer": texts("concat('CN=Root', CASE WHEN k % 3 = 0 THEN '|CN=Root' ELSE '' END)"),
        "serial": texts("CAST(k AS STRING)"), "not_before": texts("'2024-01-01'"),
        "not_after": texts("'2025-01-01'"), "san": texts("concat('a', k, ', b')"),
        "fingerprint_sha256": texts("concat('f', k)"),
    }
    rows = tls.certificate_rows(t.packets.where("kind = 'web' AND rev"), lists, ["frame_number"])
    return rows.select("frame_number", "subject_cn", "serial", F.array_join("san_dns", "|").alias("san"))


@query("p26_rtp_header", pk("""
SELECT frame_number, CASE WHEN k % 5 <> 0 THEN rtp_ssrc END AS rtp_ssrc, CASE WHEN k % 5 <> 0
  THEN rtp_sequence END AS rtp_sequence, k % 5 <> 0 AND (src_port = 40007 OR dst_port = 40007
  OR k % 4 = 0) AS srtp FROM pk WHERE kind = 'rtp'"""))
def rtp_header(t):
    c = F.col
    none = F.lit(None).cast("string")
    header = rtp.rtp_header({
        "version": F.expr("CASE WHEN k % 5 = 0 THEN '1' ELSE '2' END"), "ssrc": c("rtp_ssrc"),
        "seq": c("rtp_sequence").cast("string"), "timestamp": none, "p_type": none, "marker": none,
        "srtp_enc_payload": F.expr("CASE WHEN k % 4 = 0 THEN 'ab' END"), "srtp_auth_tag": none,
        "srcport": c("src_port").cast("string"), "dstport": c("dst_port").cast("string"),
    }, c("protocol"), [40007])
    return t.packets.where("kind = 'rtp'").select(
        "frame_number", *[header[n].alias(n) for n in ("rtp_ssrc", "rtp_sequence", "srtp")])


@query("p27_smb_encrypted", pk("""
SELECT frame_number, k % 7 = 0 OR k % 11 = 0 AS encrypted FROM pk WHERE kind = 'smb'"""))
def smb_encrypted(t):
    from packetloom.protocols.smb import smb_encrypted as encrypted

    fields = F.create_map(
        F.lit("transform_signature"), F.expr("CASE WHEN k % 7 = 0 THEN 'ab' ELSE '0' END"),
        F.lit("own_Transform_flag"), F.expr("CASE WHEN k % 11 = 0 THEN '1' ELSE '' END"),
        F.lit("cmd"), F.lit("5"))
    return t.packets.where("kind = 'smb'").select("frame_number", encrypted(fields).alias("encrypted"))


@query("p28_smb_capabilities", pk("""
SELECT frame_number, array_to_string([x FOR x IN [
  CASE WHEN k % 2 = 0 THEN 'signing required' END, CASE WHEN (k & 1) <> 0 THEN 'DFS' END,
  CASE WHEN (k & 2) <> 0 THEN 'leasing' END, CASE WHEN k % 3 = 0 THEN 'encryption' END,
  CASE WHEN k % 5 = 0 THEN 'large ReadX' END, 'dialect=0x0311', 'security_mode=1'] IF x IS NOT NULL], ',')
  AS capabilities FROM pk WHERE kind = 'smb'"""))
def smb_capabilities(t):
    from packetloom.protocols.smb import smb_capabilities as capabilities

    smb2 = F.create_map(
        F.lit("sec_mode_sign_required"), F.expr("CASE WHEN k % 2 = 0 THEN 'True' ELSE '0' END"),
        F.lit("capabilities"), F.expr("concat('0x', hex(k & 3))"),
        F.lit("encryption_context"), F.expr("CASE WHEN k % 3 = 0 THEN '1' ELSE '' END"),
        F.lit("dialect"), F.lit("0x0311"))
    smb1 = F.create_map(
        F.lit("server_cap_large_readx"), F.expr("CASE WHEN k % 5 = 0 THEN '1' ELSE 'false' END"),
        F.lit("sm"), F.lit("1"))
    return t.packets.where("kind = 'smb'").select(
        "frame_number", F.array_join(capabilities(smb2, smb1), ",").alias("capabilities"))


@query("p29_dns_answers", pk("""
SELECT frame_number, concat('10.0.0.', k, CASE WHEN k % 2 = 0 THEN ',10.9.9.9' ELSE '' END,
  CASE WHEN k % 3 = 0 THEN ',::1' ELSE '' END) AS answers FROM pk WHERE kind = 'dns'"""))
def dns_answers(t):
    a = F.expr("concat('10.0.0.', k, CASE WHEN k % 2 = 0 THEN ', 10.9.9.9,' ELSE '' END)")
    aaaa = F.expr("CASE WHEN k % 3 = 0 THEN ' ::1' END")
    return t.packets.where("kind = 'dns'").select("frame_number", F.array_join(
        dns.dns_answers(a, aaaa, F.lit(None).cast("string")), ",").alias("answers"))


SELECTED = "SELECT frame_number FROM pk WHERE "


def packets_where(t, **options):
    return filters.filter_packets(t.packets, FlowFilter(**options)).select("frame_number")


@query("f01_host_or_peer", pk(SELECTED + """src_ip IN ('10.0.0.2', '10.0.0.3')
  OR dst_ip IN ('10.0.0.2', '10.0.0.3')"""))
def host(t):
    return packets_where(t, host=["10.0.0.2", "10.0.0.3"])


@query("f02_host_and_peer", pk(SELECTED + """
  (src_ip IN ('10.0.0.2', '192.0.2.1') AND dst_ip IN ('192.0.2.2', '10.0.0.6'))
  OR (dst_ip IN ('10.0.0.2', '192.0.2.1') AND src_ip IN ('192.0.2.2', '10.0.0.6'))"""))
def host_and_peer(t):
    return packets_where(t, host=["10.0.0.2", "192.0.2.1"], peer=["192.0.2.2", "10.0.0.6"])


@query("f03_protocol", pk(SELECTED + "kind IN ('web', 'rtp')"))
def protocol(t):
    return packets_where(t, protocol=["ssl", "RTP"])


@query("f04_port", pk(SELECTED + "src_port IN (443, 0) OR dst_port IN (443, 0)"))
def port(t):
    return packets_where(t, port=[443, 0])


@query("f05_directional", pk(SELECTED + """src_ip = '10.0.0.2' AND dst_ip IN ('192.0.2.2', '192.0.2.3')
  AND src_port = 40001 AND dst_port IN (443, 445, 5004)"""))
def directional(t):
    return packets_where(t, src="10.0.0.2", dst=["192.0.2.2", "192.0.2.3"], src_port=40001,
                         dst_port=[443, 445, 5004])


@query("f06_any_option", pk(SELECTED + """src_ip = '10.0.0.2' OR dst_port = 53 OR src_port = 445
  OR dst_port = 445 OR kind = 'esp'"""))
def any_option(t):
    return packets_where(t, src="10.0.0.2", dst_port=53, port=445, protocol="esp", match_any=True)


@query("f06_no_option", pk("SELECT frame_number FROM pk"))
def no_option(t):
    return packets_where(t)


@query("f07_mac_endpoints", CONTROL + """
SELECT frame_number FROM lk WHERE src_mac IN ('02:00:00:00:00:01', '02:00:00:00:00:02')""")
def mac_endpoints(t):
    upper = t.control.where("address_type = 'mac'").withColumn(
        "src_endpoint", F.upper("src_endpoint"))
    return filters.filter_packets(upper, FlowFilter(
        src=["02:00:00:00:00:01", "02:00:00:00:00:02"])).select("frame_number")


@query("f08_packets_of_protocol_and_port", pk(SELECTED + """
  kind = 'sip' AND (src_port = 5060 OR dst_port = 5060) AND (src_ip = '192.0.2.2' OR dst_ip = '192.0.2.2')
"""))
def packets_of_protocol_and_port(t):
    return packets_where(t, protocol="SIP", port=5060, host="192.0.2.2")


def flows_with_names(t):
    return t.flows.join(rollup.flow_protocol_sets(t.packets), "flow_key")


@query("f09_flows_in_one_direction", pk("""
SELECT DISTINCT flow_key FROM pk WHERE dst_port = 443 AND dst_ip IN ('192.0.2.1', '192.0.2.2')
  AND src_port IN (40000, 40001, 40005)"""))
def flows_in_one_direction(t):
    return filters.filter_flows(flows_with_names(t), FlowFilter(
        dst_port=443, dst=["192.0.2.1", "192.0.2.2"], src_port=[40000, 40001, 40005],
        protocol="TLS")).select("flow_key")


@query("f09_flows_by_stored_streams", pk("""
SELECT DISTINCT flow_key FROM pk WHERE kind = 'rtp' AND srtp AND dst_port = 5004"""))
def flows_by_stored_streams(t):
    """Directional selection of flows whose packets are gone: their streams tell which way media went."""
    sets = rollup.protocol_sets(
        rollup.transport_evidence(t.flows), *rollup.child_evidence(rtp_streams=rtp.rtp_streams(t.packets)))
    return filters.filter_flows(t.flows.join(sets, "flow_key"), FlowFilter(
        dst_port=5004, protocol="srtp")).select("flow_key")


@query("f09_flows_by_any", pk(FLOWS + PROTOCOL_NAMES + """
SELECT flow_key FROM fl WHERE endpoint_a = '10.0.0.3' OR endpoint_b = '10.0.0.3'
UNION SELECT flow_key FROM pn WHERE name = 'DNS' UNION SELECT flow_key FROM pk WHERE src_port = 5060"""))
def flows_by_any(t):
    return filters.filter_flows(flows_with_names(t), FlowFilter(
        host="10.0.0.3", protocol="dns", src_port=5060, match_any=True)).select("flow_key")


def saved_and_read(t):
    """All flows written as summary documents of 50 flows and read again."""
    path = scratch_path(t.spark, "summary")
    named = t.ranked_facts.join(rollup.flow_protocol_sets(t.packets), "flow_key", "left")
    tables.write_summary(named, path, 50)
    return tables.flows_of_summary(tables.read_summary(t.spark, path))


@query("s03_saved_flows_in_one_direction", pk("""
SELECT DISTINCT flow_key FROM pk WHERE dst_port = 443 AND dst_ip IN ('192.0.2.1', '192.0.2.2')
  AND src_port IN (40000, 40001, 40005)"""))
def saved_flows_in_one_direction(t):
    return filters.filter_flows(saved_and_read(t), FlowFilter(
        dst_port=443, dst=["192.0.2.1", "192.0.2.2"], src_port=[40000, 40001, 40005],
        protocol="TLS")).select("flow_key")


@query("s04_summary_round_trip", pk(FLOWS + """
, tg AS (SELECT flow_key, count(*) FILTER (tcp_tag = 'tcp_retransmission') AS tcp_retransmission,
    count(*) FILTER (tcp_tag = 'tcp_reset' AND a_to_b) AS a_to_b_tcp_reset FROM pk GROUP BY flow_key)
SELECT flow_key, protocol, endpoint_a, port_a, endpoint_b, port_b, packet_count, byte_count, a_to_b_packets,
  b_to_a_packets, a_to_b_bytes, b_to_a_bytes, duration_s, tcp_retransmission, a_to_b_tcp_reset
FROM fl JOIN tg USING (flow_key)"""))
def summary_round_trip(t):
    return metrics.with_duration(saved_and_read(t)).select(
        "flow_key", "protocol", "endpoint_a", "port_a", "endpoint_b", "port_b", "packet_count", "byte_count",
        "a_to_b_packets", "b_to_a_packets", "a_to_b_bytes", "b_to_a_bytes", "duration_s", "tcp_retransmission",
        "a_to_b_tcp_reset")


@query("f11_endpoint_pair", pk(SELECTED + """
  (src_ip = '10.0.0.2' AND dst_ip = '192.0.2.2' AND src_port = 40001 AND dst_port = 443)
  OR (src_ip = '192.0.2.2' AND dst_ip = '10.0.0.2' AND src_port = 443 AND dst_port = 40001)"""))
def endpoint_pair(t):
    c = F.col
    return t.packets.where(filters.endpoint_pair(
        "10.0.0.2", 40001, "192.0.2.2", 443, src=c("src_ip"), dst=c("dst_ip"),
        src_port=c("src_port"), dst_port=c("dst_port"))).select("frame_number")


@query("f12_tool_rows", pk("""
SELECT tool, count(*) AS n FROM (SELECT unnest(CASE kind WHEN 'web' THEN ['deep_tcp_flow',
  'deep_tls_flow'] WHEN 'smb' THEN ['deep_tcp_flow', 'deep_smb2_flow'] WHEN 'esp'
  THEN ['deep_esp_flow'] WHEN 'rtp' THEN ['deep_udp_flow', 'deep_rtp_flow']
  ELSE ['deep_udp_flow'] END) AS tool FROM pk) GROUP BY tool"""))
def tool_rows(t):
    from packetloom.operators.deep import listed_rows

    return listed_rows(t.headers).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("f13_flows_by_phone", pk("""
SELECT DISTINCT flow_key FROM pk WHERE regexp_replace(coalesce(sip_from, ''), '[^0-9]', '', 'g')
  LIKE '%5551005%' OR regexp_replace(coalesce(sip_to, ''), '[^0-9]', '', 'g') LIKE '%5551005%'"""))
def flows_by_phone(t):
    return filters.flows_by_phone(t.flows, t.packets, "555-1005").select("flow_key")


@query("f13_flows_by_saved_phone", pk("""
SELECT DISTINCT flow_key FROM pk WHERE regexp_replace(coalesce(sip_from, ''), '[^0-9]', '', 'g')
  LIKE '%5551005%' OR regexp_replace(coalesce(sip_to, ''), '[^0-9]', '', 'g') LIKE '%5551005%'"""))
def flows_by_saved_phone(t):
    """The same flows from stored calls and participants."""
    calls = settle(sip.sip_calls(t.packets).select("flow_key", "caller", "callee"), "calls")
    participants = settle(sip.sip_participants(t.packets).select("flow_key", "participant"), "participants")
    return filters.flows_by_saved_phone(t.flows, "555-1005", calls, participants).select("flow_key")
