"""Queries over one protocol's records, and the detail tables built from them."""

from pyspark.sql import functions as F

from packetloom.functions import names
from packetloom.operators import evidence, metrics, rollup
from packetloom.plans import report
from packetloom.plans.catalog import QUERIES, query
from packetloom.plans.packets import CONTROL, MASK
from packetloom.plans.related import SMB_OPS
from packetloom.plans.sequences import PAUSE_MS, WINDOWS
from packetloom.plans.sql import FLOWS, PROTOCOL_NAMES, pk
from packetloom.plans.flows import ESP_FLOWS, tag_rates
from packetloom.protocols import bgp, dhcp, dns, ike, link, sip, smb, tls

IKE = CONTROL + """,
ik AS (SELECT *, concat('10.2.0.', 1 + u % 9) AS low, concat('10.2.0.', 101 + u % 9) AS far,
    CASE WHEN u % 2 = 0 THEN 32 ELSE 16 END AS version, CASE WHEN u % 2 = 0 THEN 2 ELSE 1 END AS major,
    concat('a', u % 3) AS initiator_spi, CASE WHEN k % 2 = 0 THEN 'b0' END AS responder_spi,
    CASE WHEN u % 2 = 0 THEN 34 + k % 5 ELSE 1 + k % 7 END AS exchange,
    CASE WHEN k % 11 <> 0 THEN k % 64 END AS flags,
    CASE k % 6 WHEN 0 THEN 46 WHEN 1 THEN 53 ELSE 33 END AS next_payload
  FROM ct WHERE i % 4 = 0),
kf AS (SELECT *, concat_ws('|', 'UDP', least(low, far), '500', greatest(low, far), '500') AS flow_key,
    (low < far) <> rev AS forward FROM ik)"""


def ike_named(table, column):
    whens = " ".join(f"WHEN major = {m} AND {column} = {c} THEN '{n}'"
                     for m, t in table.items() for c, n in t.items())
    return f"concat({column}, ': ', CASE {whens} ELSE 'Unknown' END)"


@query("a15_ike_sessions", IKE + """
SELECT flow_key, version, initiator_spi, responder_spi, min(frame_number) AS first_at,
  count(*) FILTER (forward) AS a_to_b_packets, count(*) FILTER (NOT forward) AS b_to_a_packets,
  count(*) FILTER ((major = 1 AND (flags & 1) <> 0) OR (major = 2 AND next_payload IN (46, 53)))
    AS encrypted_packets, count(*) FILTER (k % 7 = 1) AS fragmented_packets,
  count(*) FILTER (major = 2 AND (flags & 32) = 0) AS v2_requests,
  count(*) FILTER (major = 2 AND (flags & 32) <> 0) AS v2_responses FROM kf GROUP BY 1, 2, 3, 4""")
def ike_sessions(t):
    return ike.ike_sessions(t.control)


@query("a15_ike_counts", IKE + f"""
, nt AS (SELECT *, unnest(CASE k % 10 WHEN 0 THEN [24] WHEN 1 THEN [16388, 16389]
    WHEN 2 THEN [36136, 36136] ELSE [] END) AS code FROM kf),
pv AS (SELECT *, unnest(['12', '12', '20']) AS value FROM kf WHERE k % 5 = 2)
SELECT flow_key, version, initiator_spi, responder_spi, kind, value, count(*) AS n FROM (
  SELECT flow_key, version, initiator_spi, responder_spi, 'exchange' AS kind,
    {ike_named(names.IKE_EXCHANGES, 'exchange')} AS value FROM kf
  UNION ALL SELECT flow_key, version, initiator_spi, responder_spi, 'notification',
    {ike_named(names.IKE_NOTIFICATIONS, 'code')} FROM nt
  UNION ALL SELECT flow_key, version, initiator_spi, responder_spi, 'tf.id.encr', value FROM pv
  UNION ALL SELECT flow_key, version, initiator_spi, responder_spi, 'tf.type',
    CAST(k % 4 AS VARCHAR) FROM kf WHERE k % 5 = 2) GROUP BY ALL""")
def ike_counts(t):
    return ike.ike_counts(t.control)


BGP = CONTROL + """,
bg AS (SELECT *, concat('10.2.0.', 1 + u % 9) AS low, concat('10.2.0.', 101 + u % 9) AS far,
    50000 + u % 7 AS port FROM ct WHERE i % 4 = 1),
bf AS (SELECT *, CASE WHEN low < far THEN concat_ws('|', 'TCP', low, port, far, 179)
    ELSE concat_ws('|', 'TCP', far, 179, low, port) END AS flow_key, (low < far) <> rev AS a_to_b
  FROM bg),
bv AS (SELECT *, unnest([CAST(1 + k % 5 AS VARCHAR), '4']) AS value, 'bgp.type' AS field FROM bf
  UNION ALL SELECT *, CAST(1 + k % 6 AS VARCHAR), 'bgp.notify.major_error' FROM bf WHERE k % 5 = 2)"""


@query("a16_bgp_summary", BGP + """
SELECT flow_key, a_to_b, field, value, count(*) AS n FROM bv GROUP BY ALL""")
def bgp_summary(t):
    return bgp.bgp_summary(t.control)


@query("a16_bgp_packets", BGP + """
SELECT flow_key, count(*) AS packets, count(*) FILTER (a_to_b) AS a_to_b_packets,
  count(*) FILTER (NOT a_to_b) AS b_to_a_packets FROM bf GROUP BY flow_key""")
def bgp_packets(t):
    return bgp.bgp_packets(t.control)


@query("p15_control_from_children", IKE + BGP.removeprefix(CONTROL) + """,
n AS (SELECT flow_key, concat('IKEV', version // 16) AS name, forward AS ab FROM kf
  UNION ALL SELECT flow_key, 'IKE', forward FROM kf UNION ALL SELECT flow_key, 'BGP', a_to_b FROM bf),
m AS (SELECT flow_key, name, bool_or(ab) AS ab, bool_or(NOT ab) AS ba FROM n GROUP BY ALL)
SELECT flow_key, string_agg(name, ',' ORDER BY name) AS decoded_protocols,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ab), '') AS protocols_a_to_b,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ba), '') AS protocols_b_to_a FROM m GROUP BY flow_key""")
def control_from_children(t):
    sets = rollup.protocol_sets(*rollup.child_evidence(
        ike_sessions=ike.ike_sessions(t.control), bgp_packets=bgp.bgp_packets(t.control)))
    return sets.select("flow_key", *[F.array_join(c, ",").alias(c) for c in sets.columns[1:]])


@query("a17_link_counts", CONTROL + """
SELECT flow_key, CASE protocol WHEN 'MACSEC' THEN 'macsec.AN' ELSE 'eap.code' END AS field,
  CAST(CASE protocol WHEN 'MACSEC' THEN k % 4 ELSE 1 + k % 4 END AS VARCHAR) AS value,
  count(*) AS n FROM lf GROUP BY ALL""")
def link_counts(t):
    return link.link_counts(t.control, "MACSEC").unionByName(link.link_counts(t.control, "EAPOL"))


@query("a17_link_ranges", CONTROL + """
, n AS (SELECT flow_key, CASE protocol WHEN 'MACSEC' THEN 'macsec.PN' ELSE 'mka.actor_mn' END AS field,
  CASE protocol WHEN 'MACSEC' THEN i ELSE (k % 16) * 256 + k END AS number FROM lf)
SELECT flow_key, field, min(number) AS low, max(number) AS high FROM n GROUP BY ALL""")
def link_ranges(t):
    return link.link_ranges(t.control, "MACSEC").unionByName(link.link_ranges(t.control, "EAPOL"))


@query("a18_dns_counts", pk("""
SELECT flow_key, kind2 AS kind, value, count(*) AS n, min(frame_number) AS first_at FROM (
  SELECT flow_key, frame_number, 'query' AS kind2, dns_query AS value FROM pk
  UNION ALL SELECT flow_key, frame_number, 'query_type', dns_query_type FROM pk
  UNION ALL SELECT flow_key, frame_number, 'rcode', dns_response_code FROM pk)
WHERE value IS NOT NULL GROUP BY ALL"""))
def dns_counts(t):
    return dns.dns_counts(t.packets)


@query("a18_dns_summary", pk("""
SELECT flow_key, count(DISTINCT dns_query) AS distinct_query,
  count(DISTINCT dns_query_type) AS distinct_query_type,
  count(DISTINCT dns_response_code) AS distinct_rcode, count(dns_query) AS query_count,
  count(dns_query_type) AS query_type_count, count(dns_response_code) AS rcode_count,
  count(*) FILTER (dns_response_code <> '0') AS error_count,
  count(DISTINCT dns_answer) AS distinct_answers FROM pk WHERE kind = 'dns' GROUP BY flow_key"""))
def dns_summary(t):
    return dns.dns_summary(t.packets)


@query("a18_dns_answers", pk("""
, a AS (SELECT flow_key, dns_answer AS answer, min(frame_number) AS first_at FROM pk
    WHERE dns_answer IS NOT NULL GROUP BY ALL)
SELECT flow_key, answer, row_number() OVER (PARTITION BY flow_key ORDER BY first_at) AS position FROM a
"""))
def dns_answers(t):
    return dns.dns_answer_list(t.packets)


@query("m15_dns_issues", pk("""
, a AS (SELECT flow_key, CASE dns_response_code WHEN '3' THEN 'NXDOMAIN: queried name does not exist'
    WHEN '2' THEN 'SERVFAIL: DNS server failed to answer' ELSE 'REFUSED: DNS server refused the query'
    END AS issue, min(frame_number) AS first_at FROM pk WHERE dns_response_code <> '0' GROUP BY ALL)
SELECT flow_key, issue, row_number() OVER (PARTITION BY flow_key ORDER BY first_at) AS position FROM a
"""))
def dns_issues(t):
    return dns.dns_issues(t.packets)


DHCP = """
, dv AS (SELECT flow_key, frame_number, unnest([{'list': 'transaction_ids', 'value': dhcp_transaction_id},
    {'list': 'client_macs', 'value': dhcp_client_mac}, {'list': 'hostnames', 'value': dhcp_hostname},
    {'list': 'requested_ips', 'value': dhcp_requested_ip}, {'list': 'offered_ips', 'value': dhcp_your_ip},
    {'list': 'server_ids', 'value': dhcp_server_id}, {'list': 'lease_times', 'value': dhcp_lease_time}],
    recursive := true) FROM pk WHERE kind = 'dhcp'),
dd AS (SELECT flow_key, list, value, min(frame_number) AS first_at FROM dv WHERE value IS NOT NULL
  GROUP BY ALL),
dl AS (SELECT flow_key, list, value, row_number() OVER (PARTITION BY flow_key, list ORDER BY first_at)
  AS position FROM dd)"""


@query("a19_dhcp_lists", pk(DHCP + "SELECT flow_key, list, value, position FROM dl"))
def dhcp_lists(t):
    return dhcp.dhcp_lists(t.packets)


@query("a19_dhcp_summary", pk(DHCP + """
, m AS (SELECT flow_key, count(*) AS messages, bool_or(dhcp_message_type LIKE 'ACK%') AS has_ack
    FROM pk WHERE kind = 'dhcp' GROUP BY flow_key)
SELECT m.*, """ + ", ".join(f"""coalesce((SELECT string_agg(value, ',' ORDER BY position) FROM dl
  WHERE dl.flow_key = m.flow_key AND list = '{n}'), '') AS {n}""" for n in dhcp.LISTS) + " FROM m"))
def dhcp_summary(t):
    return dhcp.dhcp_summary(t.packets).select(
        "flow_key", "messages", "has_ack", *[F.array_join(n, ",").alias(n) for n in dhcp.LISTS])


@query("u03_ordered_distinct", pk("""
, x AS (SELECT src_ip, length, min(frame_number) AS first_at FROM pk GROUP BY ALL)
SELECT src_ip, CAST(length AS VARCHAR) AS length, row_number() OVER (PARTITION BY src_ip
  ORDER BY first_at) AS position FROM x QUALIFY position <= 25"""))
def ordered_distinct(t):
    from packetloom.operators.ordered import ordered_distinct as distinct

    rows = t.packets.select("src_ip", F.col("length").cast("string").alias("length"), "frame_number")
    return distinct(rows, ["src_ip"], "length", cap=25).select("src_ip", "length", "position")


@query("m16_dhcp_incomplete", pk("""
SELECT flow_key, NOT bool_or(dhcp_message_type LIKE 'ACK%') AS incomplete FROM pk
WHERE kind = 'dhcp' GROUP BY flow_key"""))
def dhcp_incomplete(t):
    return dhcp.dhcp_incomplete(t.packets)


SIP = """
, sp AS (SELECT *, concat_ws(' ', CAST(sip_status_code AS VARCHAR), sip_reason) AS st,
    CASE WHEN sip_status_code < 400 THEN NULL WHEN sip_status_code < 500 THEN 'client failure response'
      WHEN sip_status_code < 600 THEN 'server failure response' WHEN sip_status_code IS NOT NULL
      THEN 'global failure response' END AS cls FROM pk WHERE kind = 'sip')"""


@query("a20_sip_calls", pk(SIP + """
SELECT flow_key, sip_call_id, count(*) AS packets, min(frame_number) AS first_at,
  arg_min(sip_from, frame_number) FILTER (sip_from IS NOT NULL) AS caller,
  arg_min(sip_to, frame_number) FILTER (sip_to IS NOT NULL) AS callee, count(sip_method) AS methods,
  count(sip_status_code) AS statuses, count(cls) AS failures FROM sp GROUP BY ALL"""))
def sip_calls(t):
    return sip.sip_calls(t.packets)


@query("a20_sip_call_counts", pk(SIP + """
SELECT flow_key, sip_call_id, kind2 AS kind, value, count(*) AS n, min(frame_number) AS first_at FROM (
  SELECT flow_key, sip_call_id, frame_number, 'method' AS kind2, sip_method AS value FROM sp
  UNION ALL SELECT flow_key, sip_call_id, frame_number, 'status', nullif(st, '') FROM sp
  UNION ALL SELECT flow_key, sip_call_id, frame_number, 'issue', cls FROM sp)
WHERE value IS NOT NULL GROUP BY ALL"""))
def sip_call_counts(t):
    return sip.sip_call_counts(t.packets)


@query("a20_sip_trace", pk(SIP + """
, ev2 AS (SELECT flow_key, sip_call_id, us AS time_us, src_label AS from_endpoint,
    dst_label AS to_endpoint, coalesce(sip_method, st) AS message, min(frame_number) AS f
  FROM sp GROUP BY ALL)
SELECT * EXCLUDE f, row_number() OVER (PARTITION BY flow_key, sip_call_id ORDER BY f) AS position
FROM ev2"""))
def sip_trace(t):
    return sip.sip_trace(t.packets)


@query("a20_sip_summary", pk(SIP + """
SELECT flow_key, count(sip_method) AS methods, count(sip_status_code) AS statuses,
  count(DISTINCT sip_call_id) AS calls FROM sp GROUP BY flow_key"""))
def sip_summary(t):
    return sip.sip_summary(t.packets)


@query("a20_sip_participants", pk(SIP + """
, x AS (SELECT flow_key, sip_from AS participant, frame_number * 2 AS o FROM sp
    UNION ALL SELECT flow_key, sip_to, frame_number * 2 + 1 FROM sp),
y AS (SELECT flow_key, participant, min(o) AS o FROM x WHERE participant IS NOT NULL GROUP BY ALL)
SELECT flow_key, participant, row_number() OVER (PARTITION BY flow_key ORDER BY o) AS position FROM y"""))
def sip_participants(t):
    return sip.sip_participants(t.packets)


@query("a21_smb_counts", pk("""
SELECT flow_key, kind2 AS kind, value, count(*) AS n, min(frame_number) AS first_at FROM (
  SELECT flow_key, frame_number, 'command' AS kind2, smb_command AS value FROM pk
  UNION ALL SELECT flow_key, frame_number, 'status', smb_status FROM pk)
WHERE value IS NOT NULL GROUP BY ALL"""))
def smb_counts(t):
    return smb.smb_counts(t.packets)


@query("a21_smb_summary", pk("""
, lv AS (SELECT flow_key, frame_number, unnest([{'list': 'session_ids', 'value': smb_session_id},
    {'list': 'tree_ids', 'value': smb_tree_id}, {'list': 'filenames', 'value': smb_filename}],
    recursive := true) FROM pk WHERE kind = 'smb'),
ld AS (SELECT flow_key, list, value, min(frame_number) AS first_at FROM lv WHERE value IS NOT NULL
  GROUP BY ALL),
ll AS (SELECT flow_key, list, value, row_number() OVER (PARTITION BY flow_key, list ORDER BY first_at)
  AS position FROM ld),
m AS (SELECT flow_key, count(smb_command) AS commands, count(smb_status) AS statuses,
    count(*) FILTER (smb_encrypted) AS encrypted_packets,
    count(*) FILTER (smb_status = '0xc0000022') AS errors FROM pk WHERE kind = 'smb' GROUP BY flow_key)
SELECT m.*, """ + ", ".join(f"""coalesce((SELECT string_agg(value, ',' ORDER BY position) FROM ll
  WHERE ll.flow_key = m.flow_key AND list = '{n}'), '') AS {n}""" for n in smb.LISTS) + " FROM m"))
def smb_summary(t):
    return smb.smb_summary(t.packets).select(
        "flow_key", "commands", "statuses", "encrypted_packets", "errors",
        *[F.coalesce(F.array_join(n, ","), F.lit("")).alias(n) for n in smb.LISTS])


@query("a23_smb_capability_sides", pk(f"""
, x AS (SELECT flow_key, CASE WHEN src_port IN (139, 445) THEN 'server' ELSE 'client' END AS side,
    frame_number, unnest(string_split({MASK}, ',')) AS capability,
    generate_subscripts(string_split({MASK}, ','), 1) AS slot FROM pk WHERE kind = 'smb' AND k % 10 = 3),
y AS (SELECT flow_key, side, capability, min(frame_number * 64 + slot) AS o FROM x
    WHERE capability <> '' GROUP BY ALL)
SELECT flow_key, side, capability, row_number() OVER (PARTITION BY flow_key, side ORDER BY o)
  AS position FROM y"""))
def smb_capability_sides(t):
    return smb.smb_capability_sides(t.packets)


ALERT = """concat(CASE tls_alert_level WHEN '2' THEN 'fatal (2) handshake_failure (40)'
  ELSE 'warning (1) close_notify (0)' END)"""


@query("a24_tls_alerts", pk(f"""
SELECT flow_key, src_label AS endpoint, {ALERT} AS alert, count(*) AS n, min(frame_number) AS first_at
FROM pk WHERE alerted GROUP BY ALL"""))
def tls_alerts(t):
    return tls.tls_alerts(t.packets, per_sender=True)


@query("a24_tls_sni_list", pk("""
, x AS (SELECT flow_key, src_label AS endpoint, tls_sni, min(frame_number) AS f FROM pk
    WHERE tls_sni IS NOT NULL GROUP BY ALL)
SELECT flow_key, endpoint, tls_sni, row_number() OVER (PARTITION BY flow_key, endpoint ORDER BY f)
  AS position FROM x"""))
def tls_sni_list(t):
    return tls.tls_sni_list(t.packets, per_sender=True)


@query("a24_tls_summary", pk("""
, x AS (SELECT flow_key, count(DISTINCT tls_sni) AS snis, count(*) FILTER (alerted) AS alerts,
    count(DISTINCT tls_alert_level) AS alert_kinds FROM pk GROUP BY flow_key)
SELECT * FROM x WHERE snis > 0 OR alerts > 0"""))
def tls_summary(t):
    return tls.tls_summary(t.packets)


CERTS = """
, ce AS (SELECT flow_key, frame_number, src_ip AS presenter_ip, src_port AS presenter_port,
    concat('CN=host', k % 6) AS subject, 'CN=Root' AS issuer, CAST(k % 4 AS VARCHAR) AS serial,
    concat('20', 20 + k % 8, '-01-01T00:00:00+00:00') AS not_after FROM pk
    WHERE kind = 'web' AND k % 3 = 0)"""


def certified(t):
    one = F.expr("""array(named_struct('presenter_ip', CAST(NULL AS STRING), 'presenter_port',
        CAST(NULL AS INT), 'presenter_role', CAST(NULL AS STRING), 'subject', concat('CN=host', k % 6),
        'subject_cn', concat('host', k % 6), 'issuer', 'CN=Root', 'issuer_cn', 'Root',
        'serial', CAST(k % 4 AS STRING), 'not_before', '2019-01-01T00:00:00+00:00',
        'not_after', concat('20', 20 + k % 8, '-01-01T00:00:00+00:00'), 'san_dns', array('a'),
        'fingerprint_sha256', CAST(NULL AS STRING)))""")
    return t.packets.withColumn("tls_certificates", F.when(F.expr("kind = 'web' AND k % 3 = 0"), one))


@query("a25_tls_certificates", pk(CERTS + """
, pr AS (SELECT flow_key, presenter_ip, presenter_port, row_number() OVER (PARTITION BY flow_key
    ORDER BY min(frame_number)) AS place FROM ce GROUP BY flow_key, presenter_ip, presenter_port),
fc AS (SELECT flow_key, presenter_ip, presenter_port, subject, issuer, serial,
    arg_min(not_after, frame_number) AS not_after FROM ce GROUP BY ALL)
SELECT fc.*, CASE place WHEN 1 THEN 'server' WHEN 2 THEN 'client' ELSE 'peer' END AS role
FROM fc JOIN pr USING (flow_key, presenter_ip, presenter_port)"""))
def tls_certificates(t):
    return tls.tls_certificates(certified(t)).select(
        "flow_key", "presenter_ip", "presenter_port", "subject", "issuer", "serial", "not_after", "role")


@query("w08_certificate_roles", pk(CERTS + """
, pr AS (SELECT flow_key, presenter_ip, presenter_port, row_number() OVER (PARTITION BY flow_key
    ORDER BY min(frame_number)) AS place FROM ce GROUP BY flow_key, presenter_ip, presenter_port)
SELECT flow_key, presenter_ip, presenter_port, CASE place WHEN 1 THEN 'server' WHEN 2 THEN 'client'
  ELSE 'peer' END AS role FROM pr"""))
def certificate_roles(t):
    return tls.certificate_roles(tls.packet_certificates(certified(t)))


@query("m13_certificate_issues", pk(CERTS + """
SELECT DISTINCT flow_key, presenter_ip, presenter_port, subject, serial,
  CASE WHEN not_after < '2024-06-01' THEN concat('certificate expired ', not_after) ELSE '' END AS issues
FROM (SELECT flow_key, presenter_ip, presenter_port, subject, serial,
    arg_min(not_after, frame_number) AS not_after FROM ce GROUP BY ALL)"""))
def certificate_issues(t):
    as_of = F.lit("2024-06-01 00:00:00+00:00").cast("timestamp")
    return tls.tls_certificates(certified(t)).select(
        "flow_key", "presenter_ip", "presenter_port", "subject", "serial", F.array_join(
            tls.certificate_issues(F.col("not_before"), F.col("not_after"), as_of), "; ").alias("issues"))


@query("m14_tls_issue_texts", pk(FLOWS + f"""
, al AS (SELECT flow_key, src_label AS endpoint, {ALERT} AS alert, count(*) AS n FROM pk WHERE alerted
    GROUP BY ALL),
fa AS (SELECT flow_key, alert, sum(n) AS n FROM al GROUP BY ALL),
ends AS (SELECT flow_key, unnest([concat_ws(':', endpoint_a, CAST(port_a AS VARCHAR)),
    concat_ws(':', endpoint_b, CAST(port_b AS VARCHAR))]) AS endpoint FROM fl
  WHERE flow_key IN (SELECT flow_key FROM al))
SELECT flow_key, endpoint, concat('sent tls alert: ', alert, ' (x', n, ')') AS issue FROM al
UNION ALL SELECT flow_key, NULL, concat('tls alert: ', alert, ' (x', CAST(n AS BIGINT), ')') FROM fa
UNION ALL SELECT flow_key, endpoint, 'tls alert sent by peer' FROM ends
  WHERE (flow_key, endpoint) NOT IN (SELECT (flow_key, endpoint) FROM al)
UNION ALL SELECT flow_key, endpoint, 'tls observed but certificate not extracted' FROM ends
UNION ALL SELECT DISTINCT flow_key, NULL, 'tls observed but certificate not extracted' FROM fa"""))
def tls_issue_texts(t):
    return tls.tls_issue_texts(t.packets, t.flows).drop("at")


HINTS = FLOWS + SMB_OPS + ESP_FLOWS + """
, wt AS (SELECT flow_key, max(wait) / 1e3 AS max_ms FROM (SELECT flow_key, us - max(us) OVER (
    PARTITION BY flow_key ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wait
    FROM pk) WHERE wait >= 0 GROUP BY flow_key),
xf AS (SELECT flow_key, CAST(sum(ops) AS BIGINT) AS ops, CAST(sum(bytes) AS BIGINT) AS moved FROM tf
  GROUP BY flow_key),
fx AS (SELECT flow_key, count(*) FILTER (tcp_tag = 'tcp_retransmission') AS rtx,
    bool_or(coalesce(tcp_tag = 'tcp_zero_window', FALSE)) AS zw, bool_or(coalesce(tcp_tag = 'tcp_reset', FALSE)) AS rst,
    bool_or(fatal) AS fatal, bool_or(alerted) AS alerted,
    bool_or(coalesce(dns_response_code <> '0', FALSE)) AS dnserr, count(dhcp_message_type) > 0
      AND NOT bool_or(coalesce(dhcp_message_type LIKE 'ACK%', FALSE)) AS noack,
    bool_or(kind = 'smb') AS is_smb, bool_or(smb_encrypted) AS enc,
    bool_or(coalesce(smb_status = '0xc0000022', FALSE)) AS smberr FROM pk GROUP BY flow_key),
hf AS (SELECT fl.*, fx.* EXCLUDE flow_key, coalesce(anomaly, FALSE) AS anomaly, coalesce(ops, 0) AS ops,
    coalesce(moved, 0) AS moved, max_ms, CASE WHEN duration_s > 0 THEN byte_count / duration_s * 8 / 1e6
      ELSE 0 END AS mbps, CASE WHEN duration_s > 0 THEN coalesce(moved, 0) * 8 / duration_s / 1e6 ELSE 0 END
      AS smbps
  FROM fl JOIN fx USING (flow_key) LEFT JOIN ef USING (flow_key) LEFT JOIN xf USING (flow_key)
  LEFT JOIN wt USING (flow_key))"""
SMB_HINT_LIST = """
  CASE WHEN is_smb AND enc THEN 'smb encrypted transform traffic observed; filenames and read/write details are hidden' END,
  CASE WHEN is_smb AND smberr THEN 'smb errors observed' END,
  CASE WHEN is_smb AND ops > 0 AND moved > 0 AND moved / ops < 65536 THEN 'small average smb read/write size' END,
  CASE WHEN is_smb AND duration_s >= 180 AND smbps < 10 THEN 'low smb transfer throughput for long-lived flow' END,
  CASE WHEN is_smb AND max_ms >= 1000 THEN 'smb transfer stalls or idle gaps observed' END"""
HINT_LIST = """
  CASE WHEN (a_to_b_packets = 0 OR b_to_a_packets = 0) AND packet_count > 1 THEN 'one-way traffic observed' END,
  CASE WHEN duration_s >= 180 AND mbps < 2 THEN 'low average throughput for long-lived flow' END,
  CASE WHEN rtx / packet_count >= 0.01::DOUBLE THEN 'tcp retransmission rate above 1 percent' END,
  CASE WHEN zw THEN 'tcp receiver window pressure observed' END,
  CASE WHEN rst THEN 'tcp reset observed' END, CASE WHEN fatal THEN 'tls fatal alert observed'
    WHEN alerted THEN 'tls alert observed' END,
  CASE WHEN anomaly THEN 'esp sequence anomaly observed' END,
  CASE WHEN dnserr THEN 'dns error responses observed' END,
  CASE WHEN noack THEN 'dhcp exchange lacks ack in observed packets' END,
  CASE WHEN protocol IN ('ESP', 'UDP') AND duration_s >= 180
    THEN 'encrypted or datagram flow limits direct loss/latency proof' END"""


def joined(items):
    return f"array_to_string([x FOR x IN [{items}] IF x IS NOT NULL], '|')"


@query("m09_diagnostic_hints", pk(HINTS + f"""
SELECT flow_key, {joined(HINT_LIST + ',' + SMB_HINT_LIST)} AS hints FROM hf"""))
def diagnostic_hints(t):
    return report.hinted_flows(t.packets, t.flows).select(
        "flow_key", F.array_join(metrics.diagnostic_hints(), "|").alias("hints"))


@query("m10_smb_hints", pk(HINTS + f"SELECT flow_key, {joined(SMB_HINT_LIST)} AS hints FROM hf"))
def smb_hints(t):
    return report.hinted_flows(t.packets, t.flows).select(
        "flow_key", F.array_join(metrics.smb_hints(), "|").alias("hints"))


@query("m17_flow_report", pk(HINTS + tag_rates("tcp_lost_segment", "z").replace(FLOWS, "") + f"""
, hh AS (SELECT *, {joined(HINT_LIST + ',' + SMB_HINT_LIST)} AS hints FROM hf)
SELECT flow_id, flow_key, hh.packet_count, hh.byte_count, round(hh.duration_s, 3) AS duration_s, hints,
  CASE WHEN ef.flow_key IS NULL THEN round(r, 4) WHEN expected > 0 THEN round(missing / expected, 4)
    ELSE round(r, 4) END AS loss_rate, round(rtx / hh.packet_count, 4) AS retransmission_rate,
  hh.a_to_b_packets = 0 OR hh.b_to_a_packets = 0 AS one_way
FROM hh JOIN (SELECT flow_key, flow_id FROM ranked) USING (flow_key) JOIN (SELECT flow_key, r FROM z)
  USING (flow_key) LEFT JOIN ef USING (flow_key) WHERE flow_id <= 25 OR flow_id = 60"""))
def flow_report(t):
    return report.flow_report(t.packets, t.ranked_facts, 25, 60).select(
        "flow_id", "flow_key", "packet_count", "byte_count", "duration_s",
        F.array_join("diagnostic_hints", "|").alias("hints"), "loss_rate", "retransmission_rate",
        "one_way")


@query("m17_report_children", pk(FLOWS + """
SELECT flow_id, child, n FROM (
  SELECT flow_key, 'name' AS child, count(DISTINCT nm) AS n FROM (SELECT flow_key, unnest([dns_query,
    http_host, tls_sni]) AS nm FROM pk) WHERE nm IS NOT NULL GROUP BY flow_key
  UNION ALL SELECT flow_key, 'sip_call', count(DISTINCT sip_call_id) FROM pk
    WHERE sip_call_id IS NOT NULL GROUP BY flow_key
  UNION ALL SELECT flow_key, 'esp_sequence', count(DISTINCT (esp_spi, src_ip)) FROM pk
    WHERE esp_spi IS NOT NULL GROUP BY flow_key)
JOIN ranked USING (flow_key)"""))
def report_children(t):
    children = report.report_children(t.packets, t.ranked)
    rows = [children[name].select("flow_id", F.lit(child).alias("child")) for name, child in (
        ("names", "name"), ("sip_calls", "sip_call"), ("esp_sequences", "esp_sequence"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("flow_id", "child").agg(
        F.count(F.lit(1)).alias("n"))


@query("m18_flow_throughput", pk(FLOWS + """
SELECT flow_id, way, CASE WHEN duration_s > 0 THEN bytes * 8 / duration_s / 1e6 END AS mbps FROM (
  SELECT flow_id, duration_s, concat(endpoint_a, ' -> ', endpoint_b) AS way, a_to_b_bytes AS bytes
    FROM ranked WHERE flow_id = 7
  UNION ALL SELECT flow_id, duration_s, concat(endpoint_b, ' -> ', endpoint_a), b_to_a_bytes
    FROM ranked WHERE flow_id = 7)"""))
def flow_throughput(t):
    return report.flow_throughput(t.ranked, 7)


@query("m19_detail_sip", pk(FLOWS + SIP + """
, ca AS (SELECT flow_key, sip_call_id, min(frame_number) AS first_at,
    arg_min(sip_from, frame_number) FILTER (sip_from IS NOT NULL) AS caller,
    count(cls) AS failures FROM sp GROUP BY ALL)
SELECT flow_id, sip_call_id, caller, failures, row_number() OVER (PARTITION BY flow_id ORDER BY first_at)
  AS place FROM ca JOIN ranked USING (flow_key)"""))
def detail_sip(t):
    return report.detail_sip(t.packets, t.ranked).select(
        "flow_id", "sip_call_id", "caller", "failures", "place")


@query("m19_detail_dns", pk(FLOWS + """
SELECT flow_id, count(DISTINCT dns_query) AS queries, count(*) FILTER (dns_response_code <> '0') AS errors
FROM pk JOIN ranked USING (flow_key) WHERE kind = 'dns' GROUP BY flow_id"""))
def detail_dns(t):
    return report.detail_dns(t.packets, t.ranked).select(
        "flow_id", F.col("distinct_query").alias("queries"), F.col("error_count").alias("errors"))


@query("m19_detail_dhcp", pk(FLOWS + DHCP + """
, m AS (SELECT flow_key, count(*) AS messages, bool_or(dhcp_message_type LIKE 'ACK%') AS has_ack
    FROM pk WHERE kind = 'dhcp' GROUP BY flow_key)
SELECT flow_id, messages, has_ack, (SELECT count(*) FROM dl WHERE dl.flow_key = m.flow_key
  AND list = 'transaction_ids') AS n_transaction_ids FROM m JOIN ranked USING (flow_key)"""))
def detail_dhcp(t):
    return report.detail_dhcp(t.packets, t.ranked).select("flow_id", "messages", "has_ack", "n_transaction_ids")


@query("m19_detail_smb", pk(FLOWS + """
SELECT flow_id, count(smb_command) AS commands, count(smb_status) AS statuses,
  count(*) FILTER (smb_status = '0xc0000022') AS errors, count(DISTINCT smb_filename) AS n_filenames
FROM pk JOIN (SELECT flow_key, flow_id FROM ranked) USING (flow_key) WHERE kind = 'smb' GROUP BY flow_id"""))
def detail_smb(t):
    return report.detail_smb(t.packets, t.ranked).select(
        "flow_id", "commands", "statuses", "errors", F.coalesce("n_filenames", F.lit(0)).alias("n_filenames"))


@query("m19_detail_rtp", pk(FLOWS + """
SELECT flow_id, rtp_ssrc, CASE WHEN a_to_b THEN 'A_to_B' ELSE 'B_to_A' END AS direction, count(*) AS packets
FROM pk JOIN (SELECT flow_key, flow_id FROM ranked) USING (flow_key) WHERE kind = 'rtp' GROUP BY ALL"""))
def detail_rtp(t):
    return report.detail_rtp(t.packets, t.ranked).select("flow_id", "rtp_ssrc", "direction", "packets")


CONTROL_FLOWS = IKE + BGP.removeprefix(CONTROL) + """,
cr AS (SELECT flow_key, row_number() OVER (ORDER BY sum(60 + floor(v)) DESC, min(frame_number)) AS flow_id FROM (
    SELECT flow_key, frame_number, v FROM kf UNION ALL SELECT flow_key, frame_number, v FROM bf
    UNION ALL SELECT flow_key, frame_number, v FROM lf) GROUP BY flow_key)"""


def control_flows(t):
    return rollup.rank_flows(rollup.flow_rollup(t.control).select(*rollup.CORE_COLUMNS))


@query("m19_detail_ike", CONTROL_FLOWS + """
SELECT flow_id, version, initiator_spi, responder_spi, min(frame_number) AS first_at,
  count(*) FILTER (forward) AS a_to_b_packets, count(*) FILTER (NOT forward) AS b_to_a_packets,
  count(*) FILTER (k % 7 = 1) AS fragmented_packets
FROM kf JOIN cr USING (flow_key) GROUP BY ALL""")
def detail_ike(t):
    return report.detail_ike(t.control, control_flows(t)).select(
        "flow_id", "version", "initiator_spi", "responder_spi", "first_at", "a_to_b_packets", "b_to_a_packets",
        "fragmented_packets")


@query("m19_detail_bgp", CONTROL_FLOWS + """
SELECT flow_id, a_to_b, field, value, count(*) AS n FROM bv JOIN cr USING (flow_key) GROUP BY ALL""")
def detail_bgp(t):
    return report.detail_bgp(t.control, control_flows(t)).drop("flow_key")


@query("m19_detail_link", CONTROL_FLOWS + f"""
SELECT flow_id, x.* EXCLUDE (flow_key) FROM (
  SELECT flow_key, field, value, n, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM ({QUERIES["a17_link_counts"].sql})
  UNION ALL SELECT flow_key, field, NULL, NULL, low, high FROM ({QUERIES["a17_link_ranges"].sql})) x JOIN cr USING (flow_key)""")
def detail_link(t):
    chosen = control_flows(t)
    return report.detail_link(t.control, chosen, "MACSEC").unionByName(
        report.detail_link(t.control, chosen, "EAPOL")).drop("flow_key")


@query("m19_detail_tls", pk(FLOWS + """
SELECT flow_id, concat(concat_ws(':', endpoint_a, CAST(port_a AS VARCHAR)), ' <-> ',
  concat_ws(':', endpoint_b, CAST(port_b AS VARCHAR))) AS endpoint
FROM ranked WHERE protocol = 'TCP' AND (port_a = 443 OR port_b = 443)"""))
def detail_tls(t):
    return report.detail_tls(t.packets, t.ranked_facts).select("flow_id", "endpoint")


@query("m19_detail_evidence", pk(FLOWS + WINDOWS + """
SELECT flow_id, tool, sample_offset, issue_packet_index, issue_count, reasons FROM ew
JOIN er USING (flow_key, tool, sample_offset) JOIN (SELECT flow_key, flow_id FROM ranked) USING (flow_key)"""))
def detail_evidence(t):
    windows = evidence.merge_windows(evidence.evidence_triggers(t.packets, PAUSE_MS))
    return report.detail_evidence(windows, t.ranked).drop("frame_number")


@query("m20_protocols_present", pk(PROTOCOL_NAMES + """
SELECT DISTINCT CASE name WHEN 'SMB2' THEN 'smb' WHEN 'SRTP' THEN 'rtp' ELSE lower(name) END AS protocol
FROM pn WHERE name <> 'HTTP'"""))
def protocols_present(t):
    return report.protocols_present(t.packets)


@query("m21_protocol_markers", pk("""
SELECT flow_key, count(DISTINCT sip_call_id) AS sip_calls, count(sip_method) AS sip_methods,
  count(sip_status_code) AS sip_statuses, count(smb_command) AS smb_commands,
  count(smb_status) AS smb_statuses, count(dns_query) AS dns_queries,
  count(dns_response_code) AS dns_rcodes, count(*) FILTER (dns_response_code <> '0') AS dns_errors,
  count(dhcp_message_type) AS dhcp_messages, count(DISTINCT tls_sni) AS tls_snis,
  count(*) FILTER (alerted) AS tls_alerts FROM pk GROUP BY flow_key"""))
def protocol_markers(t):
    return report.protocol_markers(t.packets, t.flows)
