"""DuckDB twins of the derived packet tables, as WITH clauses."""

EVENTS = """ev AS (
  SELECT event_id AS i, ts, user_id AS u, event_type AS t, value AS v,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 0 AS rev,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn,
    CASE event_type WHEN 'error' THEN 'web' WHEN 'click' THEN 'rtp' WHEN 'purchase' THEN 'smb'
      WHEN 'signup' THEN 'esp' ELSE CASE user_id % 4 WHEN 1 THEN 'sip' WHEN 3 THEN 'dhcp'
      ELSE 'dns' END END AS kind
  FROM events),
es AS (SELECT *, rn + CASE k % 10 WHEN 0 THEN 3 WHEN 1 THEN -2 ELSE 0 END AS sq,
    concat('10.0.', u // 250, '.', u % 250 + 1) AS client_ip,
    concat('192.0.2.', u % 5 + 1) AS server_ip,
    CASE WHEN kind <> 'esp' THEN 40000 + u % 1000 END AS client_port,
    CASE kind WHEN 'web' THEN 443 WHEN 'smb' THEN 445 WHEN 'rtp' THEN 5004 WHEN 'dns' THEN 53
      WHEN 'sip' THEN 5060 WHEN 'dhcp' THEN 67 END AS server_port,
    kind = 'web' AND k % 15 = 0 AS alerted FROM ev)"""

_KEY = """
    CASE WHEN src_first THEN s ELSE d END AS endpoint_a,
    CASE WHEN src_first THEN d ELSE s END AS endpoint_b,
    CASE WHEN src_first THEN src_port ELSE dst_port END AS port_a,
    CASE WHEN src_first THEN dst_port ELSE src_port END AS port_b"""

PACKETS = EVENTS + """,
p0 AS (SELECT i + 1 AS frame_number, ts, epoch_us(ts) AS us, k, u, v, rn, kind, rev,
    CASE kind WHEN 'web' THEN 'TCP' WHEN 'smb' THEN 'TCP' WHEN 'esp' THEN 'ESP' ELSE 'UDP' END
      AS protocol,
    CASE WHEN rev THEN server_ip ELSE client_ip END AS src_ip,
    CASE WHEN rev THEN client_ip ELSE server_ip END AS dst_ip,
    CASE WHEN rev THEN server_port ELSE client_port END AS src_port,
    CASE WHEN rev THEN client_port ELSE server_port END AS dst_port,
    CAST(60 + floor(v) AS BIGINT) AS length,
    CASE kind WHEN 'web' THEN ['TCP', 'TLS'] WHEN 'smb' THEN ['SMB2', 'TCP']
      WHEN 'rtp' THEN ['RTP', 'UDP'] WHEN 'dns' THEN ['DNS', 'UDP'] WHEN 'sip' THEN ['SIP', 'UDP']
      WHEN 'dhcp' THEN ['DHCP', 'UDP'] ELSE ['ESP'] END AS layers,
    CASE WHEN kind IN ('web', 'smb') THEN CASE k % 12 WHEN 0 THEN 'tcp_retransmission'
      WHEN 1 THEN 'tcp_out_of_order' WHEN 2 THEN 'tcp_lost_segment' WHEN 3 THEN 'tcp_zero_window'
      WHEN 4 THEN 'tcp_reset' END END AS tcp_tag,
    alerted, alerted AND k % 2 = 0 AS fatal,
    CASE WHEN kind IN ('web', 'smb') AND k % 2 = 0 THEN v / 1e3 END AS rtt_seconds,
    CASE WHEN kind IN ('web', 'smb') AND rn = 1 THEN v / 5e2 END AS initial_rtt_seconds,
    CASE WHEN kind = 'esp' THEN concat('0x0000000', u % 2) END AS esp_spi,
    CASE WHEN kind = 'esp' THEN greatest(1, sq) END AS esp_sequence,
    CASE WHEN kind = 'rtp' THEN concat('0x0000000', u % 3) END AS rtp_ssrc,
    CASE WHEN kind = 'rtp' THEN (65530 + sq) % 65536 END AS rtp_sequence,
    CASE WHEN kind = 'rtp' THEN CASE WHEN k % 2 = 0 THEN 0 ELSE 96 END END AS rtp_payload_type,
    kind = 'rtp' AND k % 4 = 0 AS srtp,
    CASE WHEN kind = 'dns' THEN concat('host', k % 20, '.example') END AS dns_query,
    CASE WHEN kind = 'dns' THEN CASE WHEN k % 2 = 0 THEN 'A' ELSE 'AAAA' END END AS dns_query_type,
    CASE WHEN kind = 'dns' AND rev THEN CASE k % 5 WHEN 2 THEN '3' WHEN 3 THEN '2' WHEN 4 THEN '5'
      ELSE '0' END END AS dns_response_code,
    CASE WHEN kind = 'dns' AND rev AND k % 5 < 2 THEN concat('203.0.113.', k) END AS dns_answer,
    CASE WHEN kind = 'web' AND NOT rev THEN concat('host', k % 20, '.example') END AS http_host,
    CASE WHEN kind = 'web' AND rev AND k % 25 = 0
      THEN concat('https://Host', k % 20, '.example:8443/new') END AS http_location,
    CASE WHEN kind = 'web' AND NOT rev AND rn <= 2 THEN concat('host', k % 20, '.example') END
      AS tls_sni,
    CASE WHEN alerted THEN CASE WHEN k % 2 = 0 THEN '2' ELSE '1' END END AS tls_alert_level,
    CASE WHEN alerted THEN CASE WHEN k % 2 = 0 THEN '40' ELSE '0' END END AS tls_alert_description,
    CASE WHEN kind = 'sip' THEN concat('call-', u, '-', rn // 4) END AS sip_call_id,
    CASE WHEN kind = 'sip' AND NOT rev THEN CASE k % 3 WHEN 0 THEN 'INVITE' WHEN 1 THEN 'ACK'
      ELSE 'BYE' END END AS sip_method,
    CASE WHEN kind = 'sip' AND rev THEN CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 180 WHEN 2 THEN 404
      WHEN 3 THEN 486 WHEN 4 THEN 503 ELSE 603 END END AS sip_status_code,
    CASE WHEN kind = 'sip' AND rev AND k % 6 = 2 THEN 'Not Found' END AS sip_reason,
    CASE WHEN kind = 'sip' AND NOT rev THEN concat('sip:+1-555-', 1000 + u, '@example.com') END
      AS sip_from,
    CASE WHEN kind = 'sip' AND NOT rev THEN concat('sip:+1-555-', 2000 + k % 5, '@example.com') END
      AS sip_to,
    CASE WHEN kind = 'dhcp' THEN CASE k % 4 WHEN 0 THEN 'Discover (1)' WHEN 1 THEN 'Offer (2)'
      WHEN 2 THEN 'Request (3)' ELSE 'ACK (5)' END END AS dhcp_message_type,
    CASE WHEN kind = 'dhcp' THEN concat('x', rn // 4) END AS dhcp_transaction_id,
    CASE WHEN kind = 'dhcp' THEN concat('02:00:00:00:00:', 10 + u % 80) END AS dhcp_client_mac,
    CASE WHEN kind = 'dhcp' AND k % 4 = 2 THEN concat('pc', u % 7) END AS dhcp_hostname,
    CASE WHEN kind = 'dhcp' AND k % 4 = 2 THEN concat('10.1.0.', k) END AS dhcp_requested_ip,
    CASE WHEN kind = 'dhcp' AND k % 4 = 1 THEN concat('10.1.0.', k) END AS dhcp_your_ip,
    CASE WHEN kind = 'dhcp' AND k % 4 = 3 THEN '192.0.2.1' END AS dhcp_server_id,
    CASE WHEN kind = 'dhcp' AND k % 4 = 3 THEN '86400' END AS dhcp_lease_time,
    CASE WHEN kind = 'smb' THEN CASE k % 4 WHEN 0 THEN 'SMB2create' WHEN 3 THEN 'SMB2write'
      ELSE 'SMB2read' END END AS smb_command,
    CASE WHEN kind = 'smb' THEN CAST(rn // 2 AS VARCHAR) END AS smb_message_id,
    CASE WHEN kind = 'smb' THEN rev END AS smb_is_response,
    CASE WHEN kind = 'smb' AND rev THEN CASE WHEN k % 9 = 0 THEN '0xc0000022'
      ELSE '0x00000000' END END AS smb_status,
    CASE WHEN kind = 'smb' THEN concat('s', u % 3) END AS smb_session_id,
    CASE WHEN kind = 'smb' THEN concat('t', k % 40) END AS smb_tree_id,
    CASE WHEN kind = 'smb' AND (k % 4 <> 0 OR rev) THEN concat('f', k % 3) END AS smb_file_id,
    CASE WHEN kind = 'smb' AND k % 4 = 0 THEN concat('file', k % 3) END AS smb_filename,
    CASE WHEN kind = 'smb' AND k % 4 = 0 THEN 1 + k % 3 END AS smb_access,
    CASE WHEN kind = 'smb' AND k % 4 = 1 THEN k * 1024 END AS smb_read_length,
    CASE WHEN kind = 'smb' AND k % 4 = 3 THEN k * 2048 END AS smb_write_length,
    CASE WHEN kind = 'smb' AND k % 4 = 2 THEN rn * 4096 END AS smb_file_offset,
    kind = 'smb' AND k % 50 = 7 AS smb_encrypted
  FROM es),
p1 AS (SELECT *, src_ip AS s, dst_ip AS d, src_ip < dst_ip OR (src_ip = dst_ip
    AND coalesce(src_port, -1) <= coalesce(dst_port, -1)) AS src_first FROM p0),
p2 AS (SELECT *,""" + _KEY + """ FROM p1),
pk AS (SELECT *, concat_ws('|', protocol, endpoint_a, coalesce(CAST(port_a AS VARCHAR), ''),
      endpoint_b, coalesce(CAST(port_b AS VARCHAR), '')) AS flow_key,
    src_ip = endpoint_a AND (port_a IS NULL OR coalesce(src_port = port_a, FALSE)) AS a_to_b,
    concat_ws(':', src_ip, CAST(src_port AS VARCHAR)) AS src_label,
    concat_ws(':', dst_ip, CAST(dst_port AS VARCHAR)) AS dst_label
  FROM p2)"""

TAGS = """,
tags AS (SELECT frame_number, flow_key, a_to_b, 0 AS slot, tcp_tag AS issue FROM pk
    WHERE tcp_tag IS NOT NULL
  UNION ALL SELECT frame_number, flow_key, a_to_b,
    CASE WHEN tcp_tag IS NULL THEN 0 ELSE 1 END, 'tls_alert' FROM pk WHERE alerted
  UNION ALL SELECT frame_number, flow_key, a_to_b,
    CASE WHEN tcp_tag IS NULL THEN 1 ELSE 2 END, 'tls_fatal_alert' FROM pk WHERE fatal)"""

PROTOCOL_NAMES = """,
pn AS (SELECT DISTINCT frame_number, flow_key, a_to_b, unnest(list_concat(layers, [protocol],
    CASE kind WHEN 'web' THEN CASE WHEN NOT rev OR (k % 25 = 0) THEN ['HTTP'] ELSE [] END
      WHEN 'smb' THEN ['SMB'] WHEN 'rtp' THEN CASE WHEN srtp THEN ['RTP', 'SRTP'] ELSE ['RTP'] END
      ELSE [] END)) AS name FROM pk)"""

FLOWS = """,
fl AS (SELECT flow_key, any_value(protocol) AS protocol, any_value(endpoint_a) AS endpoint_a,
    any_value(endpoint_b) AS endpoint_b, any_value(port_a) AS port_a, any_value(port_b) AS port_b,
    count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(us) AS first_us,
    max(us) AS last_us, min(frame_number) AS first_frame,
    count(*) FILTER (a_to_b) AS a_to_b_packets, count(*) FILTER (NOT a_to_b) AS b_to_a_packets,
    CAST(coalesce(sum(length) FILTER (a_to_b), 0) AS BIGINT) AS a_to_b_bytes,
    CAST(coalesce(sum(length) FILTER (NOT a_to_b), 0) AS BIGINT) AS b_to_a_bytes,
    greatest(max(us) - min(us), 0) / 1e6 AS duration_s
  FROM pk GROUP BY flow_key),
ranked AS (SELECT *, row_number() OVER (ORDER BY byte_count DESC, first_frame) AS flow_id FROM fl)"""

ESP = """,
e0 AS (SELECT flow_key, esp_spi, concat(src_label, ' -> ', dst_label) AS direction,
    a_to_b, esp_sequence AS seq, frame_number FROM pk WHERE esp_spi IS NOT NULL),
e1 AS (SELECT *, row_number() OVER (PARTITION BY flow_key, esp_spi, direction, seq
      ORDER BY frame_number) AS nth,
    max(seq) OVER (PARTITION BY flow_key, esp_spi, direction ORDER BY frame_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e0),
es1 AS (SELECT flow_key, esp_spi, direction, any_value(a_to_b) AS a_to_b, count(*) AS packets,
    count(DISTINCT seq) AS distinct_sequences, arg_min(seq, frame_number) AS first_sequence,
    arg_max(seq, frame_number) AS last_sequence, max(seq) AS highest_sequence,
    count(*) - count(DISTINCT seq) AS duplicates,
    count(*) FILTER (nth = 1 AND seq < high) AS out_of_order,
    count(*) FILTER (nth = 1 AND seq > high + 1) AS gaps,
    coalesce(max(seq - high - 1) FILTER (nth = 1 AND seq > high + 1), 0) AS largest_gap
  FROM e1 GROUP BY flow_key, esp_spi, direction),
esp AS (SELECT *, greatest(highest_sequence - first_sequence + 1 - distinct_sequences, 0)
    AS missing FROM es1)"""

RTP = """,
r0 AS (SELECT flow_key, CASE WHEN src_ip = endpoint_a AND src_port IS NOT DISTINCT FROM port_a
      THEN 'A_to_B' ELSE 'B_to_A' END AS direction, rtp_ssrc, rtp_sequence AS seq, frame_number,
    us, srtp, rtp_payload_type,
    lag(rtp_sequence) OVER w AS before, us - lag(us) OVER w AS step
  FROM pk WHERE rtp_ssrc IS NOT NULL
  WINDOW w AS (PARTITION BY flow_key, src_ip, src_port, rtp_ssrc ORDER BY frame_number)),
r1 AS (SELECT *, sum(CASE WHEN before IS NULL THEN seq
      ELSE (seq - before + 32768 + 65536) % 65536 - 32768 END) OVER w AS ext
  FROM r0 WINDOW w AS (PARTITION BY flow_key, direction, rtp_ssrc ORDER BY frame_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r2 AS (SELECT *, max(ext) OVER (PARTITION BY flow_key, direction, rtp_ssrc ORDER BY frame_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high,
    row_number() OVER (PARTITION BY flow_key, direction, rtp_ssrc, ext ORDER BY frame_number)
      AS nth FROM r1)"""


def pk(tail: str) -> str:
    return f"WITH {PACKETS}{tail}"
