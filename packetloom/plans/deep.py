"""Queries over header rows: counters, pages, tool choice."""

from pyspark.sql import functions as F

from packetloom.operators import deep, rollup
from packetloom.operators.deep_query import deep_query as answered
from packetloom.operators.paging import describe_page, page, paged_by_flow
from packetloom.plans import protocols as _protocols  # noqa: F401  its twins are used here
from packetloom.plans.catalog import QUERIES, query
from packetloom.plans.sequences import GAPS
from packetloom.plans.sql import FLOWS, PROTOCOL_NAMES, RTP, pk
from packetloom.protocols import esp, rtp, smb, tcp, tls
from packetloom.registry import deep_counters

TCP = "protocol = 'TCP'"


def sql_set(expression):
    return f"array_to_string(list_sort(list_distinct(list({expression}))), ',')"


@query("a26_tcp_marker_counts", pk(f"""
, m AS (SELECT flow_key, unnest([x FOR x IN [
    CASE tcp_tag WHEN 'tcp_retransmission' THEN 'tcp.analysis.retransmission'
      WHEN 'tcp_out_of_order' THEN 'tcp.analysis.out_of_order' WHEN 'tcp_lost_segment'
      THEN 'tcp.analysis.lost_segment' WHEN 'tcp_zero_window' THEN 'tcp.analysis.zero_window' END,
    CASE WHEN k % 7 = 0 AND k % 2 = 1 THEN 'tcp.analysis.window_update' END] IF x IS NOT NULL]) AS field
  FROM pk WHERE {TCP})
SELECT flow_key, field, count(*) AS n FROM m GROUP BY ALL"""))
def tcp_marker_counts(t):
    return tcp.tcp_marker_counts(deep.tool_rows(t.headers, "deep_tcp_flow"))


@query("a27_tcp_window_stats", pk(f"""
SELECT flow_key, min(k * 512) AS advertised_window_min, max(k * 512) AS advertised_window_max,
  min(k * 4) AS raw_advertised_window_min, max(k * 4) AS raw_advertised_window_max,
  max(k * 100) FILTER (rev) AS bytes_in_flight_max, {sql_set('1 << (k % 4)')} AS window_scale_factors,
  coalesce(array_to_string(list_sort(list_distinct(list(1400 + k % 3) FILTER (k % 10 = 0))), ','), '')
    AS mss_values,
  min(1400 + k % 3) FILTER (k % 10 = 0) AS mss_min, max(1400 + k % 3) FILTER (k % 10 = 0) AS mss_max
FROM pk WHERE {TCP} GROUP BY flow_key"""))
def tcp_window_stats(t):
    stats = tcp.tcp_window_stats(deep.tool_rows(t.headers, "deep_tcp_flow"))
    return stats.withColumns({n: F.array_join(n, ",") for n in ("window_scale_factors", "mss_values")})


@query("a28_udp_counts", pk("""
SELECT flow_key, count(*) FILTER (kind = 'dns') AS dns_packets,
  count(*) FILTER (kind = 'dns' AND rev) AS dns_responses,
  count(*) FILTER (dns_response_code <> '0') AS dns_error_responses,
  count(*) FILTER (kind = 'dhcp') AS dhcp_packets, count(*) FILTER (k % 30 = 0) AS udp_bad_checksum
FROM pk WHERE protocol = 'UDP' GROUP BY flow_key"""))
def udp_counts(t):
    return deep_counters(t.headers, "deep_udp_flow")


@query("a29_tls_counts", pk("""
SELECT flow_key, count(*) AS tls_packets, 0 AS dtls_packets, count(tls_sni) AS tls_handshake_packets,
  0 AS dtls_handshake_packets, count(*) FILTER (alerted) AS tls_alert_packets, 0 AS dtls_alert_packets,
  count(*) AS tcp_transport_packets, 0 AS udp_transport_packets,
  count(*) FILTER (tcp_tag IN ('tcp_lost_segment', 'tcp_retransmission'))
    AS tcp_loss_or_retransmission_packets, count(tls_sni) AS algorithm_field_packets,
  CAST(coalesce(sum(CASE WHEN k % 40 = 0 THEN 2 ELSE 1 END) FILTER (rev AND k % 20 = 0), 0) AS BIGINT)
    AS tls_certificate_fields FROM pk WHERE kind = 'web' GROUP BY flow_key"""))
def tls_counts(t):
    return tls.tls_counts(deep.tool_rows(t.headers, "deep_tls_flow"))


@query("a30_smb2_credits", pk("""
SELECT flow_key, count(*) AS smb2_packets, count(*) FILTER (NOT rev) AS smb2_requests,
  count(*) FILTER (rev) AS smb2_responses, CAST(sum(1 + k % 4) AS BIGINT) AS credit_charge_total,
  max(1 + k % 4) AS credit_charge_max,
  CAST(coalesce(sum(k % 64) FILTER (NOT rev), 0) AS BIGINT) AS credit_request_total,
  coalesce(max(k % 64) FILTER (NOT rev), 0) AS credit_request_max,
  CAST(coalesce(sum(k % 64) FILTER (rev), 0) AS BIGINT) AS credit_grant_total,
  coalesce(max(k % 64) FILTER (rev), 0) AS credit_grant_max,
  count(*) FILTER (rev AND k % 64 = 0) AS credit_grant_zero_packets,
  count(*) FILTER (k % 19 = 8) AS read_packets, count(*) FILTER (k % 19 = 9) AS write_packets,
  count(*) FILTER (smb_status = '0xc0000022') AS status_error_packets,
  count(*) FILTER (tcp_tag IN ('tcp_lost_segment', 'tcp_retransmission'))
    AS tcp_loss_or_retransmission_packets,
  count(*) FILTER (tcp_tag = 'tcp_zero_window') AS tcp_zero_window_packets
FROM pk WHERE kind = 'smb' GROUP BY flow_key"""))
def smb2_credits(t):
    return smb.smb2_credits(deep.tool_rows(t.headers, "deep_smb2_flow"))


ESP_ROWS = """, er AS (SELECT *, CASE WHEN k % 2 = 0 THEN '46' ELSE '0' END AS dscp FROM pk
  WHERE kind = 'esp')"""
ESP_COUNTS = f"""0 AS nat_t_packets, count(*) FILTER (k % 2 = 1) AS df_set_packets,
  count(*) FILTER (k % 50 = 0) AS fragmented_packets, {sql_set('dscp')} AS dscp_values"""


@query("a31_esp_counts", pk(ESP_ROWS + f"""
SELECT flow_key, count(*) AS esp_packets, {ESP_COUNTS}, min(length) AS ip_length_min,
  max(length) AS ip_length_max, CASE WHEN bool_or(k % 2 = 1) AND bool_or(k % 2 = 0) THEN 'mixed'
    WHEN bool_or(k % 2 = 1) THEN 'on' ELSE 'off' END AS df_bit FROM er GROUP BY flow_key"""))
def esp_counts(t):
    return deep_counters(t.headers, "deep_esp_flow")


ESP_WAYS = """, ew AS (SELECT *, concat(src_ip, ' -> ', dst_ip) AS direction, esp_sequence AS seq,
    row_number() OVER (PARTITION BY flow_key, src_ip, dst_ip, esp_sequence ORDER BY frame_number) AS nth,
    max(esp_sequence) OVER (PARTITION BY flow_key, src_ip, dst_ip ORDER BY frame_number
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM er)"""


@query("a32_esp_direction_stats", pk(ESP_ROWS + ESP_WAYS + f"""
, x AS (SELECT flow_key, direction, count(*) AS rows, CAST(sum(length) AS BIGINT) AS bytes,
    min(60 + k % 5) AS ttl_min, max(60 + k % 5) AS ttl_max, {ESP_COUNTS},
    count(DISTINCT seq) AS distinct_sequences, arg_min(seq, frame_number) AS first_sequence,
    arg_max(seq, frame_number) AS last_sequence, max(seq) AS highest_sequence,
    count(*) - count(DISTINCT seq) AS duplicates,
    count(*) FILTER (nth = 1 AND seq < high) AS out_of_order,
    count(*) FILTER (nth = 1 AND seq > high + 1) AS gaps,
    coalesce(max(seq - high - 1) FILTER (nth = 1 AND seq > high + 1), 0) AS largest_gap
  FROM ew GROUP BY ALL)
SELECT *, greatest(highest_sequence - first_sequence + 1 - distinct_sequences, 0) AS missing FROM x"""))
def esp_direction_stats(t):
    return esp.esp_direction_stats(deep.tool_rows(t.headers, "deep_esp_flow"))


@query("a32_esp_direction_gaps", pk(ESP_ROWS + ESP_WAYS + """
SELECT flow_key, direction, seq - high - 1 AS missing, count(*) AS n FROM ew
WHERE nth = 1 AND seq > high + 1 GROUP BY ALL"""))
def esp_direction_gaps(t):
    return esp.esp_direction_gaps(deep.tool_rows(t.headers, "deep_esp_flow"))




@query("a35_recomputed_gaps", pk(GAPS + """
SELECT flow_key, a_to_b, count(*) FILTER (step >= 0) AS interval_count,
  max(step) FILTER (step >= 0) * 1000 / 1e6 AS max_gap_ms,
  count(*) FILTER (step >= 0 AND step / 1e3 >= 3600000) AS pause_count,
  count(*) FILTER (step < 0) AS backward_timestamp_count
FROM g WHERE protocol = 'UDP' GROUP BY ALL"""))
def recomputed_gaps(t):
    rows = deep.tool_rows(t.headers, "deep_udp_flow")
    return deep.recompute_gaps(rows, 3_600_000.0).select(
        "flow_key", "a_to_b", "interval_count", "max_gap_ms", "pause_count",
        "backward_timestamp_count")


@query("w11_annotated_rows", pk(GAPS + RTP + """
SELECT g.frame_number, CASE WHEN g.step >= 0 THEN g.step * 1000 / 1e6 END AS direction_gap_ms,
  CASE WHEN r0.step >= 0 THEN r0.step * 1000 / 1e6 END AS stream_gap_ms
FROM g LEFT JOIN r0 USING (frame_number) WHERE protocol = 'UDP'"""))
def annotated_rows(t):
    return deep.annotated_rows(deep.tool_rows(t.headers, "deep_udp_flow")).select(
        "frame_number", "direction_gap_ms", "stream_gap_ms")


@query("g03_page", pk("""
SELECT frame_number, row_number() OVER (ORDER BY frame_number) - 1 AS position FROM pk
WHERE protocol = 'UDP' QUALIFY position BETWEEN 100 AND 299"""))
def one_page(t):
    return page(t.packets.where("protocol = 'UDP'"), "frame_number", 100, 200).select(
        "frame_number", "position")


@query("g03_page_descriptor", pk("""
, n AS (SELECT count(*) AS total FROM pk WHERE protocol = 'UDP')
SELECT 100 AS "offset", 200 AS "limit", greatest(0, least(200, total - 100)) AS returned,
  total AS total_matching, 100 + greatest(0, least(200, total - 100)) < total AS has_more,
  CASE WHEN 100 + greatest(0, least(200, total - 100)) < total
    THEN 100 + greatest(0, least(200, total - 100)) END AS next_offset FROM n"""))
def page_descriptor(t):
    return describe_page(t.packets.where("protocol = 'UDP'"), 100, 200)


@query("g03_pages_by_flow", pk("""
, n AS (SELECT flow_key, frame_number, row_number() OVER (PARTITION BY flow_key ORDER BY frame_number) - 1
  AS position FROM pk)
SELECT flow_key, frame_number, position FROM n WHERE position >= 5 AND position < 15"""))
def pages_by_flow(t):
    asked = t.flows.select("flow_key", F.lit(5).cast("bigint").alias("offset"))
    return paged_by_flow(t.packets.select("flow_key", "frame_number"), asked, "frame_number", 10).select(
        "flow_key", "frame_number", "position")


FACTS = FLOWS + """
, fx AS (SELECT flow_key, count(tcp_tag) AS tcp_issues, count(*) FILTER (alerted) AS alerts,
    count(tls_sni) AS snis, bool_or(kind = 'smb') AS is_smb, bool_or(kind = 'rtp') AS is_rtp,
    bool_or(kind = 'dns') AS is_dns, count(*) FILTER (dns_response_code <> '0') AS dns_errors,
    count(dhcp_message_type) AS dhcp, count(*) FILTER (dhcp_message_type LIKE 'ACK%') AS acks
  FROM pk GROUP BY flow_key),
ff AS (SELECT *, a_to_b_packets = 0 OR b_to_a_packets = 0 AS one_way, packet_count >= 100
    AND CASE WHEN duration_s > 0 THEN byte_count / duration_s * 8 / 1e6 ELSE 0 END < 1 AS slow
  FROM ranked JOIN fx USING (flow_key)),
fr AS (SELECT *,
    CASE WHEN is_rtp THEN 'RTP/SRTP headers observed; inspect SSRC, sequence, timestamps and payload types.'
      END AS r_rtp,
    CASE WHEN protocol NOT IN ('TCP', 'UDP') THEN NULL WHEN alerts > 0 THEN 'TLS/DTLS alert observed; inspect TLS/DTLS handshake, alert, and transport headers.'
      WHEN snis > 0 THEN 'TLS SNI observed; inspect TLS ClientHello and related transport headers.'
      WHEN protocol = 'TCP' AND (port_a = 443 OR port_b = 443) THEN 'Likely TLS flow by TCP port; inspect TLS handshake and TCP headers.'
      END AS r_tls,
    CASE WHEN is_smb THEN 'SMB metadata observed; inspect SMB2 credit charge, request/grant, statuses, transfer headers, and related TCP symptoms.' END AS r_smb,
    CASE WHEN protocol = 'ESP' THEN 'ESP/IPsec flow observed; inspect fragmentation, DSCP, TTL/hop-limit, packet size, and NAT-T headers. Use the Top Flows ESP sequence summary for missing, duplicate, and out-of-order sequence findings.' END AS r_esp,
    CASE WHEN protocol <> 'TCP' THEN NULL WHEN tcp_issues > 0 THEN 'TCP issue counters observed.'
      WHEN one_way THEN 'One-way TCP flow observed; inspect headers for handshake/reset/window clues.'
      WHEN slow THEN 'Longer TCP flow has low throughput; inspect headers for transport constraints.' END AS r_tcp,
    CASE WHEN protocol <> 'UDP' THEN NULL WHEN dns_errors > 0 THEN 'DNS error responses observed; inspect UDP/DNS transaction details.'
      WHEN is_dns THEN 'DNS metadata observed; inspect UDP/DNS transaction timing and answers.'
      WHEN dhcp > 0 AND acks = 0 THEN 'DHCP exchange appears incomplete; inspect UDP/DHCP transaction details.'
      WHEN dhcp > 0 THEN 'DHCP metadata observed; inspect UDP/DHCP transaction, lease, and server details.'
      WHEN one_way THEN 'One-way UDP flow observed; inspect UDP headers and response visibility.' END AS r_udp
  FROM ff)"""


@query("m11_tool_reasons", pk(FACTS + """
SELECT flow_key, tool, reason FROM (
  SELECT flow_key, 'deep_rtp_flow' AS tool, r_rtp AS reason FROM fr
  UNION ALL SELECT flow_key, 'deep_tls_flow', r_tls FROM fr
  UNION ALL SELECT flow_key, 'deep_smb2_flow', r_smb FROM fr
  UNION ALL SELECT flow_key, 'deep_esp_flow', r_esp FROM fr
  UNION ALL SELECT flow_key, 'deep_tcp_flow', r_tcp FROM fr
  UNION ALL SELECT flow_key, 'deep_udp_flow', r_udp FROM fr) WHERE reason IS NOT NULL"""))
def tool_reasons(t):
    return deep.flow_reasons(t.flows)


@query("m12_routed_tools", pk(FACTS + """
SELECT flow_id, CASE WHEN r_rtp IS NOT NULL THEN 'deep_rtp_flow' WHEN r_tls IS NOT NULL THEN 'deep_tls_flow'
    WHEN r_smb IS NOT NULL THEN 'deep_smb2_flow' WHEN r_esp IS NOT NULL THEN 'deep_esp_flow'
    WHEN r_tcp IS NOT NULL THEN 'deep_tcp_flow' ELSE 'deep_udp_flow' END AS tool,
  coalesce(r_rtp, r_tls, r_smb, r_esp, r_tcp, r_udp) AS reason FROM fr
WHERE coalesce(r_rtp, r_tls, r_smb, r_esp, r_tcp, r_udp) IS NOT NULL ORDER BY flow_id LIMIT 2"""))
def routed_tools(t):
    return deep.route_tools(t.ranked_facts).select("flow_id", "tool", "reason")


@query("x01_protocol_registry", pk(PROTOCOL_NAMES + """
SELECT lower(name) AS protocol, count(DISTINCT flow_key) AS flows FROM pn
WHERE name IN ('TCP', 'UDP', 'TLS', 'RTP', 'DNS', 'SIP', 'DHCP', 'SMB', 'ESP') GROUP BY ALL"""))
def protocol_registry(t):
    from packetloom.operators.rollup import flow_protocol_names
    from packetloom.registry import protocol_names

    name = F.lower("name").alias("protocol")
    return flow_protocol_names(t.packets).select("flow_key", name).where(
        F.col("protocol").isin(sorted(protocol_names()))).groupBy("protocol").agg(
            F.count(F.lit(1)).alias("flows"))


@query("x02_deep_query", pk(FLOWS + """
, target AS (SELECT flow_key FROM ranked WHERE protocol = 'TCP' ORDER BY flow_id LIMIT 1)
SELECT frame_number, row_number() OVER (ORDER BY frame_number) - 1 AS position FROM pk
WHERE flow_key = (SELECT flow_key FROM target) QUALIFY position < 10"""))
def deep_query(t):
    target = t.ranked.where(TCP).orderBy("flow_id").limit(1)
    rows = deep.tool_rows(t.headers, "deep_tcp_flow").join(
        target.select("flow_key"), "flow_key", "left_semi")
    return page(rows, "frame_number", 0, 10).select("frame_number", "position")


@query("x02_deep_endpoint_rows", pk("""
SELECT frame_number FROM pk WHERE kind = 'web' AND ((src_ip = '10.0.0.2' AND dst_ip = '192.0.2.2'
  AND src_port = 40001) OR (dst_ip = '10.0.0.2' AND src_ip = '192.0.2.2' AND dst_port = 40001))"""))
def deep_endpoint_rows(t):
    return deep.flow_rows(t.headers, "deep_tls_flow", "10.0.0.2", 40001, "192.0.2.2", 443).select(
        "frame_number")


@query("x02_rtp_security", pk("""
SELECT frame_number, CASE WHEN k % 4 = 0 THEN 'SRTP (dissector or explicit port)' ELSE 'unknown' END
  AS media_security FROM pk WHERE kind = 'rtp'"""))
def rtp_security(t):
    return rtp.secured_rows(deep.tool_rows(t.headers, "deep_rtp_flow")).select(
        "frame_number", "media_security")


PACKET_TOOLS = ["deep_tcp_flow", "deep_udp_flow", "deep_tls_flow", "deep_smb2_flow", "deep_esp_flow", "deep_rtp_flow"]
CONTROL_TOOLS = ["deep_ike_flow", "deep_bgp_flow", "deep_macsec_flow", "deep_eapol_flow"]


def melted(name, tool, item="NULL", leave=()):
    """The counters of another query's twin as rows."""
    keys = ["flow_key", *leave]
    return f"""SELECT flow_key, '{tool}' AS tool, counter, CAST({item} AS VARCHAR) AS item, value FROM (
  UNPIVOT (SELECT {', '.join(keys)}, COLUMNS(* EXCLUDE ({', '.join(keys)}))::VARCHAR FROM ({QUERIES[name].sql}))
  ON COLUMNS(* EXCLUDE ({', '.join(keys)})) INTO NAME counter VALUE value)"""


def requests_for_all(t, flows, tools):
    """Every flow with every tool, and one request each that cannot be answered."""
    asked = flows.select("flow_id", F.explode(F.array(*[F.lit(x) for x in tools])).alias("tool"))
    odd = t.spark.createDataFrame([(1, "no_such_tool"), (-5, tools[0])], "flow_id long, tool string")
    return asked.unionByName(odd).select(
        F.concat_ws("/", "flow_id", "tool").alias("request_id"), "tool", "flow_id", F.lit(2).cast("bigint").alias("offset"))


def deep_answers(t):
    flows = t.ranked_facts
    return answered(requests_for_all(t, flows, PACKET_TOOLS), flows, t.headers, 5, 6 * 3600 * 1000.0, PACKET_TOOLS)


RTP_ITEMS = """SELECT flow_key, 'deep_rtp_flow' AS tool, 'rtp_packets' AS counter, NULL AS item, count(*)::VARCHAR AS value
FROM ({packets} SELECT flow_key FROM pk WHERE kind = 'rtp') GROUP BY ALL"""
STREAM_COUNTERS = ("packets", "srtp_packets", "duplicates", "out_of_order", "holes", "interval_count", "pause_count")


@query("x02_deep_counters", " UNION ALL ".join([
    "SELECT flow_key, 'deep_tcp_flow' AS tool, field AS counter, CAST(NULL AS VARCHAR) AS item, n::VARCHAR AS value "
    f"FROM ({QUERIES['a26_tcp_marker_counts'].sql})",
    melted("a27_tcp_window_stats", "deep_tcp_flow"), melted("a28_udp_counts", "deep_udp_flow"),
    melted("a29_tls_counts", "deep_tls_flow"), melted("a30_smb2_credits", "deep_smb2_flow"),
    melted("a31_esp_counts", "deep_esp_flow"), RTP_ITEMS.format(packets=pk("").strip()),
    f"SELECT * FROM ({melted('a14_rtp_streams', 'deep_rtp_flow', "concat(direction, ' ', rtp_ssrc)", ('direction', 'rtp_ssrc'))}) "
    f"WHERE counter IN {STREAM_COUNTERS}"]))
def deep_counters_of_all(t):
    found = deep_answers(t).counters
    return found.where((F.col("tool") != "deep_rtp_flow") | F.col("item").isNull()
                       | F.col("counter").isin(*STREAM_COUNTERS))


@query("x02_deep_answers", pk(FLOWS + """
, tool AS (SELECT unnest(['deep_tcp_flow', 'deep_udp_flow', 'deep_tls_flow', 'deep_smb2_flow', 'deep_esp_flow',
    'deep_rtp_flow']) AS tool),
hits AS (SELECT flow_key, unnest(CASE kind WHEN 'web' THEN ['deep_tcp_flow', 'deep_tls_flow'] WHEN 'smb' THEN
    ['deep_tcp_flow', 'deep_smb2_flow'] WHEN 'esp' THEN ['deep_esp_flow'] WHEN 'rtp' THEN ['deep_udp_flow',
    'deep_rtp_flow'] ELSE ['deep_udp_flow'] END) AS tool FROM pk),
totals AS (SELECT flow_key, tool, count(*) AS n FROM hits GROUP BY ALL),
fit AS (SELECT ranked.flow_id, flow_key, tool, CASE tool WHEN 'deep_tcp_flow' THEN protocol = 'TCP' WHEN 'deep_smb2_flow'
    THEN protocol = 'TCP' WHEN 'deep_udp_flow' THEN protocol = 'UDP' WHEN 'deep_rtp_flow' THEN protocol = 'UDP'
    WHEN 'deep_esp_flow' THEN protocol = 'ESP' ELSE protocol IN ('TCP', 'UDP') END AS fits FROM ranked, tool)
SELECT concat_ws('/', flow_id, tool) AS request_id, tool, flow_id,
  CASE WHEN NOT fits THEN 'skipped' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN fits THEN coalesce(n, 0) END AS total_matching,
  CASE WHEN fits THEN greatest(0, least(5, coalesce(n, 0) - 2)) END AS returned,
  CASE WHEN fits AND n > 7 THEN 7 END AS next_offset
FROM fit LEFT JOIN totals USING (flow_key, tool)
UNION ALL SELECT '1/no_such_tool', 'no_such_tool', 1, 'rejected', NULL, NULL, NULL
UNION ALL SELECT '-5/deep_tcp_flow', 'deep_tcp_flow', -5, 'not_found', NULL, NULL, NULL"""))
def deep_answers_of_all(t):
    return deep_answers(t).answers.select(
        "request_id", "tool", "flow_id", "status", "total_matching", "returned", "next_offset")


SESSION = ("version", "initiator_spi", "responder_spi")
SESSION_ITEM = "concat_ws(' ', version, coalesce(initiator_spi, '-'), coalesce(responder_spi, '-'))"


def sql_of(name):
    return f"({QUERIES[name].sql})"


@query("x02_deep_control_counters", f"""
SELECT flow_key, 'deep_ike_flow' AS tool, 'ike_packets' AS counter, CAST(NULL AS VARCHAR) AS item,
  sum(a_to_b_packets + b_to_a_packets)::BIGINT::VARCHAR AS value FROM {sql_of("a15_ike_sessions")} GROUP BY flow_key
UNION ALL SELECT * FROM ({melted("a15_ike_sessions", "deep_ike_flow", SESSION_ITEM, SESSION)}) WHERE counter <> 'first_at'
UNION ALL SELECT flow_key, 'deep_ike_flow', kind, concat({SESSION_ITEM}, ' ', value), n::VARCHAR FROM {sql_of("a15_ike_counts")}
UNION ALL SELECT flow_key, 'deep_bgp_flow', 'bgp_packets', NULL, packets::VARCHAR FROM {sql_of("a16_bgp_packets")}
UNION ALL SELECT flow_key, 'deep_bgp_flow', field, value, sum(n)::BIGINT::VARCHAR FROM {sql_of("a16_bgp_summary")} GROUP BY ALL
UNION ALL SELECT flow_key, tool, 'packets', NULL, count(*)::VARCHAR FROM (SELECT flow_key, concat('deep_', lower(protocol), '_flow')
  AS tool FROM ({_protocols.CONTROL} SELECT flow_key, protocol FROM lf)) GROUP BY ALL
UNION ALL SELECT flow_key, concat('deep_', CASE split_part(field, '.', 1) WHEN 'macsec' THEN 'macsec' ELSE 'eapol' END, '_flow'),
  field, value, n::VARCHAR FROM {sql_of("a17_link_counts")}
UNION ALL SELECT flow_key, concat('deep_', CASE split_part(field, '.', 1) WHEN 'macsec' THEN 'macsec' ELSE 'eapol' END, '_flow'),
  field, unnest(['low', 'high']), unnest([low, high])::BIGINT::VARCHAR FROM {sql_of("a17_link_ranges")}""")
def deep_control_counters(t):
    flows = rollup.rank_flows(rollup.flow_rollup(t.control))
    return answered(requests_for_all(t, flows, CONTROL_TOOLS), flows, t.control_headers, tools=CONTROL_TOOLS).counters


@query("p25_ike_metadata", _protocols.IKE + """
SELECT frame_number, version, initiator_spi, responder_spi, exchange AS exchange_type, k AS message_id, flags, next_payload,
  CASE k % 10 WHEN 0 THEN '24' WHEN 1 THEN '16388,16389' WHEN 2 THEN '36136,36136' ELSE '' END AS notify_types,
  CASE WHEN k % 5 = 2 THEN '12,12,20' END AS encryption, CASE WHEN k % 7 = 1 THEN k % 4 END AS fragment_number FROM ik""")
def ike_metadata(t):
    from packetloom.protocols.ike import ike_metadata as metadata

    rows = t.control_headers.select("frame_number", metadata().alias("ike")).where("ike IS NOT NULL")
    return rows.select("frame_number", "ike.version", "ike.initiator_spi", "ike.responder_spi", "ike.exchange_type",
                       "ike.message_id", "ike.flags", "ike.next_payload",
                       F.array_join(F.col("ike.notify_types").cast("array<string>"), ",").alias("notify_types"),
                       F.array_join(F.col("ike.proposal_fields")["tf.id.encr"], ",").alias("encryption"),
                       "ike.fragment_number")
