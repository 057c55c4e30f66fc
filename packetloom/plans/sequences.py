"""Queries over ordered rows: gaps, sequence numbers, evidence positions and windows."""

from pyspark.sql import functions as F

from packetloom.functions.parse import packet_time_ns
from packetloom.operators import evidence, ordered
from packetloom.plans.catalog import query
from packetloom.plans.sql import ESP, RTP, TAGS, pk
from packetloom.protocols import esp, rtp

PAUSE_MS = 6 * 3600 * 1000.0

GAPS = """,
g AS (SELECT *, us - lag(us) OVER (PARTITION BY flow_key, a_to_b ORDER BY frame_number) AS step
  FROM pk)"""
GAP_STATS = """count(*) FILTER (step >= 0) AS interval_count,
  max(step) FILTER (step >= 0) * 1000 / 1e6 AS max_gap_ms,
  CAST(sum(step) FILTER (step >= 0) AS BIGINT) * 1000 / 1e6 / nullif(count(*) FILTER (step >= 0), 0)
    AS mean_gap_ms,
  count(*) FILTER (step >= 0 AND step / 1e3 >= 21600000) AS pause_count,
  count(*) FILTER (us IS NULL) AS missing_timestamp_count,
  count(*) FILTER (step < 0) AS backward_timestamp_count"""


def timed(t):
    return t.packets.withColumn("time_ns", packet_time_ns())


@query("w01_packet_gap_stats", pk(GAPS + f"""
SELECT flow_key, a_to_b, {GAP_STATS} FROM g GROUP BY flow_key, a_to_b"""))
def packet_gap_stats(t):
    return ordered.gap_stats(timed(t), ["flow_key", "a_to_b"], "time_ns", threshold_ms=PAUSE_MS)


@query("w01_packet_gaps", pk(GAPS + """
SELECT frame_number, CASE WHEN step >= 0 THEN step * 1000 / 1e6 END AS gap_ms,
  coalesce(step < 0, FALSE) AS gap_ms_backward FROM g"""))
def packet_gaps(t):
    rows = timed(t).select("flow_key", "a_to_b", "frame_number", "time_ns")
    return ordered.packet_gaps(rows, ["flow_key", "a_to_b"], "time_ns").select(
        "frame_number", "gap_ms", "gap_ms_backward")


@query("w01_stream_gap_stats", pk(RTP + f"""
SELECT flow_key, direction, rtp_ssrc, {GAP_STATS} FROM r0 GROUP BY ALL"""))
def stream_gap_stats(t):
    return ordered.gap_stats(rtp.stream_rows(t.packets), rtp.STREAM, "time_ns",
                             threshold_ms=PAUSE_MS)


@query("w03_sequence_anomalies", pk(ESP + """
SELECT frame_number, nth > 1 AS is_duplicate, coalesce(nth = 1 AND seq < high, FALSE)
  AS is_out_of_order, CASE WHEN nth = 1 AND seq > high + 1 THEN seq - high - 1 END AS missing
FROM e1"""))
def sequence_anomalies(t):
    rows = t.packets.where("esp_spi IS NOT NULL").select(
        "flow_key", "a_to_b", "esp_spi", "esp_sequence", "frame_number")
    return ordered.sequence_anomalies(
        rows, ["flow_key", "a_to_b", "esp_spi"], "esp_sequence").select(
            "frame_number", "is_duplicate", "is_out_of_order", "missing")


@query("a13_esp_sequences", pk(ESP + """
SELECT flow_key, esp_spi, direction, packets, distinct_sequences, first_sequence, last_sequence,
  highest_sequence, duplicates, out_of_order, gaps, largest_gap, missing FROM esp"""))
def esp_sequences(t):
    return esp.esp_sequences(t.packets).drop("is_forward", "is_reverse")


@query("a13_esp_gaps", pk(ESP + """
SELECT flow_key, esp_spi, direction, frame_number, high AS after_sequence, seq AS next_sequence,
  seq - high - 1 AS missing FROM e1 WHERE nth = 1 AND seq > high + 1"""))
def esp_gaps(t):
    return esp.esp_gaps(t.packets)


@query("a34_esp_gap_distribution", pk(ESP + """
SELECT flow_key, esp_spi, direction, seq - high - 1 AS missing, count(*) AS n FROM e1
WHERE nth = 1 AND seq > high + 1 GROUP BY ALL"""))
def esp_gap_distribution(t):
    return esp.esp_gap_distribution(esp.esp_gaps(t.packets))


@query("w04_extended_sequences", pk(RTP + """
SELECT frame_number, CAST(ext AS BIGINT) AS extended, CAST(high AS BIGINT) AS highest_before
FROM r2"""))
def extended_sequences(t):
    rows = rtp.stream_rows(t.packets).select(*rtp.STREAM, "rtp_sequence", "frame_number")
    return ordered.extend_sequence(rows, rtp.STREAM, "rtp_sequence").select(
        "frame_number", "extended", "highest_before")


@query("a14_rtp_streams", pk(RTP + f"""
, st AS (SELECT flow_key, direction, rtp_ssrc, count(*) AS packets,
    count(*) FILTER (srtp) AS srtp_packets, count(*) - count(DISTINCT ext) AS duplicates,
    count(*) FILTER (nth = 1 AND ext < high) AS out_of_order,
    CAST(greatest(0, max(ext) - min(ext) + 1 - count(DISTINCT ext)) AS BIGINT) AS holes
  FROM r2 GROUP BY ALL),
gs AS (SELECT flow_key, direction, rtp_ssrc, {GAP_STATS} FROM r0 GROUP BY ALL)
SELECT st.*, interval_count, max_gap_ms, mean_gap_ms, pause_count FROM st
JOIN gs USING (flow_key, direction, rtp_ssrc)"""))
def rtp_streams(t):
    return rtp.rtp_streams(t.packets, PAUSE_MS).select(
        *rtp.STREAM, "packets", "srtp_packets", "duplicates", "out_of_order", "holes",
        "interval_count", "max_gap_ms", "mean_gap_ms", "pause_count")


@query("a14_rtp_payload_types", pk(RTP + """
SELECT flow_key, direction, rtp_ssrc, rtp_payload_type, count(*) AS n FROM r0 GROUP BY ALL"""))
def rtp_payload_types(t):
    return rtp.rtp_payload_types(t.packets)


TOOLS = """,
tl AS (SELECT flow_key, frame_number, a_to_b, unnest(CASE kind
    WHEN 'web' THEN ['deep_tcp_flow', 'deep_tls_flow'] WHEN 'smb' THEN ['deep_tcp_flow',
    'deep_smb2_flow'] WHEN 'esp' THEN ['deep_esp_flow'] WHEN 'rtp' THEN ['deep_udp_flow',
    'deep_rtp_flow'] ELSE ['deep_udp_flow'] END) AS tool FROM pk),
pos AS (SELECT *, row_number() OVER (PARTITION BY flow_key, tool ORDER BY frame_number) - 1
  AS position FROM tl)"""

REASONS = TAGS + ESP + RTP + GAPS + """,
rs AS (SELECT frame_number, slot AS o, issue AS reason FROM tags
  UNION ALL SELECT frame_number, 100, 'DNS response code ' || dns_response_code FROM pk
    WHERE dns_response_code NOT IN ('0', 'No error')
  UNION ALL SELECT frame_number, 200, concat('SIP status ', sip_status_code) FROM pk
    WHERE sip_status_code >= 400
  UNION ALL SELECT frame_number, 300, concat('TLS alert ', tls_alert_level, ': ',
    tls_alert_description) FROM pk WHERE alerted
  UNION ALL SELECT frame_number, 700, 'Direction packet gap' FROM g WHERE step / 1e3 >= 21600000
  UNION ALL SELECT frame_number, 800, concat('ESP ', esp_spi, ': ', CASE WHEN nth > 1
      THEN 'duplicate sequence' WHEN seq < high THEN 'out-of-order sequence'
      ELSE concat('sequence gap of ', seq - high - 1) END, ' observed (not proven loss)')
    FROM e1 WHERE nth > 1 OR seq < high OR seq > high + 1
  UNION ALL SELECT frame_number, 900, concat('RTP SSRC ', rtp_ssrc, ' gap') FROM r0
    WHERE step / 1e3 >= 21600000
  UNION ALL SELECT frame_number, 1000, concat('RTP ', rtp_ssrc, ': ', CASE WHEN nth > 1
      THEN 'duplicate sequence' WHEN ext < high THEN 'out-of-order sequence'
      ELSE concat('sequence gap of ', CAST(ext - high - 1 AS BIGINT)) END,
      ' observed (not proven loss)') FROM r2 WHERE nth > 1 OR ext < high OR ext > high + 1),
tr AS (SELECT frame_number, string_agg(reason, '; ' ORDER BY o, reason) AS reasons,
    list(reason ORDER BY o, reason) AS listed FROM rs GROUP BY frame_number)""" + TOOLS + """,
trig AS (SELECT pos.*, reasons, listed FROM pos JOIN tr USING (frame_number))"""


@query("w06_evidence_positions", pk(TOOLS + """
SELECT flow_key, tool, frame_number, position FROM pos"""))
def evidence_positions(t):
    return evidence.evidence_positions(t.packets).drop("a_to_b")


@query("w07_evidence_triggers", pk(REASONS + """
SELECT flow_key, tool, frame_number, position, a_to_b, reasons FROM trig"""))
def evidence_triggers(t):
    return evidence.evidence_triggers(t.packets, PAUSE_MS).withColumn(
        "reasons", F.array_join("reasons", "; "))


WINDOWS = REASONS + """,
nx AS (SELECT flow_key, tool, position, greatest(position - 100, 0) AS start FROM trig),
one AS (SELECT flow_key, tool, min(position) AS position FROM nx GROUP BY ALL),
win AS (WITH RECURSIVE w AS (
    SELECT flow_key, tool, position, greatest(position - 100, 0) AS start FROM one
    UNION ALL
    SELECT w.flow_key, w.tool, n.position, greatest(n.position - 100, 0) FROM w JOIN LATERAL (
      SELECT min(nx.position) AS position FROM nx WHERE nx.flow_key = w.flow_key
        AND nx.tool = w.tool AND nx.position >= w.start + 1000) n ON n.position IS NOT NULL)
  SELECT * FROM w),
inw AS (SELECT win.flow_key, win.tool, win.start AS sample_offset, win.position AS opener, trig.position,
  trig.frame_number, trig.a_to_b, trig.listed
FROM win JOIN trig ON trig.flow_key = win.flow_key AND trig.tool = win.tool
  AND trig.position >= win.position AND trig.position < win.start + 1000),
said AS (SELECT flow_key, tool, sample_offset, position, k, listed[k] AS reason
  FROM inw, unnest(range(1, len(listed) + 1)) AS x(k)),
named AS (SELECT *, row_number() OVER (PARTITION BY flow_key, tool, sample_offset ORDER BY first) - 1 AS idx
  FROM (SELECT flow_key, tool, sample_offset, reason, min((position, k)) AS first FROM said GROUP BY ALL)),
pointed AS (SELECT flow_key, tool, sample_offset, position, string_agg(idx, ',' ORDER BY k) AS indices
  FROM said JOIN named USING (flow_key, tool, sample_offset, reason) GROUP BY ALL),
ew AS (SELECT flow_key, tool, sample_offset, opener AS issue_packet_index, count(*) AS issue_count,
  string_agg(concat(position, ':', frame_number, ':', a_to_b, ':', indices), ' ' ORDER BY position) AS events
FROM inw JOIN pointed USING (flow_key, tool, sample_offset, position) GROUP BY ALL),
er AS (SELECT flow_key, tool, sample_offset, string_agg(reason, '; ' ORDER BY idx) AS reasons FROM named GROUP BY ALL)"""


@query("w09_evidence_windows", pk(WINDOWS + """
SELECT flow_key, tool, sample_offset, issue_packet_index, issue_count, reasons, events
FROM ew JOIN er USING (flow_key, tool, sample_offset)"""))
def evidence_windows(t):
    told = F.transform("events", lambda e: F.concat_ws(
        ":", e["issue_packet_index"], e["frame_number"], e["a_to_b"],
        F.array_join(e["reason_indices"].cast("array<string>"), ",")))
    return evidence.merge_windows(evidence.evidence_triggers(t.packets, PAUSE_MS)).select(
        "flow_key", "tool", "sample_offset", "issue_packet_index", "issue_count",
        F.array_join("reasons", "; ").alias("reasons"), F.array_join(told, " ").alias("events"))
