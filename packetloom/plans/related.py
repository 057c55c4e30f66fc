"""Queries that follow calls, redirects, file handles and addresses."""

from pyspark.sql import functions as F

from packetloom.operators import deep, related
from packetloom.plans.catalog import query
from packetloom.plans.sql import FLOWS, pk
from packetloom.protocols import smb

DIGITS = "regexp_replace(coalesce({}, ''), '[^0-9]', '', 'g')"


def dialled(number):
    return " OR ".join(f"{DIGITS.format(c)} LIKE '%{number}%'" for c in ("sip_from", "sip_to"))


@query("j01_calls_by_phone", pk(f"""
, c AS (SELECT DISTINCT sip_call_id FROM pk WHERE sip_call_id IS NOT NULL AND ({dialled('2003')}))
SELECT frame_number, sip_call_id FROM pk WHERE sip_call_id IN (SELECT sip_call_id FROM c)
  OR (sip_call_id IS NULL AND ({dialled('2003')}))"""))
def calls_by_phone(t):
    return related.calls_by_phone(t.packets, "20-03").select("frame_number", "sip_call_id")


TARGETS = """
, hosts AS (SELECT DISTINCT lower(regexp_extract(http_location, '^https?://([^:/]+)', 1)) AS value
    FROM pk WHERE http_location IS NOT NULL),
addresses AS (SELECT DISTINCT dns_answer AS value FROM pk WHERE dns_answer IS NOT NULL
    AND dns_query IN (SELECT value FROM hosts))"""


@query("j02_redirect_targets", pk(TARGETS + """
SELECT 'name' AS kind, value FROM hosts UNION ALL SELECT 'address', value FROM addresses"""))
def redirect_targets(t):
    return related.redirect_targets(t.packets, t.packets.where("kind = 'web'"))


@query("j02_with_redirects", pk(TARGETS + """
SELECT frame_number, kind FROM pk WHERE (kind = 'web' AND k % 25 < 5)
  OR dns_query IN (SELECT value FROM hosts) OR http_host IN (SELECT value FROM hosts)
  OR tls_sni IN (SELECT value FROM hosts) OR src_ip IN (SELECT value FROM addresses)
  OR dst_ip IN (SELECT value FROM addresses)"""))
def with_redirects(t):
    seed = t.packets.where("kind = 'web' AND k % 25 < 5")
    return related.with_redirects(t.packets, seed).select("frame_number", "kind")


@query("u02_seed_or_related", pk("""
SELECT frame_number FROM pk WHERE kind = 'dns' OR k < 30"""))
def seed_or_related(t):
    return related.seed_or_related(
        t.packets, t.packets.where("kind = 'dns'"), t.packets.where("k < 30")).select("frame_number")


SMB = """
, sm AS (SELECT *, list_contains([1, 3], smb_access) AS to_read, list_contains([2, 3], smb_access)
    AS to_write, smb_command = 'SMB2create' AND smb_filename IS NOT NULL AS creates
    FROM pk WHERE kind = 'smb'),
s1 AS (SELECT *, last_value(CASE WHEN creates THEN smb_filename END IGNORE NULLS) OVER w AS p_any,
    last_value(CASE WHEN creates AND to_read THEN smb_filename END IGNORE NULLS) OVER w AS p_read,
    last_value(CASE WHEN creates AND to_write THEN smb_filename END IGNORE NULLS) OVER w AS p_write
  FROM sm WINDOW w AS (PARTITION BY flow_key, smb_message_id ORDER BY frame_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s2 AS (SELECT *, CASE WHEN smb_file_id IS NOT NULL THEN coalesce(p_any, smb_filename) END AS b_any,
    CASE WHEN smb_file_id IS NOT NULL THEN coalesce(p_read, CASE WHEN to_read THEN smb_filename END)
      END AS b_read,
    CASE WHEN smb_file_id IS NOT NULL THEN coalesce(p_write, CASE WHEN to_write THEN smb_filename END)
      END AS b_write FROM s1),
s3 AS (SELECT *, last_value(b_read IGNORE NULLS) OVER w AS l_read,
    last_value(b_write IGNORE NULLS) OVER w AS l_write
  FROM s2 WINDOW w AS (PARTITION BY flow_key, smb_file_id ORDER BY frame_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s4 AS (SELECT *, coalesce(CASE WHEN smb_file_id IS NOT NULL THEN l_read END, smb_filename)
      AS read_filename,
    coalesce(CASE WHEN smb_file_id IS NOT NULL THEN l_write END, smb_filename) AS write_filename
  FROM s3)"""

SMB_OPS = SMB + """
, o0 AS (SELECT *, CASE smb_command WHEN 'SMB2read' THEN 'read' ELSE 'write' END AS kind2,
    CASE smb_command WHEN 'SMB2read' THEN smb_read_length ELSE smb_write_length END AS len,
    CASE smb_command WHEN 'SMB2read' THEN read_filename ELSE write_filename END AS filename
  FROM s4 WHERE smb_command <> 'SMB2create'
    AND NOT (rev AND coalesce(smb_status, '') = '0xc0000022')),
o1 AS (SELECT *, row_number() OVER (PARTITION BY flow_key, kind2, smb_message_id
    ORDER BY frame_number) = 1 AS counts_op, coalesce(filename, smb_file_id, '<unknown>') AS file_key
  FROM o0),
o2 AS (SELECT frame_number, smb_file_offset - lag(smb_file_offset) OVER (
    PARTITION BY flow_key, kind2, file_key ORDER BY frame_number) AS step FROM o1
  WHERE smb_file_offset IS NOT NULL),
ops AS (SELECT o1.*, CASE WHEN len IS NULL AND step > 0 THEN step END AS inferred
  FROM o1 LEFT JOIN o2 USING (frame_number)),
tf AS (SELECT flow_key, kind2 AS kind, count(*) FILTER (counts_op) AS ops,
    CAST(coalesce(sum(coalesce(len, inferred)), 0) AS BIGINT) AS bytes,
    count(*) FILTER (counts_op AND len IS NULL AND inferred IS NULL) AS unknown_ops,
    count(inferred) AS inferred_ops FROM ops GROUP BY ALL),
fb AS (SELECT flow_key, kind2 AS kind, filename, CAST(sum(coalesce(len, inferred)) AS BIGINT) AS bytes,
    min(frame_number) AS first_at FROM ops WHERE coalesce(len, inferred) > 0
    AND filename IS NOT NULL GROUP BY ALL)"""


@query("j03_create_bindings", pk(SMB + """
SELECT flow_key, smb_file_id, b_any AS filename, frame_number FROM s2 WHERE b_any IS NOT NULL"""))
def create_bindings(t):
    return smb.smb_create_bindings(t.packets)


@query("j04_transfer_names", pk(SMB + """
SELECT frame_number, read_filename, write_filename FROM s4"""))
def transfer_names(t):
    return smb.smb_transfer_names(t.packets).select(
        "frame_number", "read_filename", "write_filename")


@query("w05_smb_transfer_ops", pk(SMB_OPS + """
SELECT frame_number, kind2 AS kind, counts_op, inferred AS inferred_length FROM ops"""))
def transfer_ops(t):
    return smb.smb_transfer_ops(t.packets).select(
        "frame_number", "kind", "counts_op", "inferred_length")


@query("a22_smb_transfers", pk(SMB_OPS + "SELECT * FROM tf"))
def smb_transfers(t):
    return smb.smb_transfers(smb.smb_transfer_ops(t.packets))


@query("a22_smb_file_bytes", pk(SMB_OPS + "SELECT * FROM fb"))
def smb_file_bytes(t):
    return smb.smb_file_bytes(smb.smb_transfer_ops(t.packets))


@query("g04_large_files", pk(SMB_OPS + """
SELECT flow_key, kind, filename, bytes, first_at, row_number() OVER (PARTITION BY flow_key, kind
  ORDER BY bytes DESC, first_at) AS rank FROM fb WHERE bytes >= 100000 QUALIFY rank <= 2"""))
def large_files(t):
    return smb.large_files(smb.smb_file_bytes(smb.smb_transfer_ops(t.packets)), 100_000, 2)


@query("j05_attach_flow_ids", pk(FLOWS + """
SELECT frame_number, flow_id FROM pk JOIN ranked USING (flow_key)"""))
def attach(t):
    return deep.attach(t.packets.select("flow_key", "frame_number"), t.ranked).select(
        "frame_number", "flow_id")


REQUESTS = """
, rq AS (SELECT frame_number AS request_id, ((frame_number * 7) % 900) AS flow_id,
    CASE k % 4 WHEN 0 THEN 'deep_tcp_flow' WHEN 1 THEN 'deep_udp_flow' WHEN 2 THEN 'deep_tls_flow'
      ELSE 'deep_any_flow' END AS tool, k % 30 AS "offset" FROM pk WHERE k < 40)"""
LOOKUP = FLOWS + REQUESTS + """
, ts AS (SELECT flow_key, frame_number, unnest(CASE kind WHEN 'web' THEN ['deep_tcp_flow',
    'deep_tls_flow'] WHEN 'smb' THEN ['deep_tcp_flow'] WHEN 'esp' THEN [] ELSE ['deep_udp_flow'] END)
    AS tool FROM pk),
tn AS (SELECT flow_key, tool, count(*) AS n FROM ts GROUP BY ALL),
an AS (SELECT rq.*, flow_key, CASE WHEN tool = 'deep_any_flow' THEN 'rejected'
    WHEN flow_key IS NULL THEN 'not_found' WHEN (tool = 'deep_tcp_flow' AND protocol = 'TCP')
      OR (tool = 'deep_udp_flow' AND protocol = 'UDP')
      OR (tool = 'deep_tls_flow' AND protocol IN ('TCP', 'UDP')) THEN 'ok' ELSE 'skipped' END AS status
  FROM rq LEFT JOIN ranked USING (flow_id))"""


def requests(t):
    return t.packets.where("k < 40").selectExpr(
        "frame_number AS request_id", "(frame_number * 7) % 900 AS flow_id",
        """CASE k % 4 WHEN 0 THEN 'deep_tcp_flow' WHEN 1 THEN 'deep_udp_flow'
           WHEN 2 THEN 'deep_tls_flow' ELSE 'deep_any_flow' END AS tool""", "k % 30 AS offset")


@query("j06_evidence_lookup", pk(LOOKUP + """
, tt AS (SELECT an.*, CASE WHEN status = 'ok' THEN coalesce(n, 0) END AS total FROM an
  LEFT JOIN tn USING (flow_key, tool))
SELECT request_id, status, total AS total_matching,
  CASE WHEN total IS NOT NULL THEN greatest(0, least(20, total - "offset")) END AS returned,
  CASE WHEN total IS NOT NULL AND "offset" + greatest(0, least(20, total - "offset")) < total
    THEN "offset" + greatest(0, least(20, total - "offset")) END AS next_offset FROM tt"""))
def evidence_lookup(t):
    answers = deep.evidence_lookup(requests(t), t.ranked, t.headers, limit=20)
    return answers.select(
        "request_id", "status", "total_matching",
        F.when(F.col("total_matching").isNotNull(), F.col("returned")).alias("returned"),
        "next_offset")


@query("j06_requested_rows", pk(LOOKUP + """
, nn AS (SELECT flow_key, tool, frame_number, row_number() OVER (PARTITION BY flow_key, tool
    ORDER BY frame_number) - 1 AS position FROM ts)
SELECT request_id, position, nn.frame_number FROM an JOIN nn USING (flow_key, tool)
WHERE status = 'ok' AND position >= "offset" AND position < "offset" + 20"""))
def requested_rows(t):
    return deep.requested_rows(requests(t), t.ranked, t.headers, limit=20).select(
        "request_id", "position", "frame_number")


OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


@query("j07_unverified_addresses", pk(f"""
, m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text,
    '\\b((?:\\d{{1,3}}\\.){{3}}\\d{{1,3}})\\b', 1)) AS address FROM documents),
inv AS (SELECT src_ip AS address FROM pk UNION SELECT dst_ip FROM pk
  UNION SELECT dns_answer FROM pk)
SELECT doc_id, address FROM m WHERE regexp_full_match(address, '{OCTET}(\\.{OCTET}){{3}}')
  AND address NOT IN (SELECT address FROM inv WHERE address IS NOT NULL)"""))
def unverified_addresses(t):
    return related.unverified_addresses(
        t.given("documents"), "doc_id", "text", related.observed_addresses(t.packets))
