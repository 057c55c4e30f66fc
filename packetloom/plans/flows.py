"""Queries over flows: rollups, frequency tables, rates, hints and reports."""

from pyspark.sql import functions as F

from packetloom.operators import metrics, rollup
from packetloom.plans.catalog import query
from packetloom.plans.sql import ESP, FLOWS, PROTOCOL_NAMES, TAGS, pk


def micros(name):
    return F.unix_micros(F.col(name).cast("timestamp"))


@query("a01_capture_totals", pk("""
SELECT count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS total_bytes,
  count(DISTINCT flow_key) AS flow_count FROM pk"""))
def capture_totals(t):
    return rollup.capture_totals(t.packets)


def counted(source, key):
    return f"""SELECT {key}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(pos))
  AS rank FROM ({source}) GROUP BY {key}"""


@query("a02_protocol_counts", pk(counted(
    "SELECT protocol, frame_number AS pos FROM pk", "protocol")))
def protocol_counts(t):
    return rollup.protocol_counts(t.packets)


@query("a03_port_counts", pk(counted("""
  SELECT src_port AS port, frame_number * 2 AS pos FROM pk WHERE src_port IS NOT NULL
  UNION ALL SELECT dst_port, frame_number * 2 + 1 FROM pk WHERE dst_port IS NOT NULL""", "port")))
def port_counts(t):
    return rollup.port_counts(t.packets)


NAMES = """SELECT dns_query AS name, frame_number * 4 AS pos FROM pk WHERE dns_query IS NOT NULL
  UNION ALL SELECT http_host, frame_number * 4 + 1 FROM pk WHERE http_host IS NOT NULL
  UNION ALL SELECT tls_sni, frame_number * 4 + 2 FROM pk WHERE tls_sni IS NOT NULL"""


@query("a04_name_counts", pk(counted(NAMES, "name")))
def name_counts(t):
    return rollup.name_counts(t.packets)


@query("a05_issue_counts", pk(TAGS + counted(
    "SELECT issue, frame_number * 8 + slot AS pos FROM tags", "issue")))
def issue_counts(t):
    return rollup.issue_counts(t.packets)


@query("a06_flow_rollup", pk(FLOWS + """
SELECT flow_key, protocol, endpoint_a, port_a, endpoint_b, port_b, packet_count, byte_count,
  first_us, last_us, first_frame FROM fl"""))
def flow_rollup(t):
    return t.flows.select(
        "flow_key", "protocol", "endpoint_a", "port_a", "endpoint_b", "port_b", "packet_count",
        "byte_count", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"),
        "first_frame")


@query("a07_direction_totals", pk(FLOWS + """
SELECT flow_key, a_to_b_packets, b_to_a_packets, a_to_b_bytes, b_to_a_bytes FROM fl"""))
def direction_totals(t):
    return rollup.direction_totals(t.packets)


@query("a08_flow_issue_counts", pk(TAGS + """
SELECT flow_key, a_to_b, issue, count(*) AS n FROM tags GROUP BY ALL"""))
def flow_issue_counts(t):
    return rollup.flow_issue_counts(t.packets)


@query("a09_rtt_stats", pk("""
, r AS (SELECT flow_key, rtt_seconds * 1000 AS ms, row_number() OVER (PARTITION BY flow_key
      ORDER BY rtt_seconds * 1000) - 1 AS pos, count(*) OVER (PARTITION BY flow_key) AS n
    FROM pk WHERE rtt_seconds IS NOT NULL)
SELECT flow_key, count(*) AS rtt_samples,
  CAST(sum(CAST(ms AS DECIMAL(28, 9))) AS DOUBLE) / count(*) AS rtt_mean_ms,
  max(ms) FILTER (pos = CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT)) AS rtt_median_ms,
  max(ms) FILTER (pos = CAST(round_even((n - 1) * 0.95::DOUBLE, 0) AS BIGINT)) AS rtt_p95_ms,
  max(ms) AS rtt_max_ms FROM r GROUP BY flow_key"""))
def rtt_stats(t):
    return rollup.rtt_stats(t.packets)


@query("a10_initial_rtt", pk("""
SELECT flow_key, arg_max(initial_rtt_seconds, frame_number) * 1000 AS initial_rtt_ms
FROM pk WHERE initial_rtt_seconds IS NOT NULL GROUP BY flow_key"""))
def initial_rtt(t):
    return rollup.initial_rtt(t.packets)


@query("a11_flow_protocol_sets", pk(PROTOCOL_NAMES + """
, n AS (SELECT flow_key, CASE name WHEN 'SMB2' THEN 'SMB2' ELSE name END AS name,
    bool_or(a_to_b) AS ab, bool_or(NOT a_to_b) AS ba FROM pn GROUP BY ALL)
SELECT flow_key, string_agg(name, ',' ORDER BY name) AS decoded_protocols,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ab), '') AS protocols_a_to_b,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (ba), '') AS protocols_b_to_a
FROM n GROUP BY flow_key"""))
def flow_protocol_sets(t):
    sets = rollup.flow_protocol_sets(t.packets)
    return sets.select("flow_key", *[F.array_join(c, ",").alias(c) for c in sets.columns[1:]])


FLOW_NAMES = """
, x AS (SELECT flow_key, frame_number, unnest(list_sort(list_distinct(
    [n FOR n IN [dns_query, http_host, tls_sni] IF n IS NOT NULL]))) AS name FROM pk),
y AS (SELECT flow_key, name, min(frame_number) AS pos FROM x GROUP BY ALL),
flow_names AS (SELECT flow_key, name, row_number() OVER (PARTITION BY flow_key ORDER BY pos, name)
  AS position FROM y)"""


@query("a12_flow_names", pk(FLOW_NAMES + "SELECT flow_key, name, position FROM flow_names"))
def flow_names(t):
    return rollup.flow_names(t.packets)


@query("a12_redirect_locations", pk("""
, y AS (SELECT flow_key, http_location, min(frame_number) AS pos FROM pk
    WHERE http_location IS NOT NULL GROUP BY ALL)
SELECT flow_key, http_location, row_number() OVER (PARTITION BY flow_key ORDER BY pos) AS position
FROM y"""))
def redirect_locations(t):
    return rollup.redirect_locations(t.packets)


@query("w10_flow_ids", pk(FLOWS + "SELECT flow_id, flow_key, byte_count FROM ranked"))
def flow_ids(t):
    return t.ranked.select("flow_id", "flow_key", "byte_count")


TOP = """SELECT flow_id, flow_key, byte_count, duration_s,
  CASE WHEN duration_s > 0 THEN a_to_b_bytes * 8 / duration_s / 1e6 END AS a_to_b_mbps,
  CASE WHEN duration_s > 0 THEN b_to_a_bytes * 8 / duration_s / 1e6 END AS b_to_a_mbps FROM ranked"""


def with_rates(flows):
    return metrics.with_duration(flows).withColumns(metrics.throughput_mbps()).select(
        "flow_id", "flow_key", "byte_count", "duration_s", "a_to_b_mbps", "b_to_a_mbps")


@query("g01_top_flows", pk(FLOWS + TOP + " WHERE flow_id <= 25"))
def top_flows(t):
    return with_rates(rollup.top_flows(t.flows.select(*rollup.CORE_COLUMNS), 25))


@query("g02_top_flows_and_one", pk(FLOWS + TOP + " WHERE flow_id <= 10 OR flow_id = 50"))
def select_flows(t):
    return with_rates(rollup.select_flows(t.flows.select(*rollup.CORE_COLUMNS), 10, 50))


@query("g05_counter_by_frequency", pk("""
, c AS (SELECT flow_key, count(*) AS n, min(frame_number) AS first_at FROM pk GROUP BY flow_key)
SELECT flow_key, n, row_number() OVER (ORDER BY n DESC, first_at) AS rank FROM c"""))
def counter_by_frequency(t):
    return rollup.counter(t.packets.select("flow_key", F.col("frame_number").alias("at")), "flow_key")


@query("a33_summary_from_flows", pk(FLOWS + TAGS + FLOW_NAMES + """
, keep AS (SELECT * FROM ranked),
pr AS (SELECT 'protocol' AS kind, protocol AS value, CAST(sum(packet_count) AS BIGINT) AS n,
    min(flow_id) AS first FROM keep GROUP BY protocol),
po AS (SELECT 'port' AS kind, CAST(port AS VARCHAR) AS value, CAST(sum(packet_count) AS BIGINT) AS n,
    min(pos) AS first FROM (SELECT port_a AS port, packet_count, flow_id * 2 AS pos FROM keep
      UNION ALL SELECT port_b, packet_count, flow_id * 2 + 1 FROM keep) WHERE port IS NOT NULL
    GROUP BY port),
iss AS (SELECT 'issue' AS kind, issue AS value, count(*) AS n, min(flow_id) AS first FROM tags
    JOIN keep USING (flow_key) GROUP BY issue),
nm AS (SELECT 'name' AS kind, name AS value, CAST(NULL AS BIGINT) AS n, row_number() OVER (
    ORDER BY min(flow_id * 100000 + position)) AS first FROM flow_names JOIN keep USING (flow_key)
    GROUP BY name),
allr AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first, value) AS rank FROM
    (SELECT * FROM pr UNION ALL SELECT * FROM po UNION ALL SELECT * FROM iss
     UNION ALL SELECT * FROM nm))
SELECT kind, value, n, rank FROM allr"""))
def summary_from_flows(t):
    return rollup.summary_from_flows(
        t.ranked, rollup.flow_issue_counts(t.packets), rollup.flow_names(t.packets))


@query("a33_saved_summary", pk(FLOWS + """
, po AS (SELECT CAST(port AS VARCHAR) AS value, CAST(sum(packet_count) AS BIGINT) AS n, min(pos) AS first
    FROM (SELECT port_a AS port, packet_count, flow_id * 2 AS pos FROM ranked
      UNION ALL SELECT port_b, packet_count, flow_id * 2 + 1 FROM ranked) WHERE port IS NOT NULL GROUP BY port)
SELECT 'port' AS kind, value, n, row_number() OVER (ORDER BY n DESC, first, value) AS rank FROM po
QUALIFY rank <= 20"""))
def saved_summary(t):
    """The documented cut of a saved summary, where it is asked for."""
    cut = rollup.summary_from_flows(t.ranked, rollup.flow_issue_counts(t.packets),
                                    rollup.flow_names(t.packets), rollup.SAVED_MOST)
    return cut.where("kind = 'port'")


@query("u01_endpoint_inventory", pk(FLOWS + """
SELECT 'endpoint' AS kind, endpoint_a AS value FROM fl UNION SELECT 'endpoint', endpoint_b FROM fl
UNION SELECT 'endpoint_port', concat_ws(':', endpoint_a, CAST(port_a AS VARCHAR)) FROM fl
UNION SELECT 'endpoint_port', concat_ws(':', endpoint_b, CAST(port_b AS VARCHAR)) FROM fl"""))
def endpoint_inventory(t):
    return rollup.endpoint_inventory(t.flows)


@query("m01_duration", pk(FLOWS + "SELECT flow_key, duration_s FROM fl"))
def duration(t):
    return metrics.with_duration(t.flows).select("flow_key", "duration_s")


@query("m02_packet_rates", pk(FLOWS + """SELECT flow_key,
  CASE WHEN duration_s > 0 THEN a_to_b_packets / duration_s END AS a_to_b_packets_per_s,
  CASE WHEN duration_s > 0 THEN b_to_a_packets / duration_s END AS b_to_a_packets_per_s FROM fl"""))
def packet_rates(t):
    rates = metrics.packet_rates()
    return metrics.with_duration(t.flows).withColumns(rates).select("flow_key", *rates)


@query("m03_throughput", pk(FLOWS + """SELECT flow_key,
  CASE WHEN duration_s > 0 THEN a_to_b_bytes * 8 / duration_s / 1e6 END AS a_to_b_mbps,
  CASE WHEN duration_s > 0 THEN b_to_a_bytes * 8 / duration_s / 1e6 END AS b_to_a_mbps FROM fl"""))
def throughput(t):
    rates = metrics.throughput_mbps()
    return metrics.with_duration(t.flows).withColumns(rates).select("flow_key", *rates)


@query("m04_total_rates", pk(FLOWS + """SELECT flow_key,
  CASE WHEN duration_s > 0 THEN packet_count / duration_s ELSE 0.0 END AS packets_per_s,
  CASE WHEN duration_s > 0 THEN byte_count / duration_s ELSE 0.0 END AS bytes_per_s,
  CASE WHEN duration_s > 0 THEN byte_count / duration_s * 8 / 1e6 ELSE 0.0 END AS mbps FROM fl"""))
def total_rates(t):
    rates = metrics.total_rates()
    return metrics.with_duration(t.flows).withColumns(rates).select("flow_key", *rates)


def tag_rates(tag, out):
    return TAGS + FLOWS + f"""
, g AS (SELECT flow_key, count(*) AS n, count(*) FILTER (a_to_b) AS ab,
    count(*) FILTER (NOT a_to_b) AS ba FROM tags WHERE issue = '{tag}' GROUP BY flow_key),
{out} AS (SELECT fl.*, coalesce(n, 0) AS n, coalesce(n, 0) / packet_count AS r,
    CASE WHEN a_to_b_packets > 0 THEN coalesce(ab, 0) / a_to_b_packets ELSE 0.0 END AS rab,
    CASE WHEN b_to_a_packets > 0 THEN coalesce(ba, 0) / b_to_a_packets ELSE 0.0 END AS rba
  FROM fl LEFT JOIN g USING (flow_key))"""


ESP_FLOWS = ESP + """
, ef AS (SELECT flow_key, CAST(sum(missing) AS BIGINT) AS missing,
    CAST(sum(missing + distinct_sequences) AS BIGINT) AS expected,
    CAST(sum(out_of_order) AS BIGINT) AS ooo,
    coalesce(sum(missing) FILTER (a_to_b), 0) AS m_ab,
    coalesce(sum(missing + distinct_sequences) FILTER (a_to_b), 0) AS x_ab,
    coalesce(sum(out_of_order) FILTER (a_to_b), 0) AS o_ab,
    coalesce(sum(packets) FILTER (a_to_b), 0) AS p_ab,
    coalesce(sum(missing) FILTER (NOT a_to_b), 0) AS m_ba,
    coalesce(sum(missing + distinct_sequences) FILTER (NOT a_to_b), 0) AS x_ba,
    coalesce(sum(out_of_order) FILTER (NOT a_to_b), 0) AS o_ba,
    coalesce(sum(packets) FILTER (NOT a_to_b), 0) AS p_ba,
    bool_or(missing > 0 OR out_of_order > 0 OR duplicates > 0 OR largest_gap > 0) AS anomaly
  FROM esp GROUP BY flow_key)"""


@query("m05_retransmission_rates", pk(tag_rates("tcp_retransmission", "z") + """
SELECT flow_key, r AS retransmission_rate, rab AS a_to_b_retransmission_rate,
  rba AS b_to_a_retransmission_rate FROM z"""))
def retransmission_rates(t):
    rates = metrics.retransmission_rates()
    return t.flows.withColumns(rates).select("flow_key", *rates)


@query("m06_loss_rates", pk(tag_rates("tcp_lost_segment", "z") + ESP_FLOWS + """
SELECT flow_key, CASE WHEN ef.flow_key IS NULL THEN r WHEN expected > 0 THEN missing / expected
    ELSE r END AS loss_rate,
  CASE WHEN ef.flow_key IS NULL THEN rab WHEN x_ab > 0 THEN m_ab / x_ab ELSE 0.0 END AS a_to_b_loss_rate,
  CASE WHEN ef.flow_key IS NULL THEN rba WHEN x_ba > 0 THEN m_ba / x_ba ELSE 0.0 END AS b_to_a_loss_rate
FROM z LEFT JOIN ef USING (flow_key)"""))
def loss_rates(t):
    from packetloom.protocols.esp import esp_sequences

    rates = metrics.loss_rates()
    return metrics.with_esp(t.flows, esp_sequences(t.packets)).select(
        "flow_key", *[c.alias(n) for n, c in rates.items()])


@query("m07_out_of_order", pk(tag_rates("tcp_out_of_order", "z") + ESP_FLOWS + """
SELECT flow_key, coalesce(ooo, n) AS out_of_order_count,
  coalesce(ooo, n) / packet_count AS out_of_order_rate,
  CASE WHEN ef.flow_key IS NULL THEN rab WHEN p_ab > 0 THEN o_ab / p_ab ELSE 0.0 END
    AS a_to_b_out_of_order_rate,
  CASE WHEN ef.flow_key IS NULL THEN rba WHEN p_ba > 0 THEN o_ba / p_ba ELSE 0.0 END
    AS b_to_a_out_of_order_rate
FROM z LEFT JOIN ef USING (flow_key)"""))
def out_of_order(t):
    from packetloom.protocols.esp import esp_sequences

    rates = metrics.out_of_order()
    return metrics.with_esp(t.flows, esp_sequences(t.packets)).select(
        "flow_key", *[c.alias(n) for n, c in rates.items()])


@query("m08_one_way", pk(FLOWS + """
SELECT flow_key, a_to_b_packets = 0 OR b_to_a_packets = 0 AS one_way FROM fl"""))
def one_way(t):
    return t.flows.select("flow_key", metrics.is_one_way().alias("one_way"))


@query("w02_max_interarrival", pk("""
, x AS (SELECT flow_key, us - max(us) OVER (PARTITION BY flow_key ORDER BY frame_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wait FROM pk)
SELECT flow_key, max(wait) / 1e3 AS max_interarrival_ms FROM x WHERE wait >= 0 GROUP BY flow_key"""))
def max_interarrival(t):
    return rollup.max_interarrival(t.packets)
