"""Queries that feed the packet table to a stream in parts, one of them late, and read its state."""

from pyspark.sql import functions as F

from packetloom.plans.catalog import query
from packetloom.plans.sql import FLOWS, pk
from packetloom.settings import scratch_path
from packetloom.streaming import keystate, rollup

#: Quarters of the capture in order of arrival: the second one comes late.
ARRIVAL = (0, 2, 1, 3)

ARRIVED = """,
ends AS (SELECT max(frame_number) AS last FROM pk),
arrived AS (SELECT pk.*, list_position([0, 2, 1, 3], (frame_number > last // 4)::INT
    + (frame_number > last * 2 // 4)::INT + (frame_number > last * 3 // 4)::INT) AS turn FROM pk, ends)"""
ARRIVED_GAPS = ARRIVED + """,
g AS (SELECT *, us - lag(us) OVER (PARTITION BY flow_key, a_to_b ORDER BY turn, frame_number) AS step
  FROM arrived)"""
ARRIVED_ESP = ARRIVED + """,
e0 AS (SELECT *, esp_sequence AS seq, row_number() OVER (PARTITION BY flow_key, a_to_b, esp_spi, esp_sequence
    ORDER BY turn, frame_number) AS nth,
    max(esp_sequence) OVER (PARTITION BY flow_key, a_to_b, esp_spi ORDER BY turn, frame_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM arrived WHERE esp_spi IS NOT NULL AND esp_sequence IS NOT NULL)"""


def drained(t, start):
    """Let the packets arrive in parts and run the stream dry after each; every run goes on from the checkpoint."""
    base = scratch_path(t.spark, "stream")
    last = t.packets.agg(F.max("frame_number")).first()[0]
    for part in ARRIVAL:
        low, high = last * part // len(ARRIVAL), last * (part + 1) // len(ARRIVAL)
        t.captured.where(F.col("frame_number").between(low + 1, high)).write.mode("append").parquet(
            f"{base}/arrived")
        running = start(rollup.packet_stream(t.spark, f"{base}/arrived", t.captured.schema), f"{base}/state")
        for one in running if isinstance(running, list) else [running]:
            one.awaitTermination()
    return f"{base}/state"


@query("t01_stream_flow_rollup", pk(FLOWS + """
SELECT flow_key, packet_count, byte_count, a_to_b_packets, b_to_a_packets, first_us, last_us FROM fl"""))
def stream_flow_rollup(t):
    folder = drained(t, lambda stream, state: rollup.start_rollup(stream, state, f"{state}-checkpoint"))
    return rollup.current_flows(t.spark, folder).select(
        "flow_key", "packet_count", "byte_count", "a_to_b_packets", "b_to_a_packets",
        *[F.unix_micros(F.col(f"{n}_seen").cast("timestamp")).alias(f"{n}_us")
          for n in ("first", "last")])


@query("t02_stream_gap_state", pk(ARRIVED_GAPS + """
SELECT flow_key, a_to_b, count(*) AS packets, count(*) FILTER (step >= 0) AS intervals,
  count(*) FILTER (step / 1e3 >= 300) AS pauses, max(step) FILTER (step >= 0) * 1000 / 1e6 AS max_gap_ms,
  count(*) FILTER (us IS NULL) AS missing_times, max_by(frame_number, (turn, frame_number)) AS last_frame,
  coalesce(CAST(sum(step) FILTER (step >= 0) AS BIGINT), 0) * 1000 AS total_ns
FROM g GROUP BY ALL"""))
def stream_gap_state(t):
    return keystate.current_gaps(t.spark, drained(t, keystate.start_gap_state)).select(
        "flow_key", "a_to_b", "packets", "intervals", "pauses", (F.col("max_ns") / F.lit(1e6)).alias("max_gap_ms"),
        "missing_times", "last_frame", "total_ns")


@query("t02_stream_sequence_state", pk(ARRIVED_ESP + """
SELECT flow_key, a_to_b, esp_spi, count(*) AS packets, count(*) FILTER (nth = 1) AS distinct_sequences,
  count(*) FILTER (nth = 1 AND seq < high) AS out_of_order,
  CAST(coalesce(sum(seq - high - 1) FILTER (nth = 1 AND seq > high + 1), 0) AS BIGINT) AS gap_missing,
  max(seq) AS highest_sequence
FROM e0 GROUP BY ALL"""))
def stream_sequence_state(t):
    return keystate.current_sequences(t.spark, drained(t, keystate.start_sequence_state))


@query("t03_stream_backward_counts", pk(ARRIVED_GAPS + """
SELECT flow_key, a_to_b, count(*) AS packets, count(*) FILTER (step < 0) AS backward
FROM g GROUP BY ALL"""))
def stream_backward_counts(t):
    return keystate.stream_backward_counts(t.spark, drained(t, keystate.start_gap_state))
