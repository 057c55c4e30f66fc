"""Running gap and sequence results per key over a stream of packets, in Spark's own keyed state.

A batch is cut into segments: the rows of one key in one chunk of capture order, so a key with a third of the
packets is summarised by many tasks, and no task holds more than a chunk. A task summarises the segments of many keys
of a chunk at once, as columns. Segments are small and can be joined end to end; a stateful operator keeps one value
per key and appends the segments of each batch to it, in order of arrival: by batch, then by frame. Packets that
arrive with an earlier time are counted, never dropped.

The values of many keys are one map state, dealt over groups by a hash of the key: a group is handed to Python once
for all its keys, and a key costs one read and one write of its own entry. Which sequence numbers a stream has had is
a second stateful operator: maps of bitmaps, salted by ranges of numbers, which may expire. Only the keys of a batch
are read and written; state lives in the checkpoint, is restored from there after a restart, and is read with Spark's
state reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from packetloom.functions.parse import filled, packet_time_ns
from packetloom.operators.ordered import DEFAULT_PAUSE_MS, chunk_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
WAY = ["flow_key", "a_to_b"]
SOURCE = ["flow_key", "a_to_b", "esp_spi"]
WAY_KEY = "flow_key string, a_to_b boolean"
SOURCE_KEY = f"{WAY_KEY}, esp_spi string"

GAP_SUMS = ["packets", "intervals", "pauses", "backward", "missing_times", "total_ns"]
#: A time is a number and whether there is one; `max_ns` is -1 without intervals.
GAP_VALUE = ("last_frame bigint, last_ns bigint, last_timed boolean, packets bigint, intervals bigint, "
             "pauses bigint, backward bigint, missing_times bigint, total_ns bigint, max_ns bigint")
GAP_SEGMENT = f"{WAY_KEY}, chunk bigint, first_ns bigint, first_timed boolean, {GAP_VALUE}"
ORDER_VALUE = "first_sequence bigint, highest_sequence bigint, records bigint"
RUN = f"{SOURCE_KEY}, chunk bigint, run bigint, low bigint, high bigint"
COPIES = f"{SOURCE_KEY}, part bigint, number bigint, copies bigint"
SEEN_VALUE = "packets bigint, distinct_sequences bigint"
#: Numbers in the bitmap of a block, and blocks in the range of numbers that salts a group.
BLOCK, BLOCKS = 1 << 12, 1 << 6
#: Groups that the keys of a chunk are summarised in, and groups that the state of all keys is dealt over.
SEGMENT_GROUPS, STATE_GROUPS = 64, 512


# Gaps ------------------------------------------------------------------------------------------------

def gap_sums(ns: np.ndarray, timed: np.ndarray, starts: np.ndarray, threshold_ms: float) -> dict[str, np.ndarray]:
    """What the rows of each segment, in order, add up to; a row without time breaks the chain on both sides."""
    step, linked = np.diff(ns, prepend=ns[:1]), timed & np.append(False, timed[:-1])
    linked[starts] = False
    ahead = linked & (step >= 0)
    add = lambda values: np.add.reduceat(values, starts, dtype=np.int64)
    return {"packets": np.diff(np.append(starts, len(ns))), "intervals": add(ahead),
            "pauses": add(ahead & (step / 1e6 >= threshold_ms)), "backward": add(linked & (step < 0)),
            "missing_times": add(~timed), "total_ns": add(np.where(ahead, step, 0)),
            "max_ns": np.maximum.reduceat(np.where(ahead, step, -1), starts)}


def gap_segment(ns: np.ndarray, timed: np.ndarray, threshold_ms: float) -> dict:
    """The sums of a single segment."""
    return {name: int(values[0]) for name, values in gap_sums(ns, timed, np.zeros(1, np.int64), threshold_ms).items()}


def append_segment(state: dict | None, segment: dict, threshold_ms: float) -> dict:
    """The state of a key after one more segment."""
    if state is None:
        return dict(segment)
    out = {name: state[name] + segment[name] for name in GAP_SUMS}
    out["max_ns"] = max(state["max_ns"], segment["max_ns"])
    if state["last_timed"] and segment["first_timed"]:
        step = segment["first_ns"] - state["last_ns"]
        if step < 0:
            out["backward"] += 1
        else:
            out["intervals"] += 1
            out["pauses"] += step / 1e6 >= threshold_ms
            out["total_ns"] += step
            out["max_ns"] = max(out["max_ns"], step)
    return out | {name: segment[name] for name in ("last_frame", "last_ns", "last_timed")}


def gap_segments(packets: DataFrame, threshold_ms: float) -> DataFrame:
    """One row per direction and chunk of capture order of a batch."""
    def summarise(table: pa.Table) -> pa.Table:
        table, _, starts = _by_key(table, WAY)
        last = np.append(starts[1:], table.num_rows) - 1
        ns, timed = table["ns"].to_numpy(), table["timed"].to_numpy()
        at = lambda names, places: {name: table[name].take(places) for name in names}
        out = at((*WAY, "chunk"), starts) | {"first_ns": ns[starts], "first_timed": timed[starts]}
        out |= {"last_frame": table["frame_number"].take(last), "last_ns": ns[last], "last_timed": timed[last]}
        out |= gap_sums(ns, timed, starts, threshold_ms)
        return pa.table({name: out[name] for name in _names(GAP_SEGMENT)})

    time = packet_time_ns()
    rows = packets.select(*WAY, chunk_of("frame_number").alias("chunk"), "frame_number",
                          F.coalesce(time, F.lit(0).cast("bigint")).alias("ns"), time.isNotNull().alias("timed"))
    return rows.groupBy("chunk", _group(WAY, SEGMENT_GROUPS).alias("dealt")).applyInArrow(summarise, GAP_SEGMENT)


class GapState(StatefulProcessor):
    """One value per direction: its gaps so far, and the packet the next one is measured against."""

    def __init__(self, threshold_ms: float):
        self.threshold_ms = threshold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getMapState("gaps", WAY_KEY, GAP_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = _names(GAP_VALUE)
        segments = pd.concat(list(rows)).sort_values("chunk", kind="stable").to_dict("records")
        ways: dict[tuple, dict | None] = {}
        for segment in segments:
            way = tuple(segment[name] for name in WAY)
            if way not in ways:
                held = self.value.getValue(way)
                ways[way] = None if held is None else dict(zip(names, held))
            ways[way] = append_segment(ways[way], segment, self.threshold_ms)
        for way, state in ways.items():
            self.value.updateValue(way, tuple(bool(state[n]) if n == "last_timed" else int(state[n]) for n in names))
        yield _touched(WAY, list(ways))

    def close(self) -> None:
        pass


# Sequence numbers ------------------------------------------------------------------------------------

def record_places(numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and last row of each run of consecutive numbers among those that exceed all before them.

    `keys` tells the streams apart, which stand one behind the other, by rising number of the stream.
    """
    places = np.unique(numbers, return_inverse=True)[1].astype(np.int64) + keys.astype(np.int64) * len(numbers)
    highest = np.maximum.accumulate(places)
    records = np.flatnonzero(np.append(True, highest[1:] > highest[:-1]))
    cut = np.flatnonzero((np.diff(numbers[records]) > 1) | (np.diff(keys[records]) != 0)) + 1
    return records[np.append(0, cut)], records[np.append(cut, len(records)) - 1]


def record_runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of each run of a single stream."""
    first, last = record_places(numbers, np.zeros(len(numbers), np.int64))
    return numbers[first], numbers[last]


def append_runs(state: tuple[int, int, int] | None, low: int, high: int) -> tuple[int, int, int]:
    """First number, highest number and count of records after one more run."""
    if state is None:
        return low, high, high - low + 1
    first, highest, records = state
    return first, max(highest, high), records + max(0, high - max(low - 1, highest))


def sequence_rows(packets: DataFrame) -> DataFrame:
    return packets.where(filled(F.col("esp_spi")) & F.col("esp_sequence").isNotNull()).select(
        *SOURCE, F.col("esp_sequence").alias("number"), "frame_number")


def sequence_runs(packets: DataFrame) -> DataFrame:
    """The runs of each stream and chunk of a batch, numbered."""
    def summarise(table: pa.Table) -> pa.Table:
        table, keys, _ = _by_key(table, SOURCE)
        numbers = table["number"].to_numpy()
        first, last = record_places(numbers, keys)
        out = {name: table[name].take(first) for name in (*SOURCE, "chunk")}
        return pa.table(out | {"run": np.arange(len(first)), "low": numbers[first], "high": numbers[last]})

    rows = sequence_rows(packets).withColumn("chunk", chunk_of("frame_number"))
    return rows.groupBy("chunk", _group(SOURCE, SEGMENT_GROUPS).alias("dealt")).applyInArrow(summarise, RUN)


class OrderState(StatefulProcessor):
    """One value per stream: its first and highest number, and how many numbers were the highest so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getMapState("order", SOURCE_KEY, ORDER_VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        runs = pd.concat(list(rows)).sort_values(["chunk", "run"])
        streams: dict[tuple, tuple | None] = {}
        for *source, low, high in zip(*[runs[name].tolist() for name in (*SOURCE, "low", "high")]):
            source = tuple(source)
            if source not in streams:
                held = self.value.getValue(source)
                streams[source] = None if held is None else tuple(held)
            streams[source] = append_runs(streams[source], low, high)
        for source, state in streams.items():
            self.value.updateValue(source, state)
        yield _touched(SOURCE, list(streams))

    def close(self) -> None:
        pass


def number_copies(packets: DataFrame) -> DataFrame:
    """Numbers with their copies, added up inside each task first: (stream, range of numbers, number, copies)."""
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(COPIES)
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(names[:-1]).aggregate([("copies", "sum")])
            yield from found.rename_columns({"copies_sum": "copies"}).select(names).combine_chunks().to_batches()

    part = F.floor(F.col("number") / F.lit(BLOCK * BLOCKS)).cast("bigint")
    return sequence_rows(packets).select(
        *SOURCE, part.alias("part"), "number", F.lit(1).cast("bigint").alias("copies")).mapInArrow(combine, COPIES)


class SeenState(StatefulProcessor):
    """Which numbers a stream has had: a bitmap for each block of them, and counts for each range."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("seen_counts", f"{SOURCE_KEY}, part bigint", SEEN_VALUE)
        self.bits = handle.getMapState("seen_bits", f"{SOURCE_KEY}, block bigint", "bits binary", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        rows = pd.concat(list(rows))
        rows["block"] = rows["number"] // BLOCK
        added: dict[tuple, list[int]] = {}
        for (*source, part, block), own in rows.groupby([*SOURCE, "part", "block"]):
            place = (*source, int(block))
            held = self.bits.getValue(place)
            seen = np.zeros(BLOCK, np.uint8) if held is None else np.unpackbits(np.frombuffer(held[0], np.uint8))
            before = int(seen.sum())
            seen[own["number"].to_numpy(np.int64) % BLOCK] = 1
            self.bits.updateValue(place, (np.packbits(seen).tobytes(),))
            counts = added.setdefault((*source, int(part)), [0, 0])
            counts[0] += int(own["copies"].sum())
            counts[1] += int(seen.sum()) - before
        for place, (packets, distinct) in added.items():
            held = self.counts.getValue(place) or (0, 0)
            self.counts.updateValue(place, (held[0] + packets, held[1] + distinct))
        yield _touched(SOURCE, list(dict.fromkeys(place[:-1] for place in added)))

    def close(self) -> None:
        pass


# Streams ---------------------------------------------------------------------------------------------

def _names(schema: str) -> list[str]:
    return [column.split(" ")[0] for column in schema.split(", ")]


def _touched(names: list[str], keys: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(keys, columns=names)


def _group(keys: list[str], groups: int) -> Column:
    """The group that a key is dealt into."""
    return F.pmod(F.xxhash64(*keys), F.lit(groups))


def _by_key(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows by key and frame, the rising number of each row's key, and where each key starts."""
    table = table.sort_by([(name, "ascending") for name in (*keys, "frame_number")]).combine_chunks()
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in keys:
        codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return table, np.cumsum(new), np.flatnonzero(new)


def _start(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, checkpoint: str,
           time_mode: str = "none") -> StreamingQuery:
    conf = rows.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # a query with a clock would run batches without data for ever, and so never end
    empty_batches = conf.get(EMPTY_BATCHES, "true")
    conf.set(EMPTY_BATCHES, "false")
    try:
        dealt = rows.withColumn("dealt", _group(keys, STATE_GROUPS))
        kept = dealt.groupBy("dealt").transformWithStateInPandas(processor, out, "update", time_mode)
        return (kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        conf.set(EMPTY_BATCHES, empty_batches)


def start_gap_state(stream: DataFrame, folder: str, threshold_ms: float = DEFAULT_PAUSE_MS) -> StreamingQuery:
    """Keep the gaps of every direction up to date; the state is in the checkpoint below `folder`."""
    return _start(gap_segments(stream, threshold_ms), WAY, GapState(threshold_ms), WAY_KEY, f"{folder}/gaps")


def start_sequence_state(stream: DataFrame, folder: str, keep_ms: int | None = None) -> list[StreamingQuery]:
    """Keep the sequence counts of every ESP stream up to date.

    `keep_ms` bounds how long a block of numbers is remembered after it was last touched; without it every copy is
    recognised however late it comes.
    """
    return [
        _start(sequence_runs(stream), SOURCE, OrderState(), SOURCE_KEY, f"{folder}/order"),
        _start(number_copies(stream), [*SOURCE, "part"], SeenState(keep_ms), SOURCE_KEY, f"{folder}/seen",
               "none" if keep_ms is None else "processingTime")]


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select(
        "user_map_key.*", "user_map_value.*")


def current_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The gaps of every direction after the last batch."""
    return _state(spark, f"{folder}/gaps", "gaps").select(
        *WAY, "last_frame", F.when(F.col("last_timed"), F.col("last_ns")).alias("last_ns"), *GAP_SUMS,
        F.when(F.col("max_ns") >= 0, F.col("max_ns")).alias("max_ns"))


def current_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The sequence counts of every ESP stream after the last batch.

    A number that exceeds all before it is new, so what is new and not such a record came out of order, and the
    gaps are the numbers between the first and the highest that are no records.
    """
    seen = _state(spark, f"{folder}/seen", "seen_counts").groupBy(*SOURCE).agg(
        F.sum("packets").alias("packets"), F.sum("distinct_sequences").alias("distinct_sequences"))
    return _state(spark, f"{folder}/order", "order").join(seen, SOURCE).select(
        *SOURCE, "packets", "distinct_sequences", (F.col("distinct_sequences") - F.col("records")).alias("out_of_order"),
        (F.col("highest_sequence") - F.col("first_sequence") + 1 - F.col("records")).alias("gap_missing"), "highest_sequence")


def stream_backward_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Packets per direction that arrived behind the time of the packet before them."""
    return current_gaps(spark, folder).select(*WAY, "packets", "backward")
