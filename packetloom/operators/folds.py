"""Exact sequential folds, one chunk of one key at a time.

Both folds are chains of successors. A window opener is followed by the first trigger behind its window, and a
16-bit counter that falls more than half its space below its maximum starts anew from that row. Successors
of all rows of a chunk are found at once, and which rows the chain meets follows from the state the chunk
is entered with; those states come from step maps that are composed over the chunks (`chains`). There is one path
for keys of any size, and no group holds more than a chunk of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.chains import FAN, LOW, StepMap, entry_states, labels, map_row, map_schema, step_map

SPACE = 1 << 16
HALF = 1 << 15
WINDOW_ROWS = 1000
CONTEXT_ROWS = 100


def chain_ends(following: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows the chain from each row meets, and the value of the last one, by pointer doubling.

    `following` is the next row of the chain, or the number of rows where it ends.
    """
    size = len(following)
    to = np.append(following, size)
    met = np.append(np.ones(size, np.int64), 0)
    last = np.append(np.arange(size), size)
    while (to < size).any():
        met = met + met[to]
        last = np.where(to < size, last[to], last)
        to = to[to]
    return met[:size], value[last[:size]]


def chain_rows(following: np.ndarray, first: int) -> np.ndarray:
    """The rows that the chain from a row meets."""
    steps, out = following.tolist(), []
    while first < len(steps):
        out.append(first)
        first = steps[first]
    return np.array(out, np.int64)


# Counters that jump ----------------------------------------------------------------------------------

def falls_after(x: np.ndarray) -> np.ndarray:
    """For a chain that starts anew at each row: the first later row more than half the space below the maximum since.

    Blocks of 2, 4, 8, ... rows know their extremes and their deepest fall inside; every row skips the largest
    blocks in which nothing happens, first growing and then shrinking.
    """
    size = len(x)
    levels = [(x, x, np.zeros(size, np.int64))]
    while len(levels[-1][0]) > 1:
        top, low, fall = levels[-1]
        if len(top) % 2:
            top, low, fall = np.append(top, LOW), np.append(low, -LOW), np.append(fall, 0)
            levels[-1] = top, low, fall
        a, b = slice(0, None, 2), slice(1, None, 2)
        levels.append((np.maximum(top[a], top[b]), np.minimum(low[a], low[b]), np.maximum(
            np.maximum(fall[a], fall[b]), np.where(low[b] < -LOW, top[a] - low[b], 0))))
    at, top = np.arange(1, size + 1), x.copy()
    for level, up in [(k, True) for k in range(len(levels))] + [(k, False) for k in reversed(range(len(levels)))]:
        high, low, fall = levels[level]
        block = at >> level
        fits = (at & ((1 << level) - 1) == 0) & (block < len(high)) & ((block & 1 == 1) | (not up))
        block = np.where(fits, block, 0)
        quiet = fits & (low[block] >= top - HALF) & (fall[block] <= HALF)
        top = np.where(quiet, np.maximum(top, high[block]), top)
        at = np.where(quiet, at + (1 << level), at)
    return np.minimum(at, size)


def unrolled(numbers: np.ndarray) -> np.ndarray:
    """Sums of the wrapped steps between neighbours, from 0."""
    return np.cumsum(np.append(0, (np.diff(numbers) + HALF) % SPACE - HALF))


def sequence_map(x: np.ndarray) -> StepMap:
    """The step map of a chunk over the maximum it is entered with, in the numbers of `x`; it counts falls."""
    following = falls_after(x)
    behind = np.maximum.accumulate(x[::-1])[::-1]
    met, leave = chain_ends(following, behind)
    start = int(following[0])  # the first fall if the chunk is entered with nothing above its first row
    lowest = np.minimum.accumulate(x)
    falls = np.flatnonzero(np.append(True, lowest[1:] < lowest[:-1]))
    falls = falls[(falls < start) & (x[falls] >= x[0] - SPACE)]
    # entered with more than x + HALF, the chain starts anew at the first row that low
    low = x[falls][::-1] + HALF + 1
    if start < len(x):
        first = leave[start], False, met[start]
    else:
        first = x.max(), True, 0
    return step_map(np.append(LOW, low), np.append(first[0], leave[falls][::-1]),
                    np.append(first[1], np.zeros(len(falls), bool)), np.append(first[2], met[falls][::-1]))


def sequence_falls(x: np.ndarray, entry: int) -> np.ndarray:
    """The rows of a chunk at which the counter starts anew."""
    following = falls_after(x)
    below = np.flatnonzero(x < entry - HALF)
    return chain_rows(following, min(int(following[0]), int(below[0]) if len(below) else len(x)))


def counter_falls(rows: DataFrame, keys: list[str], seq: str, order: str, fan: int = FAN
                  ) -> tuple[DataFrame, DataFrame]:
    """Where counters start anew (keys, _chunk, order), and what each chunk is entered with (keys, _chunk, _entry: the
    maximum since the last fall, _count: the falls before it).

    `rows` hold a number and, in `_start`, the unrolled value of the chunk's first row.
    """
    step = [*keys, "_chunk"]

    def numbers(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by(order)
        return table, unrolled(table[seq].to_numpy()) + table["_start"][0].as_py()

    def summarise(table: pa.Table) -> pa.Table:
        table, x = numbers(table)
        return pa.table(labels(table, step) | map_row(sequence_map(x)))

    def replay(table: pa.Table) -> pa.Table:
        table, x = numbers(table)
        at = sequence_falls(x, table["_entry"][0].as_py())
        return pa.table(labels(table, step, len(at)) | {order: table[order].take(pa.array(at))})

    entries = entry_states(rows.groupBy(*step).applyInArrow(summarise, map_schema(rows, step)), keys, LOW, fan)
    found = rows.join(entries, step).groupBy(*step).applyInArrow(
        replay, T.StructType([rows.schema[n] for n in [*step, order]]))
    return found, entries


# Evidence windows ------------------------------------------------------------------------------------

def _reach(position: np.ndarray) -> np.ndarray:
    """First position behind the window that a trigger opens."""
    return np.maximum(position - CONTEXT_ROWS, 0) + WINDOW_ROWS


def window_map(at: np.ndarray) -> StepMap:
    """The step map of a chunk of trigger positions over the end of the window it is entered with."""
    count, leave = chain_ends(np.searchsorted(at, _reach(at)), _reach(at))
    return step_map(np.append(LOW, at + 1), np.append(leave, LOW), np.append(np.zeros(len(at), bool), True),
                    np.append(count, 0))


def new_groups(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; a null equals a null."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for name in names:
        codes = batch[name].dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _opened(batch: pa.RecordBatch, new: np.ndarray, position: str, end: int) -> tuple[np.ndarray, int]:
    """Rows of a sorted batch that open a window, and where the last window of its last group ends.

    A row without a position carries the entry of its group; a group that goes on from the batch before, up to the first
    new row, is entered with `end`. All groups take a step at once, so there are as many steps as windows in one group.
    """
    group = np.cumsum(new) - new[0]
    held = batch[position].is_valid().to_numpy(zero_copy_only=False)
    ends = np.zeros(int(group[-1]) + 1, np.int64)
    ends[0] = end
    ends[group[~held]] = batch["_entry"].fill_null(0).to_numpy()[~held]
    rows = np.flatnonzero(held)
    at, group = batch[position].fill_null(0).to_numpy()[rows], group[rows]
    span = max(int(at.max(initial=0)), int(ends.max())) + WINDOW_ROWS + 1
    place = group * span + at
    opened, within = [], np.arange(len(ends))
    while len(within):
        found = np.searchsorted(place, within * span + ends[within])
        there = found < len(place)
        found, within = found[there], within[there]
        there = group[found] == within
        found, within = found[there], within[there]
        ends[within] = _reach(at[found])
        opened.append(found)
    return rows[np.sort(np.concatenate(opened))], int(ends[-1])


def window_openers(df: DataFrame, keys: list[str], position: str, fan: int = FAN) -> DataFrame:
    """Triggers that open an evidence window: (keys, position)."""
    from packetloom.operators.ordered import chunk_of

    step = [*keys, "_chunk"]
    rows = df.select(*keys, F.col(position).cast("bigint").alias(position)).withColumn("_chunk", chunk_of(position))

    def summarise(table: pa.Table) -> pa.Table:
        found = window_map(np.unique(table[position].to_numpy()))
        near = found.low <= found.low[1] + WINDOW_ROWS  # an open window reaches no further into the chunk
        near[-1] = True
        return pa.table(labels(table, step) | map_row(StepMap(*[x[near] for x in found])))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0  # the key and chunk of the row before, and where its last window ends
        for batch in batches:
            if batch.num_rows:
                new = new_groups(batch, step)
                first = [batch[n][0].as_py() for n in step]
                new[0] = first != last
                opened, end = _opened(batch, new, position, 0 if new[0] else end)
                last = [batch[n][batch.num_rows - 1].as_py() for n in step]
                yield batch.select([*keys, position]).take(pa.array(opened))

    # only keys with several chunks have anything to pass on
    chunks = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    spread = rows.select(*step).distinct().withColumn("_chunks", chunks).where("_chunks > 1").drop("_chunks")
    maps = rows.join(spread, step, "left_semi").groupBy(*step).applyInArrow(summarise, map_schema(rows, step))
    entries = entry_states(maps, keys, 0, fan).drop("_count")
    # small keys are many: a task runs through its sorted rows, many keys to a batch, the entry ahead of its chunk
    both = rows.unionByName(entries, allowMissingColumns=True).repartition(*step).sortWithinPartitions(
        *step, F.col(position).asc_nulls_first())
    return both.select(*step, position, "_entry").mapInArrow(
        replay, T.StructType([rows.schema[n] for n in [*keys, position]]))
