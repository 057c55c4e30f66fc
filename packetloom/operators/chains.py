"""Entry states of chunks whose rows depend on their own results, by composing step maps in a tree.

A chunk of a key maps the state it is entered with to the state it is left with, and counts something on the
way. The map is a list of pieces: for entries from `low` to `high` either a fixed `leave`, or (`keeps`) the
entry itself unless it lies under `leave`. Such maps can be composed, and composition is associative. So maps of
neighbouring chunks are composed block by block, `fan` at a time, the blocks of a key are run through once,
and entries are pushed down again. The group of a key holds a map for every `fan` chunks, no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FAN = 1024
LOW, HIGH = -(1 << 61), 1 << 61
_LONGS = T.ArrayType(T.LongType())


class StepMap(NamedTuple):
    """Pieces in order of `low`, which together cover every state."""

    low: np.ndarray
    high: np.ndarray
    leave: np.ndarray
    keeps: np.ndarray
    count: np.ndarray

    def follow(self, state: int) -> tuple[int, int]:
        """The state behind the chunk, and the count inside it."""
        at = int(np.searchsorted(self.low, state, side="right")) - 1
        leave = int(self.leave[at])
        return max(state, leave) if self.keeps[at] else leave, int(self.count[at])

    def then(self, after: StepMap) -> StepMap:
        """This map followed by another."""
        parts = [self._part(k, after) for k in range(len(self.low))]
        return StepMap(*[np.concatenate(x) for x in zip(*parts)]).merged()

    def _part(self, k: int, after: StepMap) -> StepMap:
        low, high, leave, count = (int(x[k]) for x in (self.low, self.high, self.leave, self.count))
        if not self.keeps[k]:
            state, more = after.follow(leave)
            return _pieces([(low, high, state, False, count + more)])
        out = []
        if low < leave:  # entries that are lifted to `leave`
            state, more = after.follow(leave)
            out.append((low, min(leave - 1, high), state, False, count + more))
            low = leave
        if low <= high:
            first = int(np.searchsorted(after.low, low, side="right")) - 1
            last = int(np.searchsorted(after.low, high, side="right"))
            out += [(max(low, int(after.low[j])), min(high, int(after.high[j])), int(after.leave[j]),
                     bool(after.keeps[j]), count + int(after.count[j])) for j in range(first, last)]
        return _pieces(out)

    def merged(self) -> StepMap:
        """Neighbouring pieces that do the same as one."""
        new = np.append(True, (self.leave[1:] != self.leave[:-1]) | (self.keeps[1:] != self.keeps[:-1])
                        | (self.count[1:] != self.count[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(self.low)) - 1
        return StepMap(self.low[first], self.high[last], self.leave[first], self.keeps[first], self.count[first])


def _pieces(rows: list[tuple]) -> StepMap:
    low, high, leave, keeps, count = zip(*rows)
    return StepMap(*[np.array(x, np.int64) for x in (low, high, leave)], np.array(keeps, bool), np.array(count, np.int64))


def step_map(low: np.ndarray, leave: np.ndarray, keeps: np.ndarray, count: np.ndarray) -> StepMap:
    """A map from pieces that start at `low`, each reaching to the next."""
    return StepMap(low, np.append(low[1:] - 1, HIGH), leave, keeps, count).merged()


def map_schema(df: DataFrame, names: list[str]) -> T.StructType:
    """Rows that carry a map in five arrays."""
    return T.StructType([df.schema[n] for n in names] + [
        T.StructField(n, _LONGS) for n in StepMap._fields])


def map_row(found: StepMap) -> dict:
    return {name: [values.astype(np.int64)] for name, values in found._asdict().items()}


def _map_of(table: pa.Table, row: int) -> StepMap:
    arrays = [table[name][row].values.to_numpy() for name in StepMap._fields]
    return StepMap(*arrays[:3], arrays[3] > 0, arrays[4])


def labels(table: pa.Table, names: list[str], count: int = 1) -> dict:
    """The key values of a group, repeated."""
    return {n: pa.array([table[n][0].as_py()] * count, table.schema.field(n).type) for n in names}


def entry_states(maps: DataFrame, keys: list[str], first_state: int, fan: int = FAN) -> DataFrame:
    """(keys, _chunk, _entry, _count): the state each chunk is entered with, and the counts before it.

    `maps` has a step map for every chunk of its keys (keys, _chunk and the arrays of `map_schema`).
    """
    from pyspark.sql import functions as F

    blocks = maps.withColumn("_block", F.floor(F.col("_chunk") / fan).cast("bigint"))
    in_block = [*keys, "_block"]
    kept = blocks.select(*in_block, "_chunk", *StepMap._fields)

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        whole = _map_of(table, 0)
        for row in range(1, table.num_rows):
            whole = whole.then(_map_of(table, row))
        return pa.table(labels(table, in_block) | map_row(whole))

    def through(order: str, out: list[str]):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(order)
            start = "_entry" in table.schema.names
            state = table["_entry"][0].as_py() if start else first_state
            count = table["_count"][0].as_py() if start else 0
            entries, counts = [], []
            for row in range(table.num_rows):
                entries.append(state)
                counts.append(count)
                state, more = _map_of(table, row).follow(state)
                count += more
            same = {n: table[n] for n in out}
            return pa.table(same | {"_entry": pa.array(entries, pa.int64()), "_count": pa.array(counts, pa.int64())})
        return run

    def schema(names: list[str]) -> T.StructType:
        return T.StructType([kept.schema[n] for n in names] + [
            T.StructField("_entry", T.LongType()), T.StructField("_count", T.LongType())])

    composed = kept.groupBy(*in_block).applyInArrow(compose, map_schema(kept, in_block))
    tops = composed.groupBy(*keys).applyInArrow(through("_block", in_block), schema(in_block))
    pushed = [*keys, "_chunk"]
    return kept.join(tops, in_block).groupBy(*in_block).applyInArrow(through("_chunk", pushed), schema(pushed))
