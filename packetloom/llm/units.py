"""Units: packed groups of texts that ask the rest of the corpus about hashes.

A *unit* holds about a megabyte of texts, compressed, under an id that is fixed once the units are written
to the shared folder. A unit sends the hashes it wants to know about to *buckets* (ranges of the hash), each
hash once however many of its texts hold it, and gets one packed answer from every bucket. So a hash that a
third of all texts share costs one entry per unit, and nothing else than hashes and answers is shuffled.
The number of buckets follows `spark.sql.shuffle.partitions`, which grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.texts import as_bytes, spaced, text_slices
from packetloom.settings import settle

NO_ID = np.iinfo(np.int64).max
UNIT_FIELDS = "unit long, ids binary, lengths binary, packed binary"
ENTRY_FIELDS = "unit long, bucket int, n int, payload binary"
ANSWER_FIELDS = "unit long, bucket int, answer binary"


def make_units(docs: DataFrame, unit_bytes: int = 1 << 20) -> DataFrame:
    """Documents (doc_id, text) packed into units and written to the shared folder.

    A null text is empty; a null doc_id counts as larger than every other. A text longer than
    `unit_bytes` is a unit of its own.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            column = batch.column(1)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in text_slices(column, unit_bytes):
                values = as_bytes(column.slice(first, last - first))
                offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
                data = memoryview(values.buffers()[2] or b"")[offsets[0]:offsets[-1]]
                yield pa.RecordBatch.from_pydict({
                    "unit": [number], "ids": [ids[first:last].tobytes()],
                    "lengths": [np.diff(offsets).tobytes()], "packed": [squeeze.compress(data)]})
                number += 1

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(picked.mapInArrow(pack, UNIT_FIELDS), "units")


class Unit:
    """A unit opened: document ids, the flat buffer and where each text starts in it."""

    def __init__(self, row: dict):
        self.number = row["unit"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], np.int64))])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(
            row["packed"], max_output_size=max(1, int(offsets[-1]))), np.uint8)
        self.buffer, self.starts = spaced(data, offsets)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The units of a table one by one, each with the lists of answers that follow it in the table."""
    for batch in batches:
        for row in range(batch.num_rows):
            cells = {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}
            yield Unit(cells), *[v for n, v in cells.items() if n.startswith("answers")]


def bucket_count(df: DataFrame, per_partition: int = 4) -> int:
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted hashes; buckets are equal ranges of the hash."""
    low = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(sorted_hashes, low), len(sorted_hashes))


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, highest first; what they share is then squeezed by the shuffle's codec."""
    swapped = np.ascontiguousarray(values).astype(values.dtype.newbyteorder(">"))
    return swapped.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, count: int, dtype: type = np.uint64) -> np.ndarray:
    kind = np.dtype(dtype)
    stacked = np.frombuffer(data, np.uint8, count * kind.itemsize).reshape(kind.itemsize, count)
    return np.ascontiguousarray(stacked.T).view(kind.newbyteorder(">")).reshape(count).astype(kind)


def entries(number: int, hashes: np.ndarray, buckets: int, pack: Callable[[int, int], bytes]
            ) -> Iterator[tuple[int, int, int, bytes]]:
    """One entry per bucket that gets any of the sorted hashes; `pack` writes a range of them."""
    edges = bucket_edges(hashes, buckets)
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        first, last = int(edges[bucket]), int(edges[bucket + 1])
        yield number, bucket, last - first, pack(first, last)


def ask(units: DataFrame, send: Callable[..., Iterator[tuple[int, int, int, bytes]]],
        reply: Callable[[list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """Answers to what units ask: (unit, answers), one (bucket, bytes) per bucket with something to say.

    `send` yields the entries of a unit, and gets the answers the unit already has; `reply` gets the sizes
    and payloads of all entries of a bucket and returns the answer to each, empty for nothing to say.
    The answers are small, and written to the shared folder, as several later steps read them.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, *answers in opened(batches):
            rows = list(send(unit, *answers))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    ["unit", "bucket", "n", "payload"])

    def solve(table: pa.Table) -> pa.Table:
        found = reply(table["n"].to_pylist(), table["payload"].to_pylist())
        told = pa.table({"unit": table["unit"], "bucket": table["bucket"],
                         "answer": pa.array(found, pa.binary())})
        return told.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return settle(units.mapInArrow(emit, ENTRY_FIELDS)
                  .groupBy("bucket").applyInArrow(solve, ANSWER_FIELDS)
                  .groupBy("unit").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers")),
                  "answers")


def attach(units: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Units with their answers in a column of this name; null where there are none.

    Answers grow with the units, so the join is the same sort-merge join at every size.
    """
    return units.join(answers.withColumnRenamed("answers", name).hint("merge"), "unit", "left")


def answered(answers: list | None, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Which range of the sorted hashes each answer is about."""
    if answers:
        edges = bucket_edges(hashes, buckets)
        for told in answers:
            yield int(edges[told["bucket"]]), int(edges[told["bucket"] + 1]), told["answer"]


def marked(answers: list | None, hashes: np.ndarray, buckets: int, part: int = 0) -> np.ndarray:
    """One truth value per sorted hash from answers that are packed bits; `part` counts sets of bits."""
    out = np.zeros(len(hashes), bool)
    for first, last, data in answered(answers, hashes, buckets):
        skip = part * -(-(last - first) // 8)
        out[first:last] = np.unpackbits(np.frombuffer(data, np.uint8)[skip:], count=last - first)
    return out


def packed_bits(flags: np.ndarray) -> bytes:
    """Truth values as bits, or nothing at all if none is set."""
    return np.packbits(flags).tobytes() if flags.any() else b""


# Which hashes of a unit some other unit has too -----------------------------------------------------

def send_shared(number: int, hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Ask about sorted, distinct hashes; their upper 48 bits are sent (more units may seem to share one)."""
    upper = hashes >> np.uint64(16)

    def pack(first: int, last: int) -> bytes:
        return planes(upper[first:last])[2 * (last - first):]
    return entries(number, hashes, buckets, pack)


def reply_shared(sizes: list[int], payloads: list[bytes], hot_units: int = 0) -> list[bytes]:
    """Which hashes came from two units or more; after those bits, if `hot_units` is given, which came from
    more units than that."""
    parts = [unplanes(bytes(2 * n) + data, n) for n, data in zip(sizes, payloads)]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    held = np.empty(len(every), np.int64)
    held[order] = np.repeat(np.diff(np.append(edges, len(ranked))), np.diff(np.append(edges, len(ranked))))
    ends = np.cumsum(sizes)
    out = []
    for n, end in zip(sizes, ends.tolist()):
        own = held[end - n:end]
        bits = packed_bits(own > 1)
        out.append(bits + np.packbits(own > hot_units).tobytes() if bits and hot_units else bits)
    return out


def smaller_id_entry(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> bytes:
    """Distinct 96-bit hashes with the least id of the unit for each, as `reply_smaller_id` reads them."""
    return planes(first) + planes(second) + planes(ids)


def reply_smaller_id(sizes: list[int], payloads: list[bytes]) -> list[bytes]:
    """For every hash of a unit: does another unit hold it under a smaller id?"""
    first = np.concatenate([unplanes(p, n) for n, p in zip(sizes, payloads)])
    second = np.concatenate([unplanes(p[8 * n:], n, np.uint32) for n, p in zip(sizes, payloads)])
    ids = np.concatenate([unplanes(p[12 * n:], n, np.int64) for n, p in zip(sizes, payloads)])
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    flags = np.empty(len(order), bool)
    flags[order] = least < ids[order]
    ends = np.cumsum(sizes)
    return [packed_bits(flags[end - n:end]) for n, end in zip(sizes, ends)]


def own_shared(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a unit, and which of them two of its documents hold."""
    order = np.argsort(keys, kind="stable")
    ranked, docs = keys[order], owner[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
    if not len(first):
        return ranked, np.empty(0, bool)
    return ranked[first], np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
