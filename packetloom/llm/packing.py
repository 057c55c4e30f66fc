"""Packed token ids: best-fit-decreasing into rows of a fixed length, with binary columns.

Documents are dealt into groups by a hash of their content and their place in the stored table, so that copies
spread too; the number of groups follows the number of documents. Inside a
group, a document longer than a row is split into full rows and a rest; the pieces are packed in decreasing
length, each into the open row with the least room that still fits. A segment tree over the amounts of room
finds that row in logarithmic time. Nothing is lost: every piece says which document it is from and where it
starts there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.bpe import in_worker
from packetloom.llm.texts import text_slices
from packetloom.settings import settle

ROW_TOKENS = 2048
DOCS_PER_GROUP = 2048
PACKED = ("packing_group long, row long, n_tokens long, ids binary, positions binary, "
          "cumulative array<int>, doc_ids array<long>, starts array<long>")


class Room:
    """Open rows by the room they have left, in a segment tree that counts rows per amount of room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Take out a row with the least room that is `need` or more: (row, room), or None."""
        node = need + self.size
        if not self.count[node]:
            # Up until a right sibling has rows, then down to its first one.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; pieces of equal length keep their order. Pieces without tokens go last."""
    room, rows = Room(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[piece])
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, left = found
        rows[row].append(piece)
        room.add(row, left - lengths[piece])
    return rows


def split(lengths: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """Pieces (document, start, length): full rows and a rest; a document without tokens is one piece."""
    return [(doc, start, min(capacity, n - start)) for doc, n in enumerate(lengths)
            for start in range(0, max(n, 1), capacity)]


def _pack(table: pa.Table, capacity: int, pad: int, id_bytes: int) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
    kind = np.dtype(f"<u{id_bytes}")
    place = np.dtype(np.uint16 if capacity <= 1 << 16 else np.uint32)
    ids = table["doc_id"].to_pylist()
    tokens = [np.frombuffer(t, kind) for t in table["tokens"].to_pylist()]
    pieces = split([len(t) for t in tokens], capacity)
    out = {name.split(" ")[0]: [] for name in PACKED.split(", ")}
    group = table["packing_group"][0].as_py() if table.num_rows else 0
    for number, row in enumerate(best_fit_decreasing([n for _, _, n in pieces], capacity)):
        matrix, positions, ends = np.full(capacity, pad, kind), np.zeros(capacity, place), [0]
        for k in row:
            doc, start, n = pieces[k]
            matrix[ends[-1]:ends[-1] + n] = tokens[doc][start:start + n]
            positions[ends[-1]:ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        for name, value in (("packing_group", group), ("row", number), ("n_tokens", ends[-1]),
                            ("ids", matrix.tobytes()), ("positions", positions.tobytes()), ("cumulative", ends),
                            ("doc_ids", [ids[pieces[k][0]] for k in row]), ("starts", [pieces[k][1] for k in row])):
            out[name].append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({name: pa.array(values, t) for (name, values), t in zip(out.items(), kinds)})


def tokenized(docs: DataFrame, tokenizer: Broadcast) -> DataFrame:
    """(doc_id, tokens) of documents (doc_id, text): ids end to end, little-endian, 16 bits each if the vocabulary
    fits into them, else 32; a null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = in_worker(tokenizer.value)
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                packed = [bpe.packed(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, tokens binary")


def pack(tokens: DataFrame, capacity: int = ROW_TOKENS, pad: int = 50256,
         docs_per_group: int = DOCS_PER_GROUP, id_bytes: int = 4) -> DataFrame:
    """Rows of exactly `capacity` ids from (doc_id, tokens), tokens being little-endian ids of `id_bytes` bytes.

    Per row: `ids` (`id_bytes` each, `pad` behind the last piece), `positions` (restarting from 0 with every
    piece, 16 bits), `cumulative` segment lengths from 0, and for every segment its `doc_ids` and `starts`
    (where it starts in its document). A document without tokens is a segment of length 0; a null doc_id is
    kept; equal rows are packed as often as they occur; an empty table gives no rows.
    """
    # A place is the same each time only in a table that is stored.
    stored = tokens if hasattr(tokens, "_settled_in") else settle(tokens.select("doc_id", "tokens"), "tokens")
    groups = max(1, -(-stored.count() // docs_per_group))
    dealt = stored.select("doc_id", F.coalesce("tokens", F.lit(b"")).alias("tokens"), F.monotonically_increasing_id().alias(
        "place")).select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens", "place"), F.lit(groups)).alias("packing_group"))
    return dealt.groupBy("packing_group").applyInArrow(lambda table: _pack(table, capacity, pad, id_bytes), PACKED)


def pack_texts(docs: DataFrame, tokenizer: Broadcast, capacity: int = ROW_TOKENS, pad: int = 50256,
               docs_per_group: int = DOCS_PER_GROUP) -> DataFrame:
    """Documents (doc_id, text) as packed rows; the tokens are written to the shared folder first."""
    id_bytes = np.dtype(in_worker(tokenizer.value).kind).itemsize
    return pack(settle(tokenized(docs, tokenizer), "tokens"), capacity, pad, docs_per_group, id_bytes)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with binary matrices, ordered by group and row inside each file."""
    packed.sortWithinPartitions("packing_group", "row").write.mode("errorifexists").parquet(path)


def unpacked(packed: DataFrame, id_bytes: int = 4) -> DataFrame:
    """(doc_id, start, tokens) of every segment: the way back."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cuts = r["cumulative"]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(r["starts"], pa.int64()),
                    "tokens": pa.array([r["ids"][id_bytes * a:id_bytes * b] for a, b in zip(cuts, cuts[1:])],
                                       pa.binary())})

    return packed.mapInArrow(back, "doc_id long, start long, tokens binary")
