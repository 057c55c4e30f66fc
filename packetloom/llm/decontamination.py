"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for in documents.

Normalising lower-cases A to Z and takes words of digits, letters and bytes from 0x80 up. Every window of
`n` words of a benchmark item is a test n-gram; a shorter item with any word is one n-gram as a whole.
Documents are scanned in flat buffers: each window's Rabin-Karp hash is looked up in a bit table, then in
the sorted hashes; what is found there is verified word by word. Words in any verified window are hit.

The broadcast set is bounded: if the n-grams take more than `broadcast_bytes`, they are dealt into slices
of that size, the documents are packed into units once and scanned slice by slice, and the hits are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import units
from packetloom.llm.texts import flat, rolling, text_slices, word_hashes, word_spans
from packetloom.settings import discard

BROADCAST_BYTES = 16 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
NOT_IN_WORD = np.ones(256, bool)
NOT_IN_WORD[0x30:0x3A] = NOT_IN_WORD[0x61:0x7B] = NOT_IN_WORD[0x80:] = False
FIELDS = ("doc_id long, n_words long, n_hit long, items array<string>, "
          "hits array<struct<start:long,end:long>>")
HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Words:
    """The normalised words of a flat buffer."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray):
        self.buffer = LOWER[buffer]
        self.begin, self.end, self.text = word_spans(self.buffer, starts, NOT_IN_WORD)
        self.hashes = word_hashes(self.buffer, self.begin, self.end)
        self.rows = len(starts) - 1
        self.first = np.searchsorted(self.text, np.arange(self.rows + 1))

    def joined(self, start: int, count: int) -> bytes:
        return b" ".join(self.buffer[a:b].tobytes() for a, b in zip(
            self.begin[start:start + count].tolist(), self.end[start:start + count].tolist()))


class TestSet:
    """A slice of the test n-grams, as it is broadcast."""

    __test__ = False

    def __init__(self, rows: list[tuple[str, int, str]]):
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        self.items: dict[bytes, list[str]] = defaultdict(list)
        by_length = defaultdict(set)
        for text, count, item in rows:
            data = text.encode()
            self.items[data].append(item)
            by_length[count].add(data)
        for count, grams in by_length.items():
            buffer, starts = flat(pa.array(sorted(grams), pa.binary()))
            words = _Words(buffer, starts)
            hashes = np.unique(rolling(words.hashes, count)[words.first[:-1]])
            bits = min(26, max(12, len(hashes).bit_length() + 6))
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            self.lengths[count] = hashes, table, bits

    def find(self, words: _Words) -> Iterator[tuple[int, int, bytes]]:
        """Verified windows: first word, number of words, n-gram."""
        for count, (hashes, table, bits) in self.lengths.items():
            rolled = rolling(words.hashes, count)
            at = np.flatnonzero(table[rolled >> np.uint64(64 - bits)])
            at = at[words.text[at] == words.text[at + count - 1]]
            near = np.minimum(np.searchsorted(hashes, rolled[at]), len(hashes) - 1)
            for start in at[hashes[near] == rolled[at]].tolist():
                gram = words.joined(start, count)
                if gram in self.items:
                    yield start, count, gram


def test_ngrams(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (gram, n_words, item) of benchmark items (item_id, text); a null id reads `null`."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                names = batch.column(0).slice(first, last - first).to_pylist()
                words = _Words(*flat(batch.column(1).slice(first, last - first)))
                out = []
                for row, name in enumerate(names):
                    start, stop = int(words.first[row]), int(words.first[row + 1])
                    for at in range(start, max(stop - n, start) + 1 if stop > start else start):
                        count = min(n, stop - at)
                        out.append((words.joined(at, count).decode(), count, name))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*out)], ["gram", "n_words", "item"])

    picked = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")),
                              F.col("text").cast("string"))
    return picked.mapInArrow(cut, "gram string, n_words long, item string").distinct()


def test_sets(benchmark: DataFrame, n: int, broadcast_bytes: int) -> list[Broadcast]:
    """The test n-grams as broadcast slices of about `broadcast_bytes` each; mostly it is one."""
    grams = units.settle(test_ngrams(benchmark, n), "ngrams")
    size = grams.agg(F.sum(F.octet_length("gram") + F.octet_length("item") + 16)).first()[0] or 0
    slices = max(1, -(-int(size) // broadcast_bytes))
    context = grams.sparkSession.sparkContext
    return [context.broadcast(TestSet([tuple(r) for r in grams.where(
        F.pmod(F.xxhash64("gram", "item"), F.lit(slices)) == k).collect()])) for k in range(slices)]


def _covered(words: _Words, spans: list[tuple[int, int]]) -> np.ndarray:
    steps = np.zeros(len(words.begin) + 1, np.int64)
    for start, count in spans:
        steps[start] += 1
        steps[start + count] -= 1
    return np.cumsum(steps)[:-1] > 0


def _byte_runs(words: _Words, hit: np.ndarray, row: int, start: int) -> list[dict]:
    """Maximal runs of hit words of a text as byte ranges in it."""
    a, b = int(words.first[row]), int(words.first[row + 1])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]])))
    return [{"start": int(words.begin[a + i]) - start, "end": int(words.end[a + j - 1]) - start}
            for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist())]


def _rows(ids: pa.Array, words: _Words, starts: np.ndarray, spans: list[tuple[int, int]],
          items: dict[int, set[str]]) -> pa.RecordBatch:
    hit = _covered(words, spans)
    counts = np.diff(words.first)
    n_hit = np.bincount(words.text[hit], minlength=words.rows)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
         pa.array([sorted(items.get(row, ())) for row in range(words.rows)], pa.list_(pa.string())),
         pa.array([_byte_runs(words, hit, row, int(starts[row])) if n else []
                   for row, n in enumerate(n_hit.tolist())], HITS)],
        ["doc_id", "n_words", "n_hit", "items", "hits"])


def _search(tests: TestSet, words: _Words) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
    spans, items = [], defaultdict(set)
    for start, count, gram in tests.find(words):
        spans.append((start, count))
        items[int(words.text[start])].update(tests.items[gram])
    return spans, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES
         ) -> DataFrame:
    """One row per document of `docs` (doc_id, text): words, hit words, items found, hit byte ranges.

    `items` are the distinct ids of the items with a window in the text, sorted as strings. A null text has
    no words; a null or repeated doc_id is kept as it is; a repeated benchmark row changes nothing; a null
    item id reads `null`. Without benchmark items nothing is hit; without documents there are no rows.
    Other columns of either table are not looked at.
    """
    tests = test_sets(benchmark, n, broadcast_bytes)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scan(picked, tests)


def _scan(picked: DataFrame, tests: list[Broadcast]) -> DataFrame:
    if len(tests) > 1:
        return _scan_slices(picked, tests)
    only = tests[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                buffer, starts = flat(part.column(1))
                words = _Words(buffer, starts)
                yield _rows(part.column(0), words, starts, *_search(only.value, words))

    return picked.mapInArrow(search, FIELDS)


def _scan_slices(docs: DataFrame, tests: list[Broadcast]) -> DataFrame:
    """The scan where the test set is too large for one broadcast: a pass per slice, hits merged by unit."""
    packed = units.make_units(docs)

    def part(tests: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (unit,) in units.opened(batches):
                spans, items = _search(tests.value, _Words(unit.buffer, unit.starts))
                if spans:
                    flat_items = [(row, name) for row, names in items.items() for name in names]
                    yield pa.RecordBatch.from_pydict({
                        "unit": [unit.number], "at": [[s for s, _ in spans]], "count": [[c for _, c in spans]],
                        "row": [[r for r, _ in flat_items]], "item": [[x for _, x in flat_items]]})

        return units.settle(packed.mapInArrow(
            search, "unit long, at array<long>, count array<long>, row array<long>, item array<string>"), "hits")

    found = part(tests[0])
    for more in tests[1:]:
        found = found.unionByName(part(more))
    merged = found.groupBy("unit").agg(
        F.collect_list(F.struct("at", "count", "row", "item")).alias("answers"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, answers in units.opened(batches):
            words = _Words(unit.buffer, unit.starts)
            spans, items = [], defaultdict(set)
            for told in answers or ():
                spans += zip(told["at"], told["count"])
                for row, name in zip(told["row"], told["item"]):
                    items[row].add(name)
            ids = pa.array(unit.ids, mask=unit.ids == units.NO_ID)
            yield _rows(ids, words, unit.starts, spans, items)

    return units.attach(packed, merged).mapInArrow(rows, FIELDS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents",
                    broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without benchmark text, all their columns kept.

    `remove="documents"` drops documents with a hit word, `remove="spans"` cuts the hit runs out of `text`. Every
    slice of the test set is a pass of its own, so that an executor holds one slice at a time.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    tests = test_sets(benchmark, n, broadcast_bytes)
    at = docs.columns.index("text")
    if remove == "documents":
        out, before = docs, None
        for one in tests[:-1]:
            out = units.settle(out.mapInArrow(_dropper(one, at), docs.schema), "kept")
            if before is not None:
                discard(before)
            before = out
        return out.mapInArrow(_dropper(tests[-1], at), docs.schema)
    row = next(name for name in map("row_{}".format, range(len(docs.columns) + 1)) if name not in docs.columns)
    numbered = units.settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    picked = numbered.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _scan(picked, tests).where("n_hit > 0").select(F.col("doc_id").alias(row), "hits")
    joined = numbered.join(found.withColumnRenamed("hits", f"{row}_hits"), row, "left")
    return joined.select(*docs.columns, f"{row}_hits").mapInArrow(_cutter(at), docs.schema)


def _dropper(tests: Broadcast, at: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(at)):
                part = batch.slice(first, last - first)
                words = _Words(*flat(part.column(at)))
                clean = np.ones(words.rows, bool)
                clean[[int(words.text[start]) for start, _, _ in tests.value.find(words)]] = False
                yield part.filter(pa.array(clean))
    return drop


def _cutter(at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            texts = columns[at].to_pylist()
            for row, runs in enumerate(batch.column(len(columns)).to_pylist()):
                if runs:
                    data, keep, upto = texts[row].encode(), [], 0
                    for run in runs:
                        keep.append(data[upto:run["start"]])
                        upto = run["end"]
                    texts[row] = b"".join([*keep, data[upto:]]).decode()
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
    return cut
