"""Ranked lexical search: every item of a query set against all documents, the best documents of each.

The query set is cut into slices of about `slice_bytes` of distinct terms. For a slice, documents are packed into
shards of about `unit_bytes` of text, and each shard keeps posting lists of the slice's terms (document, count),
found through a sorted array of term hashes that is broadcast, and stored in the shared folder. Document
frequencies are the sums of list lengths over all shards.

A shard answers an item by a hybrid of two orders. Short lists go term at a time: their contributions are summed
into accumulators. These then act as one more iterator with an upper bound, beside the long lists, in a
document-at-a-time pass: only documents of those iterators that can still lift a document over the threshold
are visited, the others are looked up by binary search while the bounds allow it. A shard returns at most
`most` documents for an item, so what is ranked across shards is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.texts import (
    BASE_1, BASE_2, SLICE_BYTES, flat, text_slices, word_hashes, word_spans)
from packetloom.llm.units import NO_ID
from packetloom.settings import discard, settle

#: Bytes that are in no term (fixed values); only A to Z are lower-cased.
NOT_IN_TERM = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    NOT_IN_TERM[_low:_high + 1] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

INDEX = ("shard long, ids binary, lengths binary, terms array<int>, dfs array<int>, posted binary, tfs binary, "
         "n_docs long, n_terms long")
FOUND = "number long, doc_id long, score long"
#: Lists of at most this share of a shard's documents are summed into accumulators.
SHORT_SHARE = 1 / 8
#: Candidates that are scored between two looks at the threshold.
STEP = 256


# Queries ---------------------------------------------------------------------------------------------

def query_items(items: DataFrame) -> DataFrame:
    """One row per item id with its distinct terms, under a number; rows of one id are one item."""
    terms = F.regexp_extract_all(
        F.translate(F.col("text").cast("string"), UPPER_LETTERS, UPPER_LETTERS.lower()), F.lit(f"({TERM})"), F.lit(1))
    return settle(items.select("item_id", F.explode(F.array_distinct(terms)).alias("term"))
                  .groupBy("item_id").agg(F.collect_set("term").alias("terms"))
                  .select(F.monotonically_increasing_id().alias("number"), "item_id", "terms"), "items")


class QuerySet:
    """The items of a slice over their distinct terms, which are found by two hashes."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        terms = sorted({t for _, own in rows for t in own})
        buffer, starts = flat(pa.array(terms, pa.string()))
        ends = starts[1:] - 1
        first = word_hashes(buffer, starts[:-1], ends, BASE_1)
        order = np.argsort(first, kind="stable")
        self.first, self.second = first[order], word_hashes(buffer, starts[:-1], ends, BASE_2)[order]
        place = {terms[k]: n for n, k in enumerate(order.tolist())}
        self.items = [(number, np.array(sorted(place[t] for t in own), np.int64)) for number, own in rows]
        bits = min(24, max(10, len(terms).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.first >> self.shift] = True

    def find(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a buffer are query terms, and which terms they are."""
        hashes = word_hashes(buffer, begin, end, BASE_1)
        at = np.flatnonzero(self.table[hashes >> self.shift])
        near = np.minimum(np.searchsorted(self.first, hashes[at]), len(self.first) - 1)
        held = self.first[near] == hashes[at]
        at, near = at[held], near[held]
        held = self.second[near] == word_hashes(buffer, begin[at], end[at], BASE_2)
        return at[held], near[held]


# Index -----------------------------------------------------------------------------------------------

def _posted(column: pa.Array, queries: QuerySet) -> dict:
    buffer, starts = flat(column)
    buffer = LOWER[buffer]
    begin, end, text = word_spans(buffer, starts, NOT_IN_TERM)
    lengths = np.bincount(text, minlength=len(column))
    keys = [np.empty(0, np.int64)]
    cuts = np.searchsorted(begin, np.arange(0, len(buffer) + SLICE_BYTES, SLICE_BYTES))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at, term = queries.find(buffer, begin[a:b], end[a:b])
        keys.append(term * len(column) + text[a:b][at])
    key, tfs = np.unique(np.concatenate(keys), return_counts=True)
    term, doc = np.divmod(key, max(len(column), 1))
    terms, dfs = np.unique(term, return_counts=True)
    return {"lengths": lengths.astype(np.int64).tobytes(), "terms": terms.astype(np.int32),
            "dfs": dfs.astype(np.int32), "posted": doc.astype(np.int32).tobytes(), "tfs": tfs.astype(np.int64).tobytes(),
            "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum())}


def build_index(docs: DataFrame, queries: Broadcast, unit_bytes: int) -> DataFrame:
    """Posting lists of the slice's terms in shards of `docs` (doc_id, text), written to the shared folder."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last in text_slices(batch.column(1), unit_bytes):
                found = _posted(batch.column(1).slice(first, last - first), queries.value)
                yield pa.RecordBatch.from_pydict({
                    "shard": [number], "ids": [ids[first:last].tobytes()]} | {k: [v] for k, v in found.items()},
                    schema=_INDEX_SCHEMA)
                number += 1

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(picked.mapInArrow(build, INDEX), "postings")


_INDEX_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())),
    ("dfs", pa.list_(pa.int32())), ("posted", pa.binary()), ("tfs", pa.binary()), ("n_docs", pa.int64()),
    ("n_terms", pa.int64())])


class Postings:
    """Lists of a shard opened: documents and impacts of every term, and the greatest impact of each."""

    def __init__(self, cells: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(cells["ids"], np.int64)
        length = np.frombuffer(cells["lengths"], np.int64)
        weight = 100 - 90 + (90 * length * n_docs) // max(n_terms, 1)
        docs = np.frombuffer(cells["posted"], np.int32).astype(np.int64)
        tf = np.frombuffer(cells["tfs"], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * weight[docs])
        ends = np.cumsum(cells["dfs"], dtype=np.int64).tolist()
        self.lists = {}
        for term, first, last in zip(cells["terms"], [0, *ends], ends):
            own = impact[first:last]
            self.lists[term] = docs[first:last], own, int(own.max())


# Search ----------------------------------------------------------------------------------------------

def accumulate(lists: list[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
    """Several weighted lists as one: documents in order, sums of their scores, the greatest sum."""
    docs = np.concatenate([d for d, _, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    edge = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    scores = np.add.reduceat(np.concatenate([s for _, s, _ in lists])[order], edge)
    return docs[edge], scores, int(scores.max())


def _looked_up(docs: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, scores[at], 0)


class Best:
    """The best documents so far, by score and then by id; `floor` is the score a document needs to get in."""

    def __init__(self, most: int):
        self.most, self.floor = most, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.floor = max(self.floor, int(self.scores[-1]))


def hybrid(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, most: int,
           short_share: float = SHORT_SHARE, step: int = STEP) -> Best:
    """The best documents of a shard for weighted lists (documents in order, scores, greatest score).

    Iterators stand in order of their bounds. Those whose bounds together stay under the threshold cannot bring in
    a document of their own; they are only asked about documents that the others hold.
    """
    best = Best(most)
    short = [x for x in lists if len(x[0]) <= short_share * len(ids)]
    rest = [x for x in lists if len(x[0]) > short_share * len(ids)]
    if short:
        summed = accumulate(short)
        rest.append(summed)
        if len(summed[1]) >= most:  # partial sums are lower bounds
            best.floor = max(best.floor, int(np.partition(summed[1], -most)[-most]))
    rest.sort(key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in rest]).tolist()
    upto = 0
    while True:
        lead = next((k for k, b in enumerate(bounds) if b >= best.floor), len(rest))
        if lead == len(rest):
            return best
        heads = [docs[np.searchsorted(docs, upto):][:step] for docs, _, _ in rest[lead:]]
        heads = [h for h in heads if len(h)]
        if not heads:
            return best
        # as far as every leading iterator has been looked at
        end = min((int(h[-1]) for h in heads if len(h) == step), default=int(max(h[-1] for h in heads)))
        docs = np.unique(np.concatenate(heads))
        docs = docs[docs <= end]
        score = np.zeros(len(docs), np.int64)
        for own, scores, _ in rest[lead:]:
            score += _looked_up(own, scores, docs)
        for k in range(lead - 1, -1, -1):
            held = score + bounds[k] >= best.floor
            docs, score = docs[held], score[held]
            if not len(docs):
                break
            score = score + _looked_up(rest[k][0], rest[k][1], docs)
        held = score >= best.floor
        best.add(score[held], ids[docs[held]])
        upto = end + 1


def _answers(shard: Postings, queries: QuerySet, weights: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    weighted = {t: (docs, impact * weights[t], top * int(weights[t]))
                for t, (docs, impact, top) in shard.lists.items() if weights[t] > 0}
    for number, terms in queries.items:
        lists = [weighted[t] for t in terms.tolist() if t in weighted]
        if lists:
            best = hybrid(lists, shard.ids, most)
            yield from ((number, doc, score) for doc, score in zip(best.ids.tolist(), best.scores.tolist()))


def _slice(docs: DataFrame, queries: QuerySet, most: int, unit_bytes: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(queries)
    index = build_index(docs, shared, unit_bytes)
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    weights = np.zeros(len(queries.first), np.int64)
    for term, df in index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(
            F.sum("x.dfs")).collect():  # at most the terms of the slice
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    weighted = context.broadcast(weights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {name: batch.column(k)[row].as_py() for k, name in enumerate(batch.schema.names)}
                found = list(_answers(Postings(cells, n_docs, n_terms), shared.value, weighted.value, most))
                if found:
                    number, doc, score = (np.array(x, np.int64) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), pa.array(doc, mask=doc == NO_ID), pa.array(score)], ["number", "doc_id", "score"])

    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = index.mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out = settle(ranked, "ranked")
    for held in (shared, weighted):
        held.unpersist()
    discard(index)
    return out


def search(docs: DataFrame, items: DataFrame, most: int = 10, unit_bytes: int = 8 << 20, slice_bytes: int = 16 << 20
           ) -> DataFrame:
    """The `most` best documents of `docs` (doc_id, text) for each of `items` (item_id, text): item_id, rank, doc_id, score.

    Rows of one item id are one item, a null id among them; an item without terms in the documents has no
    rows. A null or empty text has no terms. Repeated documents count and are found one by one; a null
    doc_id is found and comes last among equals. Without items or documents there are no rows. Other columns are
    not looked at. The terms of an item, and a text, must fit in a task.
    """
    queries = query_items(items)
    size = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 16))).first()[0]
    slices = max(1, -(-int(size or 0) // slice_bytes))
    out = None
    for k in range(slices):
        rows = queries.where(F.pmod(F.xxhash64("number"), F.lit(slices)) == k).select("number", "terms").collect()
        if rows:
            found = _slice(docs, QuerySet([tuple(r) for r in rows]), most, unit_bytes)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    return out.join(queries.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
