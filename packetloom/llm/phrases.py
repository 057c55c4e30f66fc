"""Phrase collocations: n-grams of words with their counts per language, scored by their weakest cut.

Texts are cut into pieces at punctuation and line ends, and pieces into words. About `unit_bytes` of texts form a
shard. The words that are frequent in their language get global ids; each shard keeps a bidirectional FM-index
(`fm_index`) over these ids, stored in the shared folder, clustered by shard. Level by level every shard extends the n-grams that
are known to be frequent by one word and sends those of its own, each once with its count, to buckets by a hash;
a bucket adds up the counts of all shards, names the n-grams that reach `min_count`, and tells the shards which they
are. An n-gram is named by the ids of its parts without the last and without the first word, so sums are
exact and nothing longer than two numbers is shuffled. No n-gram can be frequent unless both parts are, so
nothing is lost by going on from those.

Scores, cuts and the dropping of phrases that a longer one accounts for are joins of the levels' tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.fm_index import Extensions, FMIndex, Grams
from packetloom.llm.texts import (
    BASE_1, BASE_2, SLICE_BYTES, flat, mix, text_slices, word_hashes, word_spans)
from packetloom.llm.units import bucket_edges, packed_bits, planes, unplanes
from packetloom.settings import discard, settle, settle_clustered

#: Bytes that end a piece, and those that only end a word (fixed values).
PIECE_ENDS = np.zeros(256, bool)
PIECE_ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_WORD = PIECE_ENDS.copy()
NOT_WORD[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

SHARDS = ("shard long, langs array<string>, totals array<long>, n_words long, lang_of binary, counts binary, "
          "lengths binary, words binary, codes binary")
ASKED_WORDS = "shard long, bucket int, n int, langs array<string>, payload binary"
TOLD_WORDS = ("shard long, bucket int, n int, answer binary, langs array<string>, phrases array<string>, "
              "fs array<long>")
INDEXES = "shard long, tokens long, ids binary, forward binary, backward binary"
ASKED = "shard long, bucket int, n int, payload binary"
TOLD = "shard long, bucket int, n int, answer binary"
GRAMS = "id long, prefix_id long, suffix_id long, f long"
#: In the column `shard` of what a bucket tells: the frequent words or n-grams themselves.
TABLE = -1


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _opened(data: bytes, dtype: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


# Shards ----------------------------------------------------------------------------------------------

def _hashes(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of words, a bounded number of bytes at a time."""
    cuts = np.searchsorted(begin, np.arange(0, len(buffer) + SLICE_BYTES, SLICE_BYTES))
    return np.concatenate([word_hashes(buffer, begin[a:b], end[a:b], base)
                           for a, b in zip(cuts[:-1], cuts[1:])] or [np.empty(0, np.uint64)])


def _distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each distinct pair of hashes, in order of the first, and which of them stands at every place."""
    _, at, code = np.unique(first, return_index=True, return_inverse=True)
    if not np.array_equal(second[at][code], second):
        pairs = np.rec.fromarrays([first, second])
        _, at, code = np.unique(pairs, return_index=True, return_inverse=True)
    return at, code


def _salts(langs: list[str]) -> np.ndarray:
    """A hash for each language that is the same in every shard."""
    buffer, starts = flat(pa.array([f"_{x}" for x in langs], pa.string()))
    return mix(word_hashes(buffer, starts[:-1], starts[1:] - 1, BASE_2))


def _shard(number: int, texts: pa.Array, langs: list[str]) -> dict:
    buffer, starts = flat(texts)
    buffer = LOWER[buffer]
    begin, end, text = word_spans(buffer, starts, NOT_WORD)
    names = sorted(set(langs))
    place = {name: k for k, name in enumerate(names)}
    lang = np.array([place[x] for x in langs], np.int64)[text]
    salt = _salts(names)[lang]
    at, code = _distinct(_hashes(buffer, begin, end, BASE_1) ^ salt, _hashes(buffer, begin, end, BASE_2) ^ salt)

    ends = np.cumsum(PIECE_ENDS[buffer], dtype=np.int64)
    apart = np.zeros(len(begin), np.int64)
    if len(begin):
        apart[1:] = (text[1:] != text[:-1]) | (ends[begin[1:]] != ends[begin[:-1]])
    codes = np.zeros(len(begin) + int(apart.sum()) + 2, np.int32)
    codes[1 + np.arange(len(begin)) + np.cumsum(apart)] = code + 1
    data = buffer.tobytes()
    words = b"".join([data[b:e] for b, e in zip(begin[at].tolist(), end[at].tolist())])
    return {"shard": number, "langs": names, "totals": np.bincount(lang, minlength=len(names)).tolist(),
            "n_words": len(at), "lang_of": lang[at].astype(np.int32).tobytes(),
            "counts": np.bincount(code, minlength=len(at)).astype(np.int64).tobytes(),
            "lengths": (end - begin)[at].astype(np.int32).tobytes(), "words": words, "codes": _squeezed(codes)}


_SHARD_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("n_words", pa.int64()),
    *[(name, pa.binary()) for name in ("lang_of", "counts", "lengths", "words", "codes")]])


def make_shards(docs: DataFrame, unit_bytes: int) -> DataFrame:
    """Texts (text, lang) as shards: their distinct words by language, ordered by hash, with counts, and the order
    in which the words stand in the texts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last in text_slices(batch.column(0), unit_bytes):
                row = _shard(number, batch.column(0).slice(first, last - first),
                             batch.column(1).slice(first, last - first).to_pylist())
                number += 1
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_SHARD_SCHEMA)

    picked = docs.select(F.col("text").cast("string").alias("text"),
                         F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return settle(picked.mapInArrow(pack, SHARDS), "shards")


# Words -----------------------------------------------------------------------------------------------

class _Words:
    """The distinct words of a shard, in order of their hashes."""

    def __init__(self, langs: list[str], lang_of: bytes, lengths: bytes, words: bytes):
        self.langs, self.lang_of = langs, np.frombuffer(lang_of, np.int32)
        self.lengths = np.frombuffer(lengths, np.int32)
        self.ends = np.cumsum(self.lengths, dtype=np.int64)
        self.words = words
        begin = self.ends - self.lengths
        data = np.frombuffer(words, np.uint8)
        self.hashes = _hashes(data, begin, self.ends, BASE_1) ^ _salts(langs)[self.lang_of]

    def entry(self, first: int, last: int, counts: np.ndarray) -> bytes:
        start = int(self.ends[first] - self.lengths[first])
        return b"".join([self.lang_of[first:last].tobytes(), self.lengths[first:last].tobytes(),
                         planes(counts[first:last]), self.words[start:int(self.ends[last - 1])]])


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, langs, lang_of, lengths, words, counts = (c[row].as_py() for c in batch.columns)
                own = _Words(langs, lang_of, lengths, words)
                counts = np.frombuffer(counts, np.int64)
                edges = bucket_edges(own.hashes, buckets).tolist()
                out = [(shard, b, j - i, langs, own.entry(i, j, counts))
                       for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (
                            pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.binary()))],
                        ["shard", "bucket", "n", "langs", "payload"])
    return ask


def _sum_words(table: pa.Table, min_count: int) -> pa.Table:
    """Add up the counts of a bucket's words, compared whole; tell each shard which are frequent, and their numbers."""
    sizes = table["n"].to_pylist()
    names: dict[str, int] = {}
    lang, count, words = [], [], []
    for n, langs, data in zip(sizes, table["langs"].to_pylist(), table["payload"].to_pylist()):
        place = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        lang.append(place[np.frombuffer(data, np.int32, n)])
        lengths = np.frombuffer(data, np.int32, n, 4 * n)
        count.append(unplanes(data[8 * n:], n, np.int64))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        words.append(pa.Array.from_buffers(pa.large_binary(), n, [
            None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[16 * n:])]))
    encoded = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
    lang, count = np.concatenate(lang), np.concatenate(count)
    key = encoded.indices.to_numpy() * np.int64(len(names)) + lang
    each, number, told = _numbered(key[None], count, min_count)
    at = told["first"]
    told_words = encoded.dictionary.take(pa.array(key[at] // len(names))).cast(pa.large_string()).to_pylist()
    order = list(names)
    bucket, out = table["bucket"][0].as_py(), []
    if len(at):
        out.append((TABLE, bucket, len(at), None, [order[k] for k in (key[at] % len(names)).tolist()], told_words,
                    told["total"].tolist()))
    out += [(shard, bucket, n, answer, None, None, None)
            for shard, n, answer in _told(table["shard"].to_pylist(), sizes, each)]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()),
             pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(kinds)],
                                ["shard", "bucket", "n", "answer", "langs", "phrases", "fs"])


def _numbered(keys: np.ndarray, count: np.ndarray, min_count: int) -> tuple[np.ndarray, int, dict]:
    """Sums over equal keys (a row for each part of the key): the number of its key at every place, -1 if it
    is not frequent; how many are; and for each of those a place and its sum."""
    order = np.lexsort(keys[::-1])
    ranked = keys[:, order]
    edge = np.flatnonzero(np.append(True, (ranked[:, 1:] != ranked[:, :-1]).any(0)))
    total = np.add.reduceat(count[order], edge)
    frequent = total >= min_count
    number = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
    each = np.empty(len(order), np.int32)
    each[order] = np.repeat(number, np.diff(np.append(edge, len(order))))
    return each, int(frequent.sum()), {"first": order[edge[frequent]], "total": total[frequent]}


def _told(shards: list[int], sizes: list[int], each: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each shard with anything frequent: bits for what it asked about, then the numbers of those."""
    for shard, n, end in zip(shards, sizes, np.cumsum(sizes).tolist()):
        own = each[end - n:end]
        if (own >= 0).any():
            yield shard, n, packed_bits(own >= 0) + own[own >= 0].tobytes()


def _named(answers: list[dict], hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted hashes that the buckets have named, and the ids."""
    edges = bucket_edges(hashes, buckets)
    at, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for answer in answers:
        first, last = int(edges[answer["bucket"]]), int(edges[answer["bucket"] + 1])
        data, bits = answer["answer"], -(-(last - first) // 8)
        at.append(first + np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, bits), count=last - first)))
        ids.append((np.int64(answer["bucket"]) << 32) + np.frombuffer(data[bits:], np.int32).astype(np.int64))
    return np.concatenate(at), np.concatenate(ids)


def _answers(told: DataFrame, level: int) -> DataFrame:
    return told.where(F.col("shard") != TABLE).select(
        "shard", F.struct(F.lit(level).alias("level"), "bucket", "answer").alias("told"))


def _collected(answers: DataFrame) -> DataFrame:
    return answers.groupBy("shard").agg(F.collect_list("told").alias("told")).hint("merge")


def frequent_words(shards: DataFrame, min_count: int, bucket_keys: int) -> tuple[DataFrame, DataFrame, int]:
    """Words that occur `min_count` times in their language (id, lang, phrase, f); what the shards are told of
    them; and the number of buckets."""
    buckets = max(1, -(-int(shards.agg(F.sum("n_words")).first()[0] or 0) // bucket_keys))
    told = settle(shards.select("shard", "langs", "lang_of", "lengths", "words", "counts").mapInArrow(
        _ask_words(buckets), ASKED_WORDS).groupBy("bucket").applyInArrow(
        lambda t: _sum_words(t, min_count), TOLD_WORDS), "told_words")
    words = told.where(F.col("shard") == TABLE).select(
        "bucket", F.posexplode(F.arrays_zip("langs", "phrases", "fs"))).select(
        (F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("pos")).alias("id"), F.col("col.langs").alias("lang"),
        F.col("col.phrases").alias("phrase"), F.col("col.fs").alias("f"))
    return words, told, buckets


def _sequence(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of frequent words as symbols 1, 2, ...; runs of other words and pieces of one word are one 0."""
    symbol = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    symbol[places + 1] = np.arange(1, len(places) + 1)
    text = symbol[codes]
    word = text > 0
    paired = np.zeros(len(text), bool)
    both = word[1:] & word[:-1]
    paired[1:] |= both
    paired[:-1] |= both
    text = np.where(paired, text, 0)
    held = np.append(True, (text[1:] > 0) | (text[:-1] > 0))
    text = text[held]
    return text if len(text) and text[-1] == 0 else np.append(text, np.int32(0))


def make_indexes(shards: DataFrame, told: DataFrame, buckets: int, max_words: int) -> DataFrame:
    """The FM-index of every shard over the ids of its frequent words, clustered by shard.

    Every level joins the indexes with what the shards have been told; clustered, they stay where they are.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, langs, lang_of, lengths, words, codes, answers = (c[row].as_py() for c in batch.columns)
                place, ids = _named(answers, _Words(langs, lang_of, lengths, words).hashes, buckets)
                order = np.argsort(place)
                text = _sequence(_opened(codes), place[order])
                index = FMIndex.of(text, max_words)
                yield pa.RecordBatch.from_pydict({
                    "shard": [shard], "tokens": [len(text)], "ids": [_squeezed(ids[order])],
                    "forward": [_squeezed(index.forward)], "backward": [_squeezed(index.backward)]})

    joined = shards.select("shard", "langs", "lang_of", "lengths", "words", "codes").join(
        _collected(_answers(told, 0)), "shard")
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return settle_clustered(joined.mapInArrow(build, INDEXES), "indexes", "shard", parts)


# Levels ----------------------------------------------------------------------------------------------

def _asked(found: Extensions, level: Grams) -> tuple[np.ndarray, ...]:
    """The n-grams of a shard ordered by hash: hashes, ids of both parts, counts, and the order."""
    prefix, suffix = level.ids[found.prefix], level.ids[found.suffix]
    hashes = mix(mix(prefix.astype(np.uint64) + BASE_1) + suffix.astype(np.uint64) * BASE_2)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], prefix[order], suffix[order], found.size[order], order


def _known(found: Extensions, level: Grams, buckets: int, told: list[dict]) -> Grams:
    """Those n-grams of a shard that the buckets have named, with their ids."""
    hashes, _, _, _, order = _asked(found, level)
    at, ids = _named(told, hashes, buckets)
    at = order[at]
    by_low = np.argsort(found.low[at])
    at = at[by_low]
    return Grams(found.low[at], found.back[at], found.size[at], ids[by_low])


def _sum_counts(table: pa.Table, min_count: int) -> pa.Table:
    """Add up the counts of a bucket; tell each shard which of its n-grams are frequent, and their numbers."""
    sizes, payloads = table["n"].to_pylist(), table["payload"].to_pylist()
    prefix, suffix, count = (np.concatenate([unplanes(p[8 * k * n:], n, np.int64) for n, p in zip(sizes, payloads)])
                             for k in range(3))
    each, frequent, told = _numbered(np.stack([prefix, suffix]), count, min_count)
    bucket, out = table["bucket"][0].as_py(), []
    if frequent:
        at = told["first"]
        out.append((TABLE, bucket, frequent, planes(prefix[at]) + planes(suffix[at]) + planes(told["total"])))
    out += [(shard, bucket, n, answer) for shard, n, answer in _told(table["shard"].to_pylist(), sizes, each)]
    return pa.Table.from_arrays([pa.array([row[k] for row in out], t) for k, t in enumerate(
        (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "bucket", "n", "answer"])


def _gram_rows(told: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, n, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                prefix, suffix, f = (unplanes(data[8 * k * n:], n, np.int64) for k in range(3))
                yield pa.RecordBatch.from_pydict({
                    "id": (np.int64(bucket) << 32) + np.arange(n), "prefix_id": prefix, "suffix_id": suffix, "f": f})
    return told.where(F.col("shard") == TABLE).select("bucket", "n", "answer").mapInArrow(rows, GRAMS)


def count_levels(indexes: DataFrame, min_count: int, max_words: int, bucket_keys: int) -> list[DataFrame]:
    """Frequent n-grams of 2, 3, ... words: id, the ids of both parts one word shorter, and their counts."""
    buckets: list[int] = []
    told: list[DataFrame] = []
    levels: list[DataFrame] = []
    bound = indexes.agg(F.sum("tokens")).first()[0] or 0
    for _ in range(2, max_words + 1):
        buckets.append(max(1, -(-int(bound) // bucket_keys)))
        table = indexes.select("shard", "ids", "forward", "backward")
        if told:
            answers = reduce(DataFrame.unionByName, [_answers(t, k) for k, t in enumerate(told)])
            table = table.join(_collected(answers), "shard")
        found = settle(table.mapInArrow(_asker(list(buckets)), ASKED).groupBy("bucket").applyInArrow(
            lambda t: _sum_counts(t, min_count), TOLD), "told")
        rows = settle(_gram_rows(found), "grams")
        told.append(found)
        levels.append(rows)
        # a shard holds no more n-grams of the next level than places where one of these stands
        bound = rows.agg(F.sum("f")).first()[0] or 0
        if not bound:
            break
    discard(*told)
    return levels


def _asker(buckets: list[int]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = [column[row].as_py() for column in batch.columns]
                index = FMIndex(_opened(cells[2]), _opened(cells[3]))
                level = index.words(_opened(cells[1], np.int64))
                level = level.only(level.size > 0)
                found = index.extend(level)
                for k, count in enumerate(buckets[:-1]):
                    level = _known(found, level, count, [t for t in cells[4] if t["level"] == k])
                    found = index.extend(level)
                hashes, prefix, suffix, size, _ = _asked(found, level)
                edges = bucket_edges(hashes, buckets[-1])
                out = [(cells[0], b, j - i, planes(prefix[i:j]) + planes(suffix[i:j]) + planes(size[i:j].astype(np.int64)))
                       for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if j > i]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["shard", "bucket", "n", "payload"])
    return ask


# Scores ----------------------------------------------------------------------------------------------

def _described(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """The phrases of a level with the counts of all their first and last parts, shortest part first."""
    first = shorter.select(F.col("id").alias("prefix_id"), "lang", F.col("phrase").alias("start"),
                           F.concat("firsts", F.array("f")).alias("firsts"))
    last = shorter.select(F.col("id").alias("suffix_id"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
    return level.join(first, "prefix_id").join(last, "suffix_id").select(
        "id", "prefix_id", "suffix_id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "f",
        "firsts", "lasts")


def _weakest_cut(words: int) -> Column:
    """The cut with the lowest score, the earliest of those: score, words before it, counts of both sides."""
    big = "decimal(20,0)"
    cuts = []
    for k in range(1, words):
        left, right = F.col("firsts")[k - 1], F.col("lasts")[words - k - 1]
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("f").cast(big) * F.col("n").cast("decimal(14,0)"),
                                left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, absorb_percent: int = 100,
            unit_bytes: int = 8 << 20, bucket_keys: int = 1 << 20) -> DataFrame:
    """Scored phrases of `docs` (text, lang): lang, phrase, words, a, l, r, n, score.

    Candidates are the phrases of 2 to `max_words` words that occur `min_count` times in a language; n counts all words
    of the language. A candidate inside a longer one with at least `absorb_percent` of its occurrences is
    dropped. A null text has no words, a null lang is `und`; repeated rows count again; without documents there
    are no phrases; other columns are not looked at. A text of any length is one shard's at most.
    """
    shards = make_shards(docs, unit_bytes)
    totals = shards.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(
        F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    totals = settle(totals, "totals")
    words, told, buckets = frequent_words(shards, min_count, bucket_keys)
    indexes = make_indexes(shards, told, buckets, max_words)
    levels = count_levels(indexes, min_count, max_words, bucket_keys)

    empty = F.array().cast("array<long>")
    below = words.select("id", "lang", "phrase", F.col("phrase").alias("last"), "f",
                         empty.alias("firsts"), empty.alias("lasts"))
    out = None
    for k, level in enumerate(levels, 2):
        below = settle(_described(level, below), "phrases")
        named = below.select("id", "lang", "phrase", F.lit(k).alias("words"), "f", "firsts", "lasts")
        if k - 2 < len(levels) - 1:
            more = levels[k - 1]
            longer = reduce(DataFrame.unionByName, [
                more.groupBy(F.col(end).alias("id")).agg(F.max("f").alias("most")) for end in ("prefix_id", "suffix_id")])
            longer = longer.groupBy("id").agg(F.max("most").alias("most"))
            named = named.join(longer, "id", "left").where(
                F.col("most").isNull() | (100 * F.col("most") < absorb_percent * F.col("f"))).drop("most")
        named = named.join(totals, "lang").withColumn("cut", _weakest_cut(k)).select(
            "lang", "phrase", "words", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = named if out is None else out.unionByName(named)
    discard(shards, indexes)
    return out


def best_phrases(docs: DataFrame, most: int = 2000, **options) -> DataFrame:
    """The first `most` phrases of each language by score, count and phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return phrases(docs, **options).withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
