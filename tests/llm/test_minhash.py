import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import zstandard

from packetloom.llm import minhash
from packetloom.llm.components import components
from packetloom.llm.minhash import Shingles, classes, one_of_each, prob_minhash, probability_jaccard
from packetloom.llm.texts import flat

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    words = WORD.findall(text or "")
    if not words:
        return None
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(v, w):
    return sum(1 / sum(max(v[e] / v[d], w[e] / w[d]) for e in {*v, *w}) for d in v if d in w)


def plain(rows, least=0.8):
    bags = [weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and (bags[i].keys() & bags[j].keys()) and similarity(bags[i], bags[j]) >= least:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        best = min(members, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
        out += [(rows[i][0], rows[best][0], len(members)) for i in members]
    return sorted(out, key=repr), len(groups)


def make_rows(seed, count=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 150))] for _ in range(count // 8)]
    rows = []
    for k in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


def got(df):
    found = df.collect()
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=repr), sum(r.kept for r in found)


def test_registers_estimate_the_similarity():
    rng = random.Random(1)
    for _ in range(6):
        words = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(400)]
        other = words[:rng.randrange(100, 400)] * rng.choice([1, 2]) + [str(k) for k in range(rng.randrange(80))]
        texts = [" ".join(words), " ".join(other)]
        s = Shingles(*flat(pa.array(texts)))
        kept = prob_minhash(s, 4000)
        exact = similarity(weights(texts[0]), weights(texts[1]))
        assert abs((kept[0] == kept[1]).mean() - exact) < 0.04
        own = [(s.hash[a:b], s.weight[a:b]) for a, b in zip(s.first[:-1], s.first[1:])]
        assert probability_jaccard(*own[0], *own[1]) == pytest.approx(exact)
        plain_words = " ".join(dict.fromkeys(words[:60]))
        s = Shingles(*flat(pa.array([*texts, plain_words, plain_words + " and more", "none of them"])))
        own = [(s.hash[a:b], s.weight[a:b]) for a, b in zip(s.first[:-1], s.first[1:])]
        for one in own:
            assert minhash.similarities(one, own).tolist() == pytest.approx(
                [probability_jaccard(*one, *two) for two in own])


def test_short_and_empty_texts():
    s = Shingles(*flat(pa.array(["a b", "a b c d e", None, " ", "x", "a b c d e f a b c d e"])))
    assert np.diff(s.first).tolist() == [1, 1, 0, 0, 1, 6]
    assert s.weight[s.first[5]:].max() == 2
    kept = prob_minhash(s, 8)
    assert (kept[2:4] == 0).all() and (kept[0] == kept[0][0]).all() and kept[0][0] != kept[4][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = make_rows(seed)
    rows += [(7, rows[7][1]), (300, None), (301, ""), (302, " \n"), (None, rows[3][1]), (None, None), (303, "one two"),
             (304, "one two"), (305, "two one"), (306, "w1 " * 3000), (307, "w1 " * 2000)]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS label").repartition(3)
    assert got(classes(df)) == plain(rows)


def test_buckets_without_one_centre(spark):
    """A chain of texts where only neighbours are alike: one pivot per bucket cannot link them all."""
    rng = random.Random(5)
    words = [f"v{k}" for k in range(2000)]
    rows = [(k, " ".join(words[k * 8:k * 8 + 100])) for k in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(classes(df)) == plain(rows)


def test_blocks_of_leftover_links(spark):
    """Whatever the block size, the links join the labels that have a similar pair across them."""
    texts = sorted({t for _, t in make_rows(3, 80)})
    s = Shingles(*flat(pa.array(texts)))
    kept = prob_minhash(s)
    bands = minhash.band_keys(kept)
    nodes = [bytes([k]) * 16 for k in range(len(texts))]
    press = zstandard.ZstdCompressor()
    rows = [(int(key), nodes[k], nodes[k if k % 3 else 0], nodes[0], bands[k].tolist(),
             kept[k].astype(np.uint16).tobytes(), press.compress(t.encode()))
            for k, t in enumerate(texts) for key in bands[k]]
    df = spark.createDataFrame(rows, "bucket long, node binary, label binary, pivot_label binary, bands array<long>, "
                                     "registers binary, packed binary").withColumn("band", F.col("bucket"))
    once = df.withColumns({"bucket": F.col("pivot_label"), "band": F.lit(None).cast("long")}).dropDuplicates(["node"])
    label = {r[1]: r[2] for r in rows}
    bag = dict(zip(nodes, map(weights, texts)))

    def partition(links):
        root = {x: x for x in label.values()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for u, v in links:
            root[find(label[u])] = find(label[v])
        return {x: find(x) for x in root}

    def groups(links):
        whole = partition(links)
        return sorted(sorted(x for x in whole if whole[x] == r) for r in set(whole.values()))

    size, keys = Counter(r[0] for r in rows), dict(zip(nodes, bands.tolist()))

    def shared(u, v):  # members of the first common bucket; a bucket of two is left to its pivot
        return next((size[a] for a, b in zip(keys[u], keys[v]) if a == b), 0)

    near = [(u, v) for u in nodes for v in nodes if u < v and similarity(bag[u], bag[v]) >= 0.8]
    for members, block in ((df, 1000), (df, 7), (once, 1000), (once, 7)):
        every = [(u, v) for u, v in near if shared(u, v) > (0 if members is once else 2)]
        found = [(bytes(r.u), bytes(r.v)) for r in minhash.leftover_links(members, 0.8, block).collect()]
        assert found and groups(found) == groups(every)
        assert members is once or set(found) <= set(every)


def test_overlapping_buckets_are_merged(spark):
    rows = [(1, "a", "a", "a", 3), (1, "b", "b", "a", 3), (1, "c", "a", "a", 3), (2, "a", "a", "a", 2), (2, "b", "b", "a", 2),
            (3, "d", "d", "d", 3), (3, "e", "e", "d", 3), (3, "f", "d", "d", 3), (4, "g", "g", "g", 3), (4, "h", "g", "g", 3)]
    rows += [(10 + k, f"x{2 * k + j}", "z" if j else f"x{2 * k}", "z", 2) for k in range(9) for j in range(2)]
    known = spark.createDataFrame(rows, "bucket long, node string, label string, pivot_label string, n long").selectExpr(
        "bucket", "cast(node AS binary) node", "cast(label AS binary) label", "cast(pivot_label AS binary) pivot_label", "n")
    found = sorted((bytes(r.bucket), r.band, bytes(r.node)) for r in minhash.unclear_members(known).collect())
    merged = [(b"a", None, n) for n in (b"a", b"b", b"c")] + [(b"d", None, n) for n in (b"d", b"e", b"f")]
    apart = [(str(10 + k).encode(), 10 + k, f"x{2 * k + j}".encode()) for k in range(9) for j in range(2)]
    assert found == sorted(merged + apart, key=lambda r: (r[0], r[2]))


def test_one_of_each(spark):
    rows = [(k % 50, t) for k, t in make_rows(4)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 AS row_0")
    out = one_of_each(df)
    assert out.dtypes == df.dtypes and out.count() == plain(rows)[1]
    assert one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] \
        + [(5000, 5001 + k) for k in range(300)] + [(9, 9)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i
    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: find(i) for u, v in links if u != v for i in (u, v)}


def test_query_over_the_whole_table(spark):
    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(QUERIES["op10_prob_minhash"](spark, folder)) == plain(rows)
