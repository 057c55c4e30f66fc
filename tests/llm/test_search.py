import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm.search import hybrid, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most=10):
    held = [(doc, Counter(terms_of(text))) for doc, text in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in queries.items():
        scored = []
        for doc, counts in held:
            m = 100 - 90 + (90 * counts.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in terms if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:most], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    words = ["The", "of", "ÉTÉ", "été", "中文", "x1", "Ÿ", "K", "rare"] + [f"w{k}" for k in range(60)]
    text = lambda n: "".join(rng.choice(words[:9] if rng.random() < 0.4 else words) + rng.choice([" ", "-", "\x00", "\n"])
                             for _ in range(n))
    docs = [(k * 3 % 401, text(rng.randrange(1, 60))) for k in range(400)]
    docs += [(500 + k, docs[7][1]) for k in range(30)] + [(7, docs[5][1]), (7, docs[5][1]), (None, docs[9][1])]
    docs += [(900, None), (901, ""), (902, "-- !"), (903, "the of " * 20000), (904, "once")]
    items = [(k, text(rng.randrange(1, 25))) for k in range(15)]
    items += [(50, None), (51, "..."), (52, "absent words"), (None, "rare x1"), (None, "K"), (3, "w1 w2"), (3, "w1 w2"),
              (53, "once"), (54, "the"), (55, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("unit_bytes,slice_bytes,most", [(8 << 20, 16 << 20, 10), (1500, 400, 3)])
def test_equals_brute_force(spark, tables, unit_bytes, slice_bytes, most):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS shard").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS terms")
    found = search(d, q, most, unit_bytes, slice_bytes)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(docs, items, most)


def test_empty_tables(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert search(d, q.where("false")).collect() == []
    assert search(d.where("false"), q).collect() == []


def test_hybrid_equals_the_full_sum():
    rng = np.random.default_rng(2)
    for trial in range(300):
        n = int(rng.integers(1, 400))
        ids = rng.permutation(n * 2)[:n]
        total, lists = np.zeros(n, np.int64), []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.sort(rng.permutation(n)[:int(rng.integers(1, n + 1) ** rng.random()) or 1])
            scores = rng.integers(0, 5 if trial % 3 else 1000, len(docs))
            total[docs] += scores
            lists.append((docs, scores, int(scores.max())))
        best = hybrid(lists, ids, 10, float(rng.choice([0, 0.1, 0.5, 1])), int(rng.choice([1, 3, 64])))
        order = [k for k in np.lexsort((ids, -total))[:10] if total[k] > 0]
        assert best.ids.tolist() == ids[order].tolist() and best.scores.tolist() == total[order].tolist()
