import random
import re

import pytest

from packetloom.llm.decontamination import clean_documents, scan
from packetloom.llm.decontamination import test_sets as sliced

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, n=10):
    grams = {}
    for item, text in items:
        words = words_of(text)
        if words:
            for i in range(max(1, len(words) - n + 1)):
                grams.setdefault(tuple(words[i:i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(words) - size + 1):
                key = tuple(words[i:i + size])
                if key in grams:
                    hit.update(range(i, i + size))
                    found |= grams[key]
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = "Alpha be'ta ÉTÉ été 中文 x1 Ÿ w-z K".split()
    item = lambda k: " ".join(rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(k))
    items = [(k, item(rng.randrange(0, 40))) for k in range(20)]
    items += [(100, "short words only"), (101, "lone"), (102, None), (None, item(15)), (5, items[5][1]), (103, "..."),
              (104, items[3][1])]
    docs = []
    for k in range(120):
        parts = [item(rng.randrange(30))]
        if k % 3 == 0:
            source = rng.choice(items)[1] or ""
            parts += [source.upper() if k % 2 else source.replace(" ", "!\n "), item(5)]
        docs.append((k, " ".join(parts)))
    docs += [(7, docs[7][1]), (200, None), (201, ""), (None, items[2][1]), (202, "Lone LONE x lone"),
             (203, (item(10) + " ") * 3000 + items[1][1]), (204, "a short words only\x00b")]
    return docs, items


@pytest.mark.parametrize("limit", [16 << 20, 6000])
def test_equals_brute_force(spark, tables, limit):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS items", "2 AS unit").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS gram")
    assert got(scan(d, b, broadcast_bytes=limit)) == plain(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    none = spark.createDataFrame([], "doc_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert scan(none, b).count() == 0
    assert got(scan(d, none.withColumnRenamed("doc_id", "item_id"))) == plain(docs, [])


@pytest.mark.parametrize("limit", [16 << 20, 6000])
def test_removal(spark, tables, limit):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "doc_id", "array(doc_id) AS gram")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = {(r[0], r[1]): r[2] for r in plain(docs, items)}
    kept = clean_documents(d, b, broadcast_bytes=limit)
    assert kept.schema == d.schema
    assert kept.count() == sum(not r[2] for r in plain(docs, items))
    cut = {(r.doc_id, len(words_of(r.text))) for r in clean_documents(d, b, remove="spans").collect()}
    assert cut == {(doc, n - expected[doc, n]) for doc, n in expected}


def test_removal_holds_one_slice_at_a_time(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert len(sliced(b, 10, 6000)) > 2
    plan = clean_documents(d, b, broadcast_bytes=6000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_query_over_the_whole_table(spark):
    import hashlib

    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = sorted((tuple(r) for r in QUERIES["op8_benchmark_decontamination"](spark, folder).collect()), key=repr)
    assert rows == sorted(((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
                           for d, n, h, i in plain(docs, items)), key=repr)
    assert any(r[-1] for r in rows)
