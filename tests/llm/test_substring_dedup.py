import hashlib
import random
import re

import pytest

from packetloom.llm.substring_dedup import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    seen, out = {}, []
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            rank = float("inf") if doc is None else doc
            seen[key] = min(seen.get(key, rank), rank)
    for doc, text in rows:
        words = WORD.findall(text or "")
        rank = float("inf") if doc is None else doc
        gone = set()
        for i in range(len(words) - width + 1):
            if seen[tuple(words[i:i + width])] < rank:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, width, **more):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                   for r in remove_repeated_windows(df, width, **more).collect()), key=repr)


@pytest.mark.parametrize("width,unit_bytes", [(50, 1 << 20), (7, 2000), (1, 300)])
def test_equals_brute_force(spark, width, unit_bytes):
    rng = random.Random(width)
    passages = [" ".join(rng.choice("ab cd é ñandú 中  x".split(" ")) + str(rng.randrange(30))
                         for _ in range(rng.randrange(3, 120))) for _ in range(12)]
    rows = [(k, rng.choice([" ", "\n", "\t \r"]).join(
        rng.choice(passages) if rng.random() < 0.6 else str(rng.randrange(10 ** 6)) for _ in range(rng.randrange(12))))
        for k in range(150)]
    rows += [(500 + k, passages[0] * 3) for k in range(40)] + [(7, rows[7][1]), (3, rows[90][1])]
    rows += [(900, None), (901, ""), (902, " \n"), (None, passages[1]), (None, None), (903, "one")]
    rows += [(904, "w " * 5000), (905, "w " * 4000 + passages[2]), (906, "a\x00b \x00 " + passages[3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS unit", "1 AS bucket", "2 AS n_words").repartition(5)
    assert found(df, width, unit_bytes=unit_bytes) == plain(rows, width)


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals_are_maximal(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in remove_repeated_windows(df, 3).collect()}
    assert got == {1: [], 2: [(1, 5), (6, 10)]}


def test_query_over_the_whole_table(spark):
    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_substring_dedup"](spark, folder).collect()), key=repr)
    assert got == plain(rows, 50)
