import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.llm.quality_rules import Condition, judge, learn, statistics, verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(repeated), failed)


def texts(seed, count=150):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        vocabulary = [rng.choice(["the", "of", "été", "中文", "#", "a|b", "<x>", "🙂🙂", "\x0b", "x\x00y"]) for _ in range(rng.randrange(1, 9))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", " \r\n", "\n\n"])
                           for _ in range(rng.randrange(120))))
    return [*out, None, "", " ", "\n", "a", "a b", "a b c", "a a a a", "w " * 30_000, " lead", "one\ntwo\none\n one"]


def columns(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_statistics_equal_brute_force(spark):
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "2 AS w").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality long")
    got = sorted(((r.doc_id, columns(r), r.kept) for r in judge(df, labels).collect()), key=repr)
    assert got == sorted(((d, plain(t), not plain(t)[-1]) for d, t in rows), key=repr)
    assert judge(df.limit(0), labels).count() == 0


def test_decision_list_in_order():
    rules = [(Condition("a", True, 1.0), Condition("b", False, 2.0)), (Condition("c", True, 0.5),)]
    assert str(rules[0][0]) == "a >= 1" and str(rules[0][1]) == "b < 2"
    assert "WHEN" in str(verdict(rules)) and str(verdict([])) == str(F.lit(True))


def test_rules_are_learned_and_hold_on_other_rows(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        bad = k % 4 == 0
        words = [f"word{rng.randrange(500)}" for _ in range(80)]
        if bad and k % 8:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), 0 if bad else 1))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows if k < 600] + [(None, 0, 0), (5, None, 0)],
                                   "doc_id long, quality long, toxic long")
    kept = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    wrong = sum(kept[k] != bool(q) for k, _, q in rows if k >= 600)
    assert wrong <= 6
    rules = learn(statistics(docs), labels)
    assert 1 <= len(rules) <= 6 and all(1 <= len(rule) <= 4 for rule in rules)


def test_native(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_over_the_whole_table(spark, folder):
    from packetloom.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_quality_rules"](spark, folder).collect()}
    assert {d: columns(r) for d, r in got.items()} == {d: plain(t) for d, t in docs.items()}
    passed = [d for d in quality if not got[d].base_failed]
    good = [d for d in passed if quality[d]]
    bad = [d for d in passed if not quality[d]]
    assert sum(got[d].kept for d in good) >= 0.97 * len(good)
    assert sum(not got[d].kept for d in bad) >= 0.6 * len(bad)
