import random
import re
from collections import Counter

import numpy as np
import pytest

from packetloom.llm.fm_index import FMIndex, Grams
from packetloom.llm.phrases import _distinct, best_phrases, phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, min_count, most=2000, absorb=100):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    held = {key: f for key, f in counts.items() if len(key[1]) > 1 and f >= min_count}
    inside = Counter()
    for (lang, words), f in held.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i:i + k]] = max(inside[lang, words[i:i + k]], f)
    rows = {}
    for (lang, words), a in held.items():
        if 100 * inside[lang, words] >= absorb * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k)
                for k in range(1, len(words))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append(
            (-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, totals[lang], -score) for lang, found in rows.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = "The of UND été 中文 a\x00b z-z Ÿ K b's x1 y2 rare".split(" ")
    fixed = ["alpha beta gamma delta epsilon zeta", "The of", "one lone pair", "été 中文 x1"]
    out = []
    for k in range(300):
        parts = []
        for _ in range(rng.randrange(25)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", "q", "7"]))
            parts.append(rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "; "]))
        out.append(("".join(parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    out += [(None, "en"), ("", None), (" .;\t", "de"), ("the of " * 5000, "fr"), ("no-break " * 9, "xx")]
    return out + out[:40]


@pytest.mark.parametrize("unit_bytes,bucket_keys,min_count", [(8 << 20, 1 << 20, 5), (700, 50, 5), (3000, 400, 2)])
def test_equals_brute_force(spark, docs, unit_bytes, bucket_keys, min_count):
    table = spark.createDataFrame(docs, "text string, lang string").selectExpr(
        "*", "1 AS words", "2 AS phrase", "3 AS shard", "4 AS n").repartition(5)
    found = best_phrases(table, 25, min_count=min_count, unit_bytes=unit_bytes, bucket_keys=bucket_keys)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(docs, min_count, 25)


def test_absorbed_at_a_lower_share(spark, docs):
    table = spark.createDataFrame(docs, "text string, lang string")
    found = best_phrases(table, min_count=4, absorb_percent=60)
    assert sorted(map(tuple, found.collect())) == plain(docs, 4, absorb=60)


def test_nothing_frequent_and_empty_tables(spark):
    table = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrases(table, min_count=2).collect() == []
    assert phrases(table.where("false")).collect() == []


def test_extension_is_whole_for_pruned_levels():
    rng = np.random.default_rng(1)
    for trial in range(100):
        kinds = int(rng.integers(1, 6))
        text = np.concatenate([[0], rng.integers(0, kinds + 1, rng.integers(0, 60)), [0]]).astype(np.int32)
        index = FMIndex.of(text, 5)
        level = index.words(np.arange(1, kinds + 1))
        names = [(k,) for k in range(1, kinds + 1)]
        held = level.size > 0
        for k in range(2, 6):
            level, names = level.only(held), [n for n, h in zip(names, held) if h]
            found = index.extend(level)
            grams = [names[p] + names[q][-1:] for p, q in zip(found.prefix, found.suffix)]
            assert all(names[p][1:] == names[q][:-1] for p, q in zip(found.prefix, found.suffix))
            every = Counter(tuple(text[i:i + k].tolist()) for i in range(len(text) - k + 1))
            assert dict(zip(grams, found.size.tolist())) == {
                g: f for g, f in every.items() if 0 not in g and g[1:] in names and g[:-1] in names}
            level, names = Grams(found.low, found.back, found.size, np.arange(len(grams))), grams
            held = rng.random(len(grams)) < (0.7 if trial % 2 else 2)


def test_words_of_one_hash_are_told_apart():
    at, code = _distinct(np.array([7, 7, 7, 3], np.uint64), np.array([1, 2, 1, 1], np.uint64))
    assert len(at) == 3 and code[0] == code[2] != code[1]
