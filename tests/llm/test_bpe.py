import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetloom.llm.bpe import Bpe, chunks, encode, tokenizer_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["abcdefg", "the ", "  ", "\n", "\n\n", "'s", "'re", "'", "!!", "é", "中文", "123", "½", "\xa0", "\x1c", " ",
         "<|endoftext|>", "<|endof", "\t", "x" * 300, "ab" * 200, "日本" * 150, "!?" * 200, " " * 40, "e\u0301", "Ⅷ",
         "0123456789" * 40, "\x00", "🙂🙃", "\r\n", "\u2003"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as file:
        return Bpe(file.read(), leaf_bytes=16)


def random_texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(count)]


def test_chunks_lose_nothing():
    for text in random_texts(1, 500):
        assert "".join(chunks(text)) == text


def test_equals_the_library(bpe, library):
    for text in random_texts(2, 1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.ids(text) == ids
        assert bpe.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == library.decode(
            ids, skip_special_tokens=False)


def test_joined_halves_of_long_words(bpe, library):
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("theandingouabcdexyzéñ") for _ in range(rng.randrange(1, 3000)))
        assert bpe.word(word) == library.encode(word, add_special_tokens=False).ids


def test_joined_segments(bpe, library):
    rng = random.Random(3)
    for text in random_texts(3, 1500):
        size = rng.choice([3, 5, 17, 50, 200])
        parts = [bpe.segment(text[i:i + size]) for i in range(0, len(text), size)] or [[]]
        while len(parts) > 1:
            parts = [bpe.join_segments(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i]
                     for i in range(0, len(parts), 2)]
        assert [i for _, ids in parts[0] for i in ids] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("split", [1 << 16, 40])
def test_documents(spark, library, split):
    texts = [*random_texts(5, 60), None, "", "word " * 20000, "x" * 70000, "<|endoftext|>" * 6000, "a", "a"]
    rows = [(None if k == 9 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS ids", "3 AS row").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in encode(
        df, tokenizer_file(spark, PATH), split).collect()), key=repr)
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected, key=repr)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file(spark)).count() == 0


def test_query_over_the_whole_table(spark, library):
    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    expected = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), sha(",".join(map(str, ids))),
                         sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in QUERIES["op9_bpe"](spark, folder).collect()) == sorted(expected)
