import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetloom.llm.bpe import tokenizer_file
from packetloom.llm.packing import best_fit_decreasing, pack, pack_texts, split, unpacked, write_packed


def plain(lengths, capacity):
    rows, left = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fitting = [r for r in range(len(rows)) if left[r] >= lengths[k]]
        if not fitting:
            rows.append([])
            left.append(capacity)
            fitting = [len(rows) - 1]
        room = min(left[r] for r in fitting)
        rows_with = [r for r in fitting if left[r] == room]
        rows[rows_with[-1]].append(k)
        left[rows_with[-1]] -= lengths[k]
    return rows, left


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 2048])
def test_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        lengths = [rng.randrange(capacity + 1) for _ in range(rng.randrange(120))]
        rows = best_fit_decreasing(lengths, capacity)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        used = sorted(sum(lengths[k] for k in r) for r in rows)
        expected, left = plain(lengths, capacity)
        assert used == sorted(capacity - x for x in left) and len(rows) == len(expected)


def test_split():
    assert split([0, 5, 8, 9], 4) == [(0, 0, 0), (1, 0, 4), (1, 4, 1), (2, 0, 4), (2, 4, 4), (3, 0, 4), (3, 4, 4), (3, 8, 1)]


def test_rows_are_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    docs = [(k % 90, rng.integers(0, 50000, int(rng.integers(0, 60)), dtype=np.uint32)) for k in range(100)]
    docs += [(500, rng.integers(0, 9, 1000, dtype=np.uint32)), (None, np.arange(5, dtype=np.uint32)), (None, np.empty(0, np.uint32))]
    df = spark.createDataFrame([(d, t.tobytes()) for d, t in docs] + [(7, None)], "doc_id long, tokens binary")
    df = df.selectExpr("doc_id", "tokens", "1 AS row", "2 AS packing_group").repartition(4)
    packed = pack(df, capacity=32, pad=1, docs_per_group=40)
    rows = packed.collect()
    assert len({r.packing_group for r in rows}) == 3
    for r in rows:
        ids, places = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.positions, np.uint16)
        assert len(ids) == len(places) == 32 and r.cumulative[0] == 0 and r.cumulative[-1] == r.n_tokens <= 32
        assert len(r.doc_ids) == len(r.starts) == len(r.cumulative) - 1
        assert (ids[r.n_tokens:] == 1).all()
        for a, b in zip(r.cumulative, r.cumulative[1:]):
            assert places[a:b].tolist() == list(range(b - a))
    parts = sorted(((r.doc_id, r.start, bytes(r.tokens)) for r in unpacked(packed).collect()), key=repr)
    expected = [(d, s, t[s:s + 32].tobytes()) for d, t in docs for s in range(0, max(1, len(t)), 32)] + [(7, 0, b"")]
    assert parts == sorted(expected, key=repr)
    write_packed(packed, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == len(rows)
    assert pack(df.limit(0)).count() == 0


def test_copies_spread_over_the_groups(spark):
    rows = [(None, b"\1\0\0\0")] * 2000 + [(k, b"\2\0\0\0") for k in range(2000)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, tokens binary"), capacity=8, docs_per_group=200).collect()
    sizes = {}
    for r in packed:
        sizes[r.packing_group] = sizes.get(r.packing_group, 0) + len(r.doc_ids)
    assert len(sizes) == 20 and sum(sizes.values()) == 4000 and max(sizes.values()) < 300


def test_query_round_trip(spark):
    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = QUERIES["op3_token_packing"](spark, folder)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    back = {}
    for r in unpacked(packed, 2).collect():
        back.setdefault(r.doc_id, []).append((r.start, bytes(r.tokens)))
    assert back.keys() == docs.keys()
    for d, parts in back.items():
        ids = np.frombuffer(b"".join(t for _, t in sorted(parts)), np.uint16).tolist()
        assert ids == library.encode(docs[d], add_special_tokens=False).ids
    used = [r.n_tokens for r in packed.select("n_tokens").collect()]
    assert sum(used) / len(used) > 0.97 * 2048
    assert pack_texts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"),
                      tokenizer_file(spark)).first().doc_ids == [1, 2]
