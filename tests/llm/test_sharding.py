import zlib
from collections import Counter

from packetloom.llm.sharding import Shard, grown_tree, place, regular_tree, shard_of


def test_rows(spark):
    rows = [(k, "é" * (k % 7) + "x") for k in range(3000)] + [(5, "again"), (None, "a"), (None, None), (4000, None), (4001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot").repartition(7)
    got = place(df).collect()
    data = [("" if t is None else t).encode() for _, t in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law) for r in got), key=repr) == sorted(
        ((d, len(b) + 1, zlib.crc32(b), "key") for (d, _), b in zip(rows, data)), key=repr)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) > 250
    assert {r.shard for r in got} == set(range(8))
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 8)
    assert 200 < sum(r.grown_shard == 8 for r in got) < 480
    assert place(df.limit(0)).count() == 0


def test_independent_of_partitions(spark):
    df = spark.range(500).selectExpr("id AS doc_id", "'t' AS text")
    one = {r.doc_id: (r.shard, r.grown_shard) for r in place(df.repartition(1)).collect()}
    two = {r.doc_id: (r.shard, r.grown_shard) for r in place(df.repartition(6).orderBy("text")).collect()}
    assert one == two


def test_weights_and_confined_movement(spark):
    tree = regular_tree(8)
    heavier = tuple(Shard(s.number, s.region, s.rack, 3.0 if s.number == 6 else s.weight) for s in tree)
    without = tuple(Shard(s.number, s.region, s.rack, 0.0 if s.number == 0 else s.weight) for s in tree)
    df = spark.range(20_000)
    rows = df.select("id", *[shard_of(df.id, t).alias(n) for n, t in (("a", tree), ("b", heavier), ("c", without))]).collect()
    shares = Counter(r.b for r in rows)
    assert abs(shares[6] / 20_000 - 0.3) < 0.02 and all(abs(shares[k] / 20_000 - 0.1) < 0.02 for k in range(6))
    # Only into the heavier region, and inside it only into the heavier rack and shard.
    region = {s.number: s.region for s in tree}
    rack = {s.number: s.rack for s in tree}
    for r in rows:
        if r.a != r.b:
            assert region[r.b] == "region1"
            if region[r.a] == "region1":
                assert rack[r.b] == "rack3"
                if rack[r.a] == "rack3":
                    assert r.b == 6
        assert r.c != 0 and (r.a == r.c or region[r.a] == "region0")


def test_grown_tree():
    tree = grown_tree(regular_tree(8))
    assert len(tree) == 9 and tree[-1].number == 8 and tree[-1].region == "region2"


def test_native_and_whole_table(spark):
    from packetloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = QUERIES["op7_hash_tree"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = found.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {
        d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items()}
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
