"""Ordered operators against plain folds, with keys that span many chunks."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import evidence, folds, ordered, paging, ranking, rollup


def by_frame(df, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r["n"])]


@pytest.fixture
def keyed(spark):
    """Two thirds of the rows share one key."""
    rng = random.Random(5)
    rows = [(n, rng.choice(["hot", "hot", "a", "b"]), rng.choice([None, rng.randint(0, 40)]))
            for n in rng.sample(range(400), 200)]
    rows.sort()
    return rows, spark.createDataFrame(rows, "n bigint, key string, x bigint")


def test_scan_equals_a_fold(small_chunks, keyed):
    rows, df = keyed
    out = ordered.scan(df, ["key"], "n", position="p", previous={"prev": F.col("x")},
                       latest={"last": F.col("x")}, highest={"high": F.col("x")},
                       total={"sum": F.col("x")})
    expected, state = [], {}
    for n, key, x in rows:
        seen = state.setdefault(key, [])
        known = [v for v in seen if v is not None]
        expected.append((n, len(seen) + 1, seen[-1] if seen else None, known[-1] if known else None,
                         max(known, default=None), sum(known) if known else None))
        seen.append(x)
    assert by_frame(out, "n", "p", "prev", "last", "high", "sum") == expected


def test_missing_backward_and_threshold_times(spark, small_chunks):
    times = [0, 0, 999, 1999, None, 9000, 8000, 8100]
    df = spark.createDataFrame(
        [(n, "k", None if t is None else t * 1_000_000) for n, t in enumerate(times)],
        "n bigint, key string, ns bigint")
    gaps = ordered.packet_gaps(df, ["key"], "ns", "n")
    assert by_frame(gaps, "gap_ms") == [(None,), (0,), (999,), (1000,), (None,), (None,), (None,), (100,)]
    stats = ordered.gap_stats(df, ["key"], "ns", "n", 1000).first()
    assert (stats.pause_count, stats.interval_count, stats.backward_timestamp_count,
            stats.missing_timestamp_count, stats.mean_gap_ms, stats.max_gap_ms) == (
                1, 4, 1, 1, 524.75, 1000)


@pytest.mark.parametrize("last,pauses", [(299_999_999, 0), (300_000_000, 1)])
def test_a_gap_of_the_exact_threshold_is_a_pause(spark, last, pauses):
    df = spark.createDataFrame([(1, "k", 0), (2, "k", last)], "n bigint, key string, ns bigint")
    stats = ordered.gap_stats(df, ["key"], "ns", "n").first()
    assert (stats.max_gap_ms, stats.pause_count) == (last / 1e6, pauses)


def test_sequence_anomalies_equal_a_fold(spark, small_chunks):
    rng = random.Random(7)
    rows = [(n, rng.choice("aab"), max(0, n // 2 + rng.randint(-4, 4))) for n in range(150)]
    df = spark.createDataFrame(rows, "n bigint, key string, seq bigint")
    expected, state = [], {}
    for _, key, seq in rows:
        seen = state.setdefault(key, set())
        high, copy = max(seen, default=None), seq in seen
        late = not copy and high is not None and seq < high
        gap = seq - high - 1 if not copy and high is not None and seq > high + 1 else None
        expected.append((copy, late, gap))
        seen.add(seq)
    out = ordered.sequence_anomalies(df, ["key"], "seq", "n")
    assert by_frame(out, "is_duplicate", "is_out_of_order", "missing") == expected


def extended_by_fold(rows):
    out, high = [], {}
    for _, key, seq in rows:
        top = high.get(key)
        value = seq if top is None else top + (seq - top + 32768) % 65536 - 32768
        out.append((value, top))
        high[key] = value if top is None else max(top, value)
    return out


@pytest.mark.parametrize("seed,fan", [(0, 1024), (1, 2), (2, 3)])
def test_extended_sequences_equal_the_fold(spark, small_chunks, seed, fan):
    """Orderly streams, and streams whose jumps break the chain of steps."""
    rng = random.Random(seed)
    rows, at = [], {"calm": 65500, "wild": 0, "down": 400}
    for n in range(240):
        key = rng.choice(list(at))
        at[key] = {"calm": at[key] + rng.randint(-3, 9), "wild": rng.randint(0, 65535),
                   "down": at[key] - rng.randint(0, 20000)}[key]
        rows.append((n, key, at[key] % 65536))
    df = spark.createDataFrame(rows, "n bigint, key string, seq bigint")
    out = ordered.extend_sequence(df, ["key"], "seq", "n", fan=fan)
    assert by_frame(out, "extended", "highest_before") == extended_by_fold(rows)


def windows_by_fold(positions):
    opened, end = [], 0
    for p in positions:
        if p >= end:
            opened.append(p)
            end = max(0, p - 100) + 1000
    return opened


@pytest.mark.parametrize("chunk,fan", [("300", 2), ("1500", 1024), ("100000", 1024)])
def test_window_openers_equal_the_greedy_rule(spark, chunk, fan):
    spark.conf.set("packetloom.chunkRows", chunk)
    try:
        rng = random.Random(3)
        groups = {f"g{i}": sorted(rng.sample(range(rng.choice([50, 2000, 9000])), rng.randint(1, 40)))
                  for i in range(12)}
        groups["edges"] = [0, 50, 99, 999, 1000, 1899, 1900]
        df = spark.createDataFrame(
            [(k, p) for k, ps in groups.items() for p in ps], "key string, position bigint")
        found = {}
        for row in folds.window_openers(df, ["key"], "position", fan).collect():
            found.setdefault(row.key, []).append(row.position)
        assert {k: sorted(v) for k, v in found.items()} == {
            k: windows_by_fold(v) for k, v in groups.items()}
    finally:
        spark.conf.unset("packetloom.chunkRows")


def test_small_keys_are_opened_many_to_a_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    spark.conf.set("packetloom.chunkRows", "1500")
    try:
        rng = random.Random(5)
        groups = {(k if k else None, tool): sorted(rng.choices(range(rng.choice([3, 4000])), k=rng.randint(1, 30)))
                  for k in ["", *map(str, range(20))] for tool in ("a", "b")}
        df = spark.createDataFrame([(*k, p) for k, ps in groups.items() for p in ps], "key string, tool string, position bigint")
        found = {}
        opened = folds.window_openers(df.repartition(3), ["key", "tool"], "position")
        for row in opened.collect():
            found.setdefault((row.key, row.tool), []).append(row.position)
        last = opened._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        assert last.startswith("MapInArrow")  # not one Python call for each key
        for k, ps in groups.items():
            if k[0] is not None:
                assert sorted(found[k]) == windows_by_fold(ps)
        # a null key is a group too; only the entries of its later chunks find no key to join
        assert {k for k in found if k[0] is None} == {(None, "a"), (None, "b")}
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("packetloom.chunkRows")


def test_windows_merge_reasons_and_can_be_merged_again(spark):
    triggers = spark.createDataFrame(
        [("f", tool, p, p + 5000, True, [reason]) for tool, p, reason in [
            ("deep_tcp_flow", 100, "reset"), ("deep_tls_flow", 100, "alert"),
            ("deep_tcp_flow", 900, "reset"), ("deep_tcp_flow", 999, "zero_window"),
            ("deep_tcp_flow", 1000, "reset"), ("deep_tcp_flow", 1800, "reset")]],
        "flow_key string, tool string, position bigint, frame_number bigint, a_to_b boolean, "
        "reasons array<string>")
    windows = evidence.merge_windows(triggers)
    rows = sorted(windows.collect(), key=lambda r: (r.tool, r.sample_offset))
    assert [(r.tool, r.sample_offset, r.issue_count) for r in rows] == [
        ("deep_tcp_flow", 0, 3), ("deep_tcp_flow", 900, 2), ("deep_tls_flow", 0, 1)]
    assert rows[0].reasons == ["reset", "zero_window"]
    assert [e.issue_packet_index for e in rows[0].events] == [100, 900, 999]
    assert [e.reason_indices for e in rows[0].events] == [[0], [0], [1]]
    again = evidence.merge_windows(evidence.reopen_windows(windows))
    assert sorted(again.collect(), key=lambda r: (r.tool, r.sample_offset)) == rows


def test_ranks_follow_value_then_first_appearance(spark, small_chunks):
    rng = random.Random(9)
    rows = [(n, rng.choice([60, 60, 60, rng.randint(1, 10 ** 12)])) for n in range(120)]
    df = spark.createDataFrame(rows, "n bigint, bytes bigint")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    expected = {n: i for i, (n, _) in enumerate(order, 1)}
    ranked = ranking.rank_descending(df, "bytes", "n", "rank").collect()
    assert {r.n: r["rank"] for r in ranked} == expected


def test_buckets_keep_order(spark):
    rng = random.Random(2)
    values = sorted({rng.randint(-10 ** 6, 10 ** e) for e in range(1, 18) for _ in range(30)}
                    | {0, -1, 1, 4095, 4096, 2 ** 53 - 1, 2 ** 60 - 1, 2 ** 60})
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select(
        "v", ranking.bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert buckets == sorted(buckets)


def test_nearest_rank_rounds_half_to_even(spark):
    rng = random.Random(4)
    groups = {n: [round(rng.uniform(0, 200), 3) for _ in range(n)] for n in range(1, 40)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "g int, v double"
                               ).groupBy("g", "v").agg(F.count(F.lit(1)).alias("w"))
    out = ranking.nearest_rank(df, ["g"], "v", ranking.bucket(F.floor(F.col("v") * 1e6)),
                               {"median": 0.5, "p95": 0.95}, weight="w").collect()
    assert {r.g: (r.median, r.p95) for r in out} == {
        n: (sorted(vs)[round((n - 1) * 0.5)], sorted(vs)[round((n - 1) * 0.95)])
        for n, vs in groups.items()}


def test_ordered_distinct_keeps_the_first_values(spark, small_chunks):
    df = spark.createDataFrame(
        [(n, "k", v) for n, v in enumerate(["b", "a", "", None, "b", "c", "d", "a", "e"] * 3)],
        "n bigint, key string, v string")
    kept = ordered.ordered_distinct(df, ["key"], "v", "n", cap=3).collect()
    assert [(r.position, r.v) for r in sorted(kept, key=lambda r: r.position)] == [
        (1, "b"), (2, "a"), (3, "c")]


def test_packet_limit_counts_packets_not_numbers(packets, small_chunks):
    from packetloom.sources.tables import packet_limit

    pk = packets([{"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2"} for _ in range(40)]).withColumn(
        "frame_number", F.col("frame_number") * 3 + 100)
    got = packet_limit(pk, 17)
    assert got.columns == pk.columns
    assert sorted(r.frame_number for r in got.collect()) == [3 * k + 100 for k in range(1, 18)]
    assert packet_limit(pk, 100).count() == 40 and packet_limit(pk, 0).count() == 0


def test_ports_are_counted_without_a_sort_of_all_rows(packets, monkeypatch):
    rows = [{"src_ip": "a", "dst_ip": "b", "protocol": "UDP", "src_port": s, "dst_port": d}
            for s, d in [(7, 9), (9, 7), (None, 5), (8, 5), (9, None), (6, 4)]]
    seen = []
    monkeypatch.setattr(rollup, "by_frequency", lambda c, by=rollup.by_frequency: (seen.append(c), by(c))[1])
    found = rollup.port_counts(packets(rows)).collect()
    assert sorted((r["rank"], r["port"], r["n"]) for r in found) == [
        (1, 9, 3), (2, 7, 2), (3, 5, 2), (4, 8, 1), (5, 6, 1), (6, 4, 1)]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in aggregates[-1]


def test_pages_are_numbered_and_joined_in_tasks_of_bounded_rows(spark, small_chunks, monkeypatch):
    monkeypatch.setattr(paging, "ROWS_PER_TASK", 10)
    df = spark.createDataFrame([(n, "hot" if n % 3 else "a") for n in range(60)], "n bigint, flow_key string")
    asked = spark.createDataFrame([("hot", 5), ("hot", 30), ("a", 0)], "flow_key string, offset bigint")
    out = paging.paged_by_flow(df, asked, "n", 10)
    places = {"hot": [n for n in range(60) if n % 3], "a": list(range(0, 60, 3))}
    assert sorted((r["flow_key"], r["offset"], r["position"], r["n"]) for r in out.collect()) == sorted(
        (flow, at, p, places[flow][p]) for flow, at in [("hot", 5), ("hot", 30), ("a", 0)]
        for p in range(at, min(at + 10, len(places[flow]))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("6), REPARTITION_BY_NUM") >= 2
