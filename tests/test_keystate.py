"""Keyed stream state against plain folds over the packets in order of arrival."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.schemas import PACKET_COLUMNS
from packetloom.streaming import keystate, rollup


def folded_gaps(rows, threshold_ms):
    state = {}
    for way, frame, ns in rows:
        s = state.setdefault(way, dict(packets=0, intervals=0, pauses=0, backward=0, missing_times=0, total_ns=0,
                                       max_ns=None, last_ns=None))
        step = None if ns is None or s["last_ns"] is None else ns - s["last_ns"]
        s["packets"] += 1
        s["missing_times"] += ns is None
        if step is not None and step < 0:
            s["backward"] += 1
        elif step is not None:
            s["intervals"] += 1
            s["pauses"] += step / 1e6 >= threshold_ms
            s["total_ns"] += step
            s["max_ns"] = max(step, s["max_ns"] or 0)
        s["last_ns"], s["last_frame"] = ns, frame
    return state


def folded_sequences(rows):
    state = {}
    for source, number in rows:
        s = state.setdefault(source, dict(seen=set(), packets=0, out_of_order=0, gap_missing=0))
        high = max(s["seen"], default=None)
        s["packets"] += 1
        if number not in s["seen"] and high is not None:
            s["out_of_order"] += number < high
            s["gap_missing"] += max(0, number - high - 1)
        s["seen"].add(number)
    return state


def drain(spark, folder, batches, start):
    """Every batch is a run of its own, started again from the checkpoint; the rows each run has updated."""
    updated = []
    for batch in batches:
        batch.select(*PACKET_COLUMNS).write.mode("append").parquet(f"{folder}/arrived")
        running = start(rollup.packet_stream(spark, f"{folder}/arrived", batch.select(*PACKET_COLUMNS).schema), folder)
        for one in running if isinstance(running, list) else [running]:
            one.awaitTermination()
            updated.append([p["stateOperators"][0]["numRowsUpdated"] for p in one.recentProgress if p["numInputRows"]])
    return updated


@pytest.fixture
def arriving(packets):
    """Packets of three flows, two thirds in one of them, in four parts; the second part comes last."""
    rng = random.Random(6)
    records, clock = [], 1_700_000_000_000_000_000
    for n in range(160):
        clock += rng.choice([1, 1000, 400_000_000, -300])
        flow = rng.choice("aaaabc") if n < 120 else "a"
        records.append({
            "src_ip": f"10.0.0.{rng.choice('12')}", "dst_ip": f"10.1.0.{ord(flow)}", "protocol": "ESP",
            "timestamp_epoch": rng.choice([f"{clock // 10**9}.{clock % 10**9:09d}"] * 9 + ["no time"]),
            "esp_spi": rng.choice(["0x1", "0x1", "0x2", None]),
            "esp_sequence": rng.choice([n, n, n - 3, rng.randrange(20), 4096 * 64 + n, None])})
    pk = packets(records)
    parts = [pk.where(F.col("frame_number").between(1 + 40 * k, 40 + 40 * k)) for k in (0, 2, 3, 1)]
    times = lambda part: part.withColumn("ns", keystate.packet_time_ns()).orderBy("frame_number").collect()
    return parts, [times(part) for part in parts]


def test_gap_state_of_late_parts(spark, small_chunks, arriving, tmp_path):
    parts, rows = arriving
    updated = drain(spark, str(tmp_path), parts, keystate.start_gap_state)
    expected = folded_gaps([((r.flow_key, r.a_to_b), r.frame_number, r.ns) for part in rows for r in part], 300.0)
    found = {(r.flow_key, r.a_to_b): r.asDict() for r in keystate.current_gaps(spark, str(tmp_path)).collect()}
    assert {key: {name: row[name] for name in expected[key]} for key, row in found.items()} == expected
    assert sum(s["backward"] for s in expected.values()) > 2
    # only the keys of a batch are written
    assert updated == [[len({(r.flow_key, r.a_to_b) for r in part})] for part in rows]
    assert {r.backward for r in keystate.stream_backward_counts(spark, str(tmp_path)).collect()} == {
        s["backward"] for s in expected.values()}


def test_sequence_state_of_late_parts(spark, small_chunks, arriving, tmp_path):
    parts, rows = arriving
    drain(spark, str(tmp_path), parts, keystate.start_sequence_state)
    expected = folded_sequences([((r.flow_key, r.a_to_b, r.esp_spi), r.esp_sequence) for part in rows for r in part
                                 if r.esp_spi and r.esp_sequence is not None])
    found = {tuple(r)[:3]: tuple(r)[3:] for r in keystate.current_sequences(spark, str(tmp_path)).collect()}
    assert found == {key: (s["packets"], len(s["seen"]), s["out_of_order"], s["gap_missing"], max(s["seen"]))
                     for key, s in expected.items()}


def test_numbers_are_forgotten_after_their_time(spark, packets, tmp_path):
    part = packets([{"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "protocol": "ESP", "esp_spi": "0x1", "esp_sequence": 5}])
    drain(spark, str(tmp_path), [part, part], lambda s, folder: keystate.start_sequence_state(s, folder, keep_ms=1))
    (row,) = keystate.current_sequences(spark, str(tmp_path)).collect()
    assert (row.packets, row.distinct_sequences, row.highest_sequence) == (2, 2, 5)


def test_segments_join_end_to_end():
    rng = random.Random(2)
    for _ in range(200):
        times = [rng.choice([None, rng.randrange(5) * 200_000_000]) for _ in range(rng.randint(1, 12))]
        state, at = None, 0
        while at < len(times):
            part = times[at:at + rng.randint(1, 4)]
            ns, timed = np.array([t or 0 for t in part], np.int64), np.array([t is not None for t in part])
            state = keystate.append_segment(state, {
                "first_ns": int(ns[0]), "first_timed": bool(timed[0]), "last_frame": at + len(part) - 1,
                "last_ns": int(ns[-1]), "last_timed": bool(timed[-1]), **keystate.gap_segment(ns, timed, 300.0)}, 300.0)
            at += len(part)
        (plain,) = folded_gaps([("k", n, t) for n, t in enumerate(times)], 300.0).values()
        assert {n: state[n] for n in keystate.GAP_SUMS} == {n: plain[n] for n in keystate.GAP_SUMS}
        assert state["max_ns"] == (-1 if plain["max_ns"] is None else plain["max_ns"])


def test_runs_count_the_records_of_any_split():
    rng = random.Random(3)
    for _ in range(200):
        numbers = [rng.choice([n, n + 1, rng.randrange(30)]) for n in range(rng.randint(1, 25))]
        state, at = None, 0
        while at < len(numbers):
            part = numbers[at:at + rng.randint(1, 6)]
            for low, high in zip(*keystate.record_runs(np.array(part, np.int64))):
                state = keystate.append_runs(state, int(low), int(high))
            at += len(part)
        records = [n for k, n in enumerate(numbers) if n > max(numbers[:k], default=-1)]
        assert state == (numbers[0], max(numbers), len(records))


class Held(dict):
    """A map state that counts how often it is asked."""

    asked = 0

    def getValue(self, key):  # noqa: N802
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self[key] = value


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schema):  # noqa: N802
        return self.states.setdefault(name, Held())


def test_one_call_appends_the_segments_of_many_ways():
    rng = random.Random(4)
    processor, handle, rows, frame = keystate.GapState(300.0), Handle(), [], 0
    processor.init(handle)
    for _ in range(2):
        segments, chunks = [], rng.sample(range(3), 3)
        for flow in "abc":
            for chunk in range(3):
                times = [rng.choice([None, rng.randrange(5) * 200_000_000]) for _ in range(rng.randint(1, 4))]
                rows += [((flow, True), frame + n, t) for n, t in enumerate(times, 1)]
                frame += len(times)
                ns, timed = np.array([t or 0 for t in times], np.int64), np.array([t is not None for t in times])
                segments.append({
                    "flow_key": flow, "a_to_b": True, "chunk": chunk, "first_ns": ns[0], "first_timed": timed[0],
                    "last_frame": frame, "last_ns": ns[-1], "last_timed": timed[-1],
                    **keystate.gap_segment(ns, timed, 300.0)})
        segments.sort(key=lambda s: chunks[s["chunk"]])
        (touched,) = processor.handleInputRows((0,), iter([pd.DataFrame(segments[:4]), pd.DataFrame(segments[4:])]), None)
        assert sorted(touched["flow_key"]) == ["a", "b", "c"]
    held = handle.states["gaps"]
    found = {way: dict(zip(keystate._names(keystate.GAP_VALUE), value)) for way, value in held.items()}
    for way, plain in folded_gaps(rows, 300.0).items():
        assert {n: found[way][n] for n in (*keystate.GAP_SUMS, "last_frame")} == {
            n: plain[n] for n in (*keystate.GAP_SUMS, "last_frame")}
    assert held.asked == 2 * 2 * 3  # a read and a write of a way and batch


def test_record_runs_of_many_streams():
    rng = random.Random(5)
    for _ in range(50):
        streams = [[rng.choice([n, rng.randrange(30)]) for n in range(rng.randint(1, 20))] for _ in range(5)]
        numbers = np.concatenate([np.array(s, np.int64) for s in streams])
        keys = np.repeat(np.arange(5), [len(s) for s in streams])
        first, last = keystate.record_places(numbers, keys)
        found = list(zip(keys[first].tolist(), numbers[first].tolist(), numbers[last].tolist()))
        assert found == [(k, int(low), int(high)) for k, s in enumerate(streams)
                         for low, high in zip(*keystate.record_runs(np.array(s, np.int64)))]
