"""Step maps, their composition, and successors inside a chunk, against plain loops."""

import random

import numpy as np

from packetloom.operators import chains, folds


def unroll(numbers):
    out, high = [], None
    for number in numbers:
        value = number if high is None else high + (number - high + folds.HALF) % folds.SPACE - folds.HALF
        high = value if high is None else max(high, value)
        out.append(value)
    return out


def series(rng, size):
    kind, at, out = rng.choice(["calm", "wild", "down", "mixed"]), rng.randrange(65536), []
    for _ in range(size):
        step = kind if kind != "mixed" else rng.choice(["calm", "calm", "calm", "wild", "down"])
        at = {"calm": at + rng.randint(-3, 9), "wild": rng.randrange(65536),
              "down": at - rng.choice([20000, 32768, 32767, 5])}[step] % 65536
        out.append(at)
    return out


def test_falls_are_found_for_every_start():
    rng = random.Random(1)
    for _ in range(150):
        x = folds.unrolled(np.array(series(rng, rng.randint(1, 40)), np.int64))
        expected = []
        for start in range(len(x)):
            top, at = x[start], start + 1
            while at < len(x) and x[at] >= top - folds.HALF:
                top, at = max(top, x[at]), at + 1
            expected.append(at)
        assert folds.falls_after(x).tolist() == expected


def test_maps_of_any_split_lead_to_the_same_falls():
    rng = random.Random(2)
    for _ in range(150):
        numbers = series(rng, rng.randint(1, 60))
        x = folds.unrolled(np.array(numbers, np.int64)) + numbers[0]
        cuts = sorted({0, len(x), *[rng.randrange(len(x)) for _ in range(rng.randrange(8))]})
        parts = [x[a:b] for a, b in zip(cuts, cuts[1:])]
        state, count, falls, whole = chains.LOW, 0, [], None
        for start, part in zip(cuts, parts):
            found = folds.sequence_map(part)
            falls += (start + folds.sequence_falls(part, state)).tolist()
            state, more = found.follow(state)
            count += more
            whole = found if whole is None else whole.then(found)
            assert whole.follow(chains.LOW) == (state, count)
        assert count == len(falls)
        lifted = x + folds.SPACE * np.searchsorted(falls, np.arange(len(x)), side="right")
        assert lifted.tolist() == unroll(numbers)


def test_maps_compose_for_every_entry():
    rng = random.Random(3)
    for _ in range(60):
        numbers = series(rng, rng.randint(2, 12))
        x = folds.unrolled(np.array(numbers, np.int64))
        cut = rng.randrange(1, len(x))
        first, second = folds.sequence_map(x[:cut]), folds.sequence_map(x[cut:])
        both = first.then(second)
        assert both.low[0] == chains.LOW and both.high[-1] == chains.HIGH
        assert (both.low[1:] == both.high[:-1] + 1).all()
        for entry in [chains.LOW, *[rng.randint(-32767, 65536) for _ in range(40)]]:
            state, count = first.follow(entry)
            state, more = second.follow(state)
            assert both.follow(entry) == (state, count + more)


def test_window_maps():
    rng = random.Random(4)
    for _ in range(100):
        at = np.array(sorted(rng.sample(range(6000), rng.randint(1, 40))), np.int64)
        found = folds.window_map(at)
        for entry in (0, *[rng.randrange(7000) for _ in range(20)]):
            end, count = entry, 0
            for p in at.tolist():
                if p >= end:
                    end, count = max(0, p - 100) + 1000, count + 1
            assert found.follow(entry) == (end, count)
