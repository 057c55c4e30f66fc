"""Texts as flat byte arrays: what the vectorised operators share.

A batch of texts becomes one buffer with a zero byte after each text, so that nothing that is cut out of
the buffer reaches over two texts unseen. All array work is done on slices of a bounded number of bytes;
only a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_seed = np.random.default_rng(20240607)
#: A random number per byte value, and the odd bases of two polynomial hashes modulo 2^64.
BYTE_VALUES = _seed.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE_1, BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are not part of a word: zero (the end of a text) and white space.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (the finaliser of a 64-bit generator)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < count:
        size = max(count, 1 << 12)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        _powers[int(base)] = have
    return have[:count]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column with about `limit` bytes each; one row at least."""
    sizes = byte_lengths(column)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, row
            start, held = row, 0
        held += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes per text; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_bytes(column: pa.Array) -> pa.Array:
    """The column as large binary values, null as empty."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a zero byte after each, and where each text starts (and one more)."""
    values = as_bytes(column)
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return spaced(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that lie end to end, moved apart by a zero byte after each."""
    rows = len(offsets) - 1
    starts = offsets + np.arange(rows + 1)
    out = np.zeros(int(starts[-1]), np.uint8)
    held = np.ones(len(out), bool)
    held[starts[1:] - 1] = False
    out[held] = data
    return out, starts


def word_spans(buffer: np.ndarray, starts: np.ndarray, blank: np.ndarray = BLANK
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a flat buffer, and the text it belongs to.

    A zero byte inside a text is a word byte unless `blank` says otherwise; the one after it is not.
    """
    edge = np.empty(len(buffer) + 1, bool)
    edge[0] = False
    inside = edge[1:]
    np.logical_not(blank[buffer], out=inside)
    inside[starts[1:] - 1] = False
    change = np.flatnonzero(edge[1:] != edge[:-1])
    begin, end = change[0::2], change[1::2]
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def word_hashes(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64 = BASE_1,
                values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A polynomial hash of the bytes of each word, by prefix sums over the buffer."""
    if not len(begin):
        return np.empty(0, np.uint64)
    length = end - begin
    total = int(length.sum())
    first = np.cumsum(length) - length
    within = np.arange(total) - np.repeat(first, length)
    at = within + np.repeat(begin, length)
    terms = values[buffer[at]] * powers(base, int(length.max()))[within]
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def rolling(items: np.ndarray, width: int, base: np.uint64 = BASE_1) -> np.ndarray:
    """Rabin-Karp hash of every `width` consecutive items: one prefix sum, then one product each."""
    if len(items) < width:
        return np.empty(0, np.uint64)
    weight = powers(base, len(items))
    total = np.empty(len(items) + 1, np.uint64)
    total[0] = 0
    np.cumsum(items * weight, out=total[1:])
    found = total[width:] - total[:-width]
    found *= powers(inverse(base), len(items))[:len(found)]
    return mix(found)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def limited_broadcast(keys: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A table of short keys with a join hint: broadcast up to `most_rows` rows, else sort-merge."""
    return F.broadcast(keys) if keys.limit(most_rows + 1).count() <= most_rows else keys.hint("merge")
