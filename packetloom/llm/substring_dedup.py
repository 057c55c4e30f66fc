"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted over the corpus.

Every window of `width` words of every document is hashed. A window whose words also start in a document
with a smaller id is removed from the text; overlapping windows merge into maximal intervals.

Counting all windows would shuffle a hash per word. So the windows are counted in two steps that lose none:

1. The windows are counted by their *least half hash*: the least of the hashes of the half-width windows
   inside. Equal windows have the same one, and some thirteen neighbours in a row share it. A half hash
   that only one document holds clears all its windows: they occur once.
2. The other windows are counted by 96 bits of two Rabin-Karp hashes, with the least id that holds each.

Both counts go through `units.ask`: each unit of texts sends a hash once, whoever holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packetloom.llm import units
from packetloom.llm.texts import BASE_2, mix, rolling, sliding_min, word_hashes, word_spans

FIELDS = ("doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, "
          "kept_text string")


class _Windows:
    """The windows of a unit: words, the window starts inside one text, and the count keys of each."""

    def __init__(self, unit: units.Unit, width: int):
        self.unit, self.width = unit, width
        self.begin, self.end, self.text = word_spans(unit.buffer, unit.starts)
        self.hashes = word_hashes(unit.buffer, self.begin, self.end)
        half = max(1, width // 2)
        least = sliding_min(rolling(self.hashes, half), width - half + 1)
        self.at = np.flatnonzero(self.text[:len(least)] == self.text[len(self.text) - len(least):])
        self.keys = mix(least[self.at])  # a least hash is small; buckets are ranges
        self.owner = unit.ids[self.text[self.at]]

    def shared(self, answers: list | None, buckets: int) -> None:
        """Keep only the windows whose least half hash two documents hold."""
        distinct, twice = units.own_shared(self.keys, self.owner)
        both = twice | units.marked(answers, distinct, buckets)
        keep = both[np.searchsorted(distinct, self.keys)] if len(distinct) else np.empty(0, bool)
        self.at, self.owner = self.at[keep], self.owner[keep]
        first = rolling(self.hashes, self.width)[self.at]
        second = (rolling(self.hashes, self.width, BASE_2)[self.at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.owner, second, first))
        first, second = first[order], second[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[:len(first)]
        self.first, self.second = first[new], second[new]
        self.least_id = self.owner[order][new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def removed(self, answers: list | None, buckets: int) -> np.ndarray:
        """Which words a repeated window covers."""
        elsewhere = units.marked(answers, self.first, buckets)
        repeated = elsewhere[self.group] | (self.owner > self.least_id[self.group])
        steps = np.zeros(len(self.begin) + 1, np.int64)
        np.add.at(steps, self.at[repeated], 1)
        np.add.at(steps, self.at[repeated] + self.width, -1)
        return np.cumsum(steps)[:-1] > 0


def _rows(unit: units.Unit, windows: _Windows, gone: np.ndarray) -> pa.RecordBatch:
    """One row per text: what was removed, and the kept words joined by one space."""
    rows = len(unit.ids)
    words = np.bincount(windows.text, minlength=rows)
    lost = np.bincount(windows.text[gone], minlength=rows)
    begin, end, text = (x[~gone] for x in (windows.begin, windows.end, windows.text))
    length = end - begin + 1
    first = np.cumsum(length) - length
    total = int(length.sum())
    at = np.arange(total) - np.repeat(first - begin, length)
    out = unit.buffer[np.minimum(at, len(unit.buffer) - 1)] if total else np.empty(0, np.uint8)
    out[first + length - 1] = 0x20
    size = np.zeros(rows, np.int64)
    np.add.at(size, text, length)
    ends = np.cumsum(size)
    held = out.tobytes()
    kept = [held[e - s:e - 1] if s else b"" for s, e in zip(size.tolist(), ends.tolist())]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans: list[list[dict]] = [[] for _ in range(rows)]
    base = np.searchsorted(windows.text, np.arange(rows))
    for start, stop in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        while start < stop:  # a run of removed words may reach into the next text
            row = int(windows.text[start])
            upto = min(stop, int(base[row] + words[row]))
            spans[row].append({"start": start - int(base[row]), "end": upto - int(base[row])})
            start = upto
    return pa.RecordBatch.from_arrays(
        [pa.array(unit.ids, mask=unit.ids == units.NO_ID), pa.array(words.astype(np.int64)),
         pa.array(lost.astype(np.int64)),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array(kept, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "n_removed", "removed", "kept_text"])


def remove_repeated_windows(docs: DataFrame, width: int = 50, unit_bytes: int = 1 << 20) -> DataFrame:
    """One row per document of `docs` (doc_id, text; other columns are not looked at).

    `n_words` counts the words (runs without the six ASCII white-space characters), `n_removed` those
    removed, `removed` lists the maximal removed intervals in words, `kept_text` holds the rest joined by
    one space. A null or empty text has no words; a text of fewer than `width` words keeps all; equal texts
    keep the copy with the smallest id; rows with one and the same id never remove from each other; a null
    id counts as larger than all others. An empty table gives no rows.
    """
    packed = units.make_units(docs, unit_bytes)
    buckets = units.bucket_count(docs)

    def halves(unit: units.Unit) -> Iterator[tuple[int, int, int, bytes]]:
        windows = _Windows(unit, width)
        distinct, _ = units.own_shared(windows.keys, windows.owner)
        return units.send_shared(unit.number, distinct, buckets)

    def whole(unit: units.Unit, shared: list | None) -> Iterator[tuple[int, int, int, bytes]]:
        windows = _Windows(unit, width)
        windows.shared(shared, buckets)
        return units.entries(unit.number, windows.first, buckets, lambda i, j: units.smaller_id_entry(
            windows.first[i:j], windows.second[i:j], windows.least_id[i:j]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, shared, repeated in units.opened(batches):
            windows = _Windows(unit, width)
            windows.shared(shared, buckets)
            yield _rows(unit, windows, windows.removed(repeated, buckets))

    shared = units.ask(packed, halves, units.reply_shared)
    asked = units.attach(packed, shared, "answers_shared")
    repeated = units.ask(asked, whole, units.reply_smaller_id)
    return units.attach(asked, repeated, "answers_repeated").mapInArrow(cut, FIELDS)
