"""Secret scans: patterns, and structural confirmation of encoded keys and signed tokens.

The base patterns report by form alone. Beyond them, base64 and hex candidates are decoded and reported only
if what they hold parses: DER private keys whose nested lengths fill each other exactly, OpenSSH keys with
their length-prefixed fields, armoured key blocks around such a key, base64 or hex of such blocks, and tokens of
three parts whose header names an algorithm that the signature's size agrees with. Encoded keys may be broken
into lines, by real or escaped line ends, with indents, quoted or as strings that are put together; the lengths
in a key say where it ends. A private key has at most 64 kB (`key_formats.MOST_KEY_BYTES`).

Candidates are found in the flat UTF-8 bytes of many texts at once; all patterns are ASCII, so byte matches
are the character matches. Positions are turned into code points where something was found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.key_formats import MOST_KEY_BYTES, decoded, key_blob, key_size, signed_token
from packetloom.llm.texts import flat, text_slices

#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "derhex", "token")
BASE = KINDS[:3]
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ARMOUR = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----BEGIN )[^\x00])*?)-----END \1-----")
ARMOUR_HEADER = re.compile(rb"\A\s*(?:[A-Za-z-]+: [^\n]*\n)+")
#: What stands between the lines of an encoded key: line ends, escaped or not, indents, marks of quotes and
#: comments, ends and starts of strings that are put together; and a backslash before a slash.
BETWEEN = rb"""["']\s{0,64}\+?\s{0,64}["']|\\+[nrt]|[\s>#]|\\+(?=[\s/])"""
GAP = re.compile(rb"(?:" + BETWEEN + rb")+")
ESCAPED_END, PADDING, JUNK = re.compile(rb"\\+[nr]"), re.compile(rb"\\+u003[dD]"), re.compile(BETWEEN + rb"""|["'\\]""")
MIN_ENCODED = 40
PEM = b"-----BEGIN "
SPANS = "array<struct<kind:string,start:long,end:long,detail:string>>"


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_letters = bytes(range(65, 91)) + bytes(range(97, 123)) + b"0123456789"
LOWER_HEX, HEX = _class(b"0123456789abcdef"), _class(b"0123456789abcdefABCDEF")
BASE64, TOKEN_PART = _class(_letters + b"+/-_"), _class(_letters + b"-_")


def runs(buffer: np.ndarray, table: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of bytes of a class, of `least` bytes or more."""
    inside = np.zeros(len(buffer) + 2, bool)
    inside[1:-1] = table[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= least
    return zip(begin[long].tolist(), end[long].tolist())


def armoured(data: bytes) -> Iterator[tuple[int, int, str]]:
    """Armoured key blocks that hold a key, as (start, end, detail)."""
    for m in ARMOUR.finditer(data) if PEM in data else ():
        body = ARMOUR_HEADER.sub(b"", PADDING.sub(b"=", ESCAPED_END.sub(b"\n", m[2])))
        held = decoded(JUNK.sub(b"", body))
        legacy = b"DEK-Info:" in m[2] and held is not None and len(held) >= 32
        detail = key_blob(held) or ("encrypted" if legacy else None)
        if detail:
            yield m.start(), m.end(), detail


class Stretch:
    """Lines of encoded characters that follow one another, joined once, and where each of them stands."""

    def __init__(self, data: bytes, pieces: list[tuple[int, int]]):
        self.starts = [a for a, _ in pieces]
        self.offsets = list(accumulate((b - a for a, b in pieces), initial=0))
        self.text = b"".join([data[a:b] for a, b in pieces])

    def place(self, at: int) -> int:
        """Where a byte of the data stands in the joined text."""
        piece = bisect_right(self.starts, at) - 1
        return self.offsets[piece] + at - self.starts[piece]

    def end(self, upto: int) -> int:
        """Where the data go on after so many joined characters."""
        piece = bisect_right(self.offsets, upto - 1) - 1
        return self.starts[piece] + upto - self.offsets[piece]


class Encoding:
    """A way to write bytes as text: how keys start in it, its characters, and how many of them `size` bytes take.

    Every stretch is joined once. What a key announces is read at its place in the joined text, a few bytes at
    a time, and only what nests is decoded whole, so that the time follows the text, whatever it announces.
    """

    def __init__(self, kind: str, heads: bytes, pem_heads: bytes, chunk: bytes, before: np.ndarray, decode, length,
                 group: tuple[int, int], least: int):
        self.kind, self.heads, self.pem_heads, self.chunk = kind, re.compile(heads), re.compile(pem_heads), re.compile(chunk)
        self.before, self.decode, self.length, self.least = before, decode, length, least
        self.characters, self.bytes = group

    def stretches(self, data: bytes, heads: list[int]) -> Iterator[tuple[Stretch, list[int]]]:
        """Stretches with the heads inside them."""
        at, known = 0, 0
        while known < len(heads):
            at = heads[known]
            pieces = []
            while m := self.chunk.match(data, at):
                pieces.append((at, m.end()))
                if not (gap := GAP.match(data, m.end())):
                    break
                at = gap.end()
            if not pieces:
                known += 1
                continue
            upto = bisect_left(heads, pieces[-1][1], known)
            inside = [h for h in heads[known:upto] if any_piece(pieces, h)]
            yield Stretch(data, pieces), inside
            known = max(upto, known + 1)

    def keys(self, data: bytes) -> Iterator[tuple[int, int, str, str]]:
        def alone(start: int) -> bool:
            return not (start and self.before[data[start - 1]] and data[start - 5:start] != b"-----"
                        and not (data[start - 2:start - 1] == b"\\" and data[start - 1] in b"nrt"))

        pems = {m.start() for m in self.pem_heads.finditer(data)}
        heads = sorted({m.start() for m in self.heads.finditer(data)} | pems)
        for stretch, inside in self.stretches(data, [h for h in heads if alone(h)]):
            done, looked = 0, set()
            for start in inside:
                if start < done:
                    continue
                at = stretch.place(start)
                if start in pems:
                    if at % self.characters in looked:
                        continue
                    looked.add(at % self.characters)
                    found = self.armour(data, stretch, at)
                else:
                    found = self.key(data, stretch, at)
                if found:
                    done = found[1]
                    yield found

    def key(self, data: bytes, stretch: Stretch, at: int) -> tuple[int, int, str, str] | None:
        """The key that is written from a place on, as (start, end, kind, detail)."""
        def read(offset: int, count: int) -> bytes:
            first = at + offset // self.bytes * self.characters
            text = stretch.text[first:first + -(-(offset % self.bytes + count) // self.bytes) * self.characters]
            held = self.decode(text) or self.decode(text[:-1]) or b""
            return held[offset % self.bytes:offset % self.bytes + count]

        size = key_size(read)
        if size is None or size > MOST_KEY_BYTES:
            return None
        upto = at + self.length(size)
        if upto > len(stretch.text) or self.length(size) < self.least:
            return None
        end = stretch.end(upto)
        if self.chunk.match(data, end):
            return None
        detail = key_blob(self.decode(stretch.text[at:upto]))
        return (stretch.end(at + 1) - 1, self.padded(data, end), self.kind, detail) if detail else None

    def armour(self, data: bytes, stretch: Stretch, at: int) -> tuple[int, int, str, str] | None:
        """Armoured blocks in what a stretch holds from a place on, up to the last with a key; looked at once for all
        heads of one alignment."""
        text = stretch.text[at:]
        held = self.decode(text) or self.decode(text[:-1]) or b""
        blocks = list(armoured(held))
        if not blocks:
            return None
        start = stretch.end(at + 1) - 1
        end = stretch.end(min(len(stretch.text), at + self.length(blocks[-1][1])))
        rest = self.chunk.match(data, end)
        return start, self.padded(data, rest.end() if rest else end), "pem", blocks[0][2]

    @staticmethod
    def padded(data: bytes, end: int) -> int:
        while end < len(data) and data[end] == 0x3D:
            end += 1
        return end


def any_piece(pieces: list[tuple[int, int]], at: int) -> bool:
    piece = bisect_right(pieces, (at, 1 << 62)) - 1
    return piece >= 0 and pieces[piece][0] <= at < pieces[piece][1]


ENCODINGS = (
    Encoding("der", rb"M[A-P]|b3BlbnNzaC1r", rb"LS0tLS1CRUdJTi", rb"(?:[A-Za-z0-9+/_]|-(?!----))+", BASE64, decoded,
             lambda size: (size * 4 + 2) // 3, (4, 3), MIN_ENCODED),
    Encoding("derhex", rb"30(?=[0-9A-Fa-f]{4})|6[fF]70656[eE]7373", rb"2[dD]2[dD]2[dD]2[dD]2[dD]42", rb"[0-9A-Fa-f]+", HEX,
             lambda text: bytes.fromhex(text[:len(text) // 2 * 2].decode()), lambda size: 2 * size, (2, 1), 2 * MIN_ENCODED))


def find(buffer: np.ndarray) -> Iterator[tuple[int, int, str, str | None]]:
    """Spans of a flat buffer as (start, end, kind, detail), in bytes."""
    data = buffer.tobytes()
    for m in ASSIGN.finditer(data):
        if m.end(2) - m.start(2) >= 8:
            yield m.start(), m.end(), "assign", None
    for m in ACCESS.finditer(data):
        if m.end() - m.start() >= 16:
            yield m.start(), m.end(), "access", None
    for start, end in runs(buffer, LOWER_HEX, 32):
        yield start, end, "hex", None
    for start, end, detail in armoured(data):
        yield start, end, "pem", detail
    for encoding in ENCODINGS:
        yield from encoding.keys(data)
    for start, end in runs(buffer, TOKEN_PART, 12):
        if data[start:start + 2] == b"ey" and data[end:end + 1] == b".":
            parts, at = [data[start:end]], end
            while len(parts) < 3 and data[at:at + 1] == b".":
                stop = at + 1
                while TOKEN_PART[data[stop]]:
                    stop += 1
                parts.append(data[at + 1:stop])
                at = stop
            detail = signed_token(*parts) if len(parts) == 3 else None
            if detail:
                yield start, at, "token", detail


def text_spans(column: pa.Array) -> list[list[tuple[int, int, str, str | None]]]:
    """For each text its spans as (start, end, kind, detail), in code points, by start, then kind."""
    buffer, starts = flat(column)
    out: list[list] = [[] for _ in range(len(starts) - 1)]
    found = list(find(buffer))
    if found:
        points = np.append(0, np.cumsum((buffer & 0xC0) != 0x80))
        rows = np.searchsorted(starts, [f[0] for f in found], side="right") - 1
        for row, (start, end, kind, detail) in zip(rows.tolist(), found):
            first = points[starts[row]]
            out[row].append((int(points[start] - first), int(points[end] - first), kind, detail))
        for row in set(rows.tolist()):
            out[row].sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per document of `docs` (doc_id, text) with its spans, by start, then kind as in KINDS.

    A null text counts as empty and has no spans; a null or repeated doc_id is kept as it is; other columns are
    not looked at; an empty table gives no rows. Texts are scanned whole.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("detail", pa.string())]))
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                spans = [[{"kind": k, "start": a, "end": b, "detail": d} for a, b, k, d in one]
                         for one in text_spans(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(search, f"doc_id long, spans {SPANS}")


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by `mark` (overlapping ones by one), all columns kept.

    Texts without spans stay as they are, nulls too.
    """
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(at)):
                part = batch.slice(first, last - first)
                found = text_spans(part.column(at))
                if any(found):
                    texts = part.column(at).to_pylist()
                    for row, spans in enumerate(found):
                        if spans:
                            texts[row] = _replaced(texts[row], spans, mark)
                    columns = part.columns
                    columns[at] = pa.array(texts, columns[at].type)
                    part = pa.RecordBatch.from_arrays(columns, part.schema.names)
                yield part

    return docs.mapInArrow(replace, docs.schema)


def _replaced(text: str, spans: list[tuple[int, int, str, str | None]], mark: str) -> str:
    out, upto = [], 0
    for start, end, *_ in spans:
        if start >= upto:
            out += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])
