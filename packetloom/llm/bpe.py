"""BPE encoding and decoding with a byte-level tokenizer file; long unsplit text by tree concatenation.

Ids equal those of the `tokenizers` library with the same file. Text is first cut into chunks at places that
every scan of the tokenizer's pattern stops at (between a character that is not white space and white space,
and around single line ends); chunks repeat, so their ids are kept in a bounded table.

*Tree concatenation.* A word without a break that is longer than a leaf is encoded in halves, down to the
leaf size, and the halves are joined: the tokens around a join are encoded anew in a growing window until
the pair of tokens at either edge of the window is one that the encoder itself makes; then all of the joined
tokens are what the whole would give. Texts above `split_chars` are cut into segments that Spark encodes as
separate rows, in parallel, and are joined the same way, first for the words around a cut, then for tokens
within a word that a cut went through.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.texts import text_slices
from packetloom.settings import settle

SPLIT_CHARS = 1 << 16
LEAF_BYTES = 256
TABLE_SIZE = 100_000
# The White_Space characters, as the tokenizer's pattern sees them.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
UNUSUAL = re.compile(f"[\x00{SPACE.replace(' ', '').replace(chr(10), '')}\x1c-\x1f]")
#: Characters whose classes no Unicode version changes.
SETTLED = re.compile("[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")
ONE_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
FIELDS = "doc_id long, n_tokens long, ids array<int>, decoded string"


class Bpe:
    """An encoder and decoder in memory, made from the text of a tokenizer file."""

    def __init__(self, text: str, leaf_bytes: int = LEAF_BYTES, table_size: int = TABLE_SIZE):
        import tiktoken
        from tokenizers import Tokenizer

        said = json.loads(text)
        said["truncation"] = said["padding"] = None
        self.library = Tokenizer.from_str(json.dumps(said))
        self.special = {x["content"]: x["id"] for x in said.get("added_tokens", ())}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        values = {c: b for b, c in _byte_letters().items()}
        vocabulary = {bytes(values[c] for c in token): i for token, i in said["model"]["vocab"].items()
                      if token not in self.special}
        self.code = "H" if len(said["model"]["vocab"]) + len(self.special) < 1 << 16 else "I"
        self.kind = np.dtype(self.code).type
        self.leaf_bytes = leaf_bytes
        self.pieces = tiktoken.Encoding(
            "file", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks=vocabulary, special_tokens={})
        self._check(said, vocabulary)
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        parts: list[bytes] = [b""] * size
        for token, i in [*vocabulary.items(), *((s.encode(), i) for s, i in self.special.items())]:
            parts[i] = token
        self.parts = parts
        self.part_size = np.array([len(p) for p in parts], np.int64)
        self.part_start = np.cumsum(self.part_size) - self.part_size
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.table = _Table(self, table_size)

    def _check(self, said: dict, vocabulary: dict[bytes, int]) -> None:
        """Ids must follow the order of the merges: then merging by lowest id is merging by rank."""
        letters = {c: b for b, c in _byte_letters().items()}
        before = -1
        for merge in said["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocabulary[bytes(letters[c] for c in a + b)]
            if made <= before:
                raise ValueError("the vocabulary's ids do not follow its merges")
            before = made
        if said.get("normalizer") or said["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level tokenizer")

    # Encoding ---------------------------------------------------------------------------------------

    def packed(self, text: str) -> bytes:
        """The ids of a text as numbers of `kind`, end to end."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(
                self.kind(self.special[part]).tobytes() if part in self.special else self._plain(part)
                for part in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, chunks(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.kind).tolist()

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk that is not in the table."""
        if len(chunk) <= self.leaf_bytes:
            if ONE_WORD.fullmatch(chunk):
                return self.pieces._encode_single_piece(chunk)
            if SETTLED.fullmatch(chunk):
                return self.pieces.encode_ordinary(chunk)
            return self.library.encode(chunk, add_special_tokens=False).ids
        return [i for word in self.words(chunk) for i in self.word(word)]

    def words(self, text: str) -> list[str]:
        """The words that the tokenizer's pattern makes of a text."""
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word(self, word: str) -> list[int]:
        return self.tree(word.encode())

    def tree(self, data: bytes) -> list[int]:
        """The ids of one word: halves encoded apart, then joined."""
        if len(data) <= self.leaf_bytes:
            return self.pieces._encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a word from those of its two parts, by windows that grow around the join."""
        size = 2
        while True:
            a, b = left[-size:], right[:size]
            window = self.pieces._encode_single_piece(b"".join(self.parts[i] for i in a + b))
            if ((size >= len(left) or self.agree(left[-size - 1], window[0]))
                    and (size >= len(right) or self.agree(window[-1], right[size]))):
                return left[:-size] + window + right[size:]
            size *= 2

    def agree(self, a: int, b: int) -> bool:
        """Would the encoder leave these two tokens side by side?"""
        return self.pieces._encode_single_piece(self.parts[a] + self.parts[b]) == [a, b]

    # Segments of a long text ------------------------------------------------------------------------

    def segment(self, text: str) -> list[tuple[str, list[int]]]:
        """The words of a segment with their ids; a special token is a word of its own."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((part, [self.special[part]]))
            else:
                out += [(w, np.frombuffer(self.table[w], self.kind).tolist() if len(w) <= self.leaf_bytes
                         and SETTLED.fullmatch(w) else self.word(w)) for w in self.words(part)]
        return out

    def join_segments(self, left: list[tuple[str, list[int]]], right: list[tuple[str, list[int]]]
                      ) -> list[tuple[str, list[int]]]:
        """The words of two neighbouring segments, scanned anew from before the cut until a scan of the
        right one stops at the same place; a word that only grew at the cut is joined, not encoded."""
        if not left or not right:
            return left or right
        longest = max([len(s) for s in self.special], default=0)
        back = 3
        while back < len(left) and sum(len(w) for w, _ in left[-back:]) < longest + 3:
            back += 1
        back, ahead = min(back, len(left)), 3
        kept, tail = left[:-back], left[-back:]
        head = "".join(w for w, _ in tail)
        while True:
            near = right[:ahead]
            whole = ahead >= len(right)
            text = head + "".join(w for w, _ in near)
            stops, at = {}, len(head)
            for k, (word, _) in enumerate(near):
                stops[at] = k
                at += len(word)
            spans, at = [], 0
            for part in self.cut.split(text) if self.cut else [text]:
                words = [part] if part in self.special else self.words(part)
                for word in words:
                    spans.append((at, word))
                    at += len(word)
            # The last words of the window may have been cut short by its end.
            sure = len(spans) if whole else len(spans) - 3
            limit = len(text) if whole else len(text) - longest - 3
            for n, (start, _) in enumerate(spans[:max(0, sure)]):
                if start in stops and start <= limit and (n or start):
                    return kept + self._again(spans[:n], tail, right) + right[stops[start]:]
            if whole:
                return kept + self._again(spans, tail, right)
            ahead *= 2

    def _again(self, spans: list[tuple[int, str]], tail: list, right: list) -> list[tuple[str, list[int]]]:
        known = dict(tail)
        grown = tail[-1][0] + right[0][0]
        return [(w, known[w] if w in known else self.join(tail[-1][1], right[0][1])
                 if w == grown and not {tail[-1][0], right[0][0]} & set(self.special)
                 else [self.special[w]] if w in self.special else self.word(w)) for _, w in spans]

    # Decoding ---------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included."""
        size = self.part_size[ids]
        first = np.cumsum(size) - size
        return self.part_bytes[np.arange(int(size.sum())) + np.repeat(self.part_start[ids] - first, size)].tobytes()


class _Table(dict):
    """Ids of chunks seen lately, in two generations: when the young one is full it becomes the old one, and
    chunks met again move back."""

    def __init__(self, bpe: Bpe, size: int):
        super().__init__()
        self.bpe, self.size = bpe, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = array(self.bpe.code, self.bpe.chunk(chunk)).tobytes() if chunk else b""
        if len(chunk) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def chunks(text: str) -> list[str]:
    """Text cut where the tokenizer's pattern always stops."""
    if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or UNUSUAL.search(text)):
        return CHUNK.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


_made: dict[tuple[int, int], Bpe] = {}


def in_worker(text: str) -> Bpe:
    """The encoder of a tokenizer file, made once per Python worker."""
    key = hash(text), len(text)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(text)
    return _made[key]


def tokenizer_file(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The text of a tokenizer file (byte_bpe_50k.json of the public tokenizers by default), broadcast:
    a vocabulary has a fixed size, and executors need no file of their own."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _id_lists(packed: list[bytes], kind: type) -> tuple[pa.Array, pa.Array, np.ndarray]:
    size = np.array([len(p) for p in packed], np.int64) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(packed), kind).astype(np.int32)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), flat


def encode(docs: DataFrame, tokenizer: Broadcast, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """One row per document of `docs` (doc_id, text): its number of tokens, its ids, and their decoded text.

    A null text is encoded as an empty one, which has no ids; a null or repeated doc_id is kept as it is. A
    special token's text becomes its id, as in the library. Other columns are not looked at; an empty table
    gives no rows.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = in_worker(tokenizer.value)
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                yield _rows(bpe, part.column(0), [bpe.packed(t) for t in part.column(1).to_pylist()])

    size = F.length("text")
    long = settle(picked.where(size > split_chars).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    pieces = (long.select("row", "doc_id", F.explode(F.sequence(
        F.lit(0), F.floor((size - 1) / split_chars))).alias("segment"), "text")
        .select("row", "doc_id", "segment", F.substr(
            "text", (F.col("segment") * split_chars + 1).cast("int"), F.lit(split_chars)).alias("text"))
        .repartition("row", "segment"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = in_worker(tokenizer.value)
        for batch in batches:
            for k in range(batch.num_rows):
                words = bpe.segment(batch.column(3)[k].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1),
                     pa.array([[w for w, _ in words]]), pa.array([[i for _, i in words]], pa.list_(pa.list_(pa.int32())))],
                    ["row", "doc_id", "segment", "words", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        bpe = in_worker(tokenizer.value)
        parts = [list(zip(x["words"], x["ids"])) for x in table.sort_by("segment").to_pylist()]
        while len(parts) > 1:
            parts = [bpe.join_segments(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k]
                     for k in range(0, len(parts), 2)]
        packed = np.array([i for _, ids in parts[0] for i in ids], bpe.kind).tobytes()
        return pa.Table.from_batches([_rows(bpe, table["doc_id"].slice(0, 1).combine_chunks(), [packed])])

    whole = (pieces.mapInArrow(segments, "row long, doc_id long, segment long, words array<string>, ids array<array<int>>")
             .groupBy("row").applyInArrow(joined, FIELDS))
    return picked.where(size <= split_chars).mapInArrow(short, FIELDS).unionByName(whole)


def _rows(bpe: Bpe, ids: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
    size, lists, flat = _id_lists(packed, bpe.kind)
    data, sizes = bpe.decode(flat), bpe.part_size[flat]
    ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(size.to_numpy()))].tolist()
    texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
    return pa.RecordBatch.from_arrays([ids, size, lists, pa.array(texts, pa.string())],
                                      ["doc_id", "n_tokens", "ids", "decoded"])
