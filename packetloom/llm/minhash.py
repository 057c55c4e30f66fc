"""Near-duplicates by ProbMinHash over word shingles weighted by how often a text has them.

Every shingle of a text starts a Poisson process whose rate is its weight; each arrival falls on a random
register, and a register keeps the shingle whose arrival comes first. Two texts agree in a register with the
probability Jaccard similarity of their weighted shingles. Arrivals are made in rounds for many texts at once,
and a shingle stops as soon as its next arrival is later than the latest register of its text.

Equal texts are one *node*. Bands of registers are hashed; nodes with a common band hash form a
bucket. No bucket is expanded into pairs. Instead

1. every member of a bucket is verified against one pivot, drawn by hash from the bucket;
2. the components of the verified links are found;
3. only in buckets that still hold several components, members outside the pivot's component are compared
   with the others, in blocks of bounded size: by their registers, and exactly where those leave it open. Buckets
   of one component that overlap are compared as one, so that a text is sent once and not for every band.

Two nodes of one bucket are either in one component after step 2 or compared in step 3, so no link between
texts that share a bucket is lost. Verification computes the exact probability Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.components import components
from packetloom.llm.texts import BASE_1, BASE_2, as_bytes, flat, limited_broadcast, mix, text_slices, word_hashes, word_spans
from packetloom.settings import discard, settle

SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 32, 5
REGISTERS = BANDS * BAND_ROWS
#: Five standard errors below the threshold: what the registers rate lower is not verified.
SURELY_LESS = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
BLOCK = 1024
#: Buckets of one component are merged if together they hold at most so many times the texts of the largest.
OVERLAP = 4
STORED = "row long, doc_id long, node binary, bands array<long>, registers binary"


class Shingles:
    """The distinct shingles of each text of a flat buffer with their weights."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, width: int = SHINGLE):
        begin, end, text = word_spans(buffer, starts)
        hashes = word_hashes(buffer, begin, end)
        self.rows = len(starts) - 1
        first = np.searchsorted(text, np.arange(self.rows + 1))
        count = np.diff(first)
        # A window starts at every word that has `width` words of its text from there on; a shorter text is one.
        size = np.minimum(count, width)[text]
        within = np.arange(len(text)) - first[text]
        starting = within + size <= count[text]
        at, size = np.flatnonzero(starting), size[starting]
        made = mix(size.astype(np.uint64))
        for k in range(width):
            there = k < size
            part = hashes[np.minimum(at + k, len(hashes) - 1)]
            made = np.where(there, mix(made * BASE_1 + part), made)
        order = np.lexsort((made, text[at]))
        owner, made = text[at][order], made[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (made[1:] != made[:-1]))[:len(made)]
        edges = np.flatnonzero(new)
        self.text, self.hash = owner[new], made[new]
        self.weight = np.diff(np.append(edges, len(made))).astype(np.float64)
        self.first = np.searchsorted(self.text, np.arange(self.rows + 1))


def _uniform(hashes: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number in (0, 1] and other random bits for each shingle and draw."""
    bits = mix(hashes + (draw.astype(np.uint64) + np.uint64(1)) * BASE_2)
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53, mix(bits ^ BASE_1)


def prob_minhash(shingles: Shingles, registers: int = REGISTERS) -> np.ndarray:
    """The shingle hash that each register of each text keeps; 0 for a text without shingles."""
    rows = shingles.rows
    best = np.full(rows * registers, np.inf)
    kept = np.zeros(rows * registers, np.uint64)
    text, hashes, weight = shingles.text, shingles.hash, shingles.weight
    time, drawn = np.zeros(len(text)), np.zeros(len(text), np.int64)
    while len(text):
        step = 1 if len(text) > 20_000 else 16  # few processes left: several arrivals at a time
        draw = drawn[:, None] + np.arange(step)
        chance, bits = _uniform(hashes[:, None], draw)
        arrival = time[:, None] + np.cumsum(-np.log(chance), axis=1) / weight[:, None]
        slot = text[:, None] * registers + (bits % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot.ravel(), arrival.ravel())
        row, col = np.nonzero(arrival == best[slot])
        kept[slot[row, col]] = hashes[row]
        time, drawn = arrival[:, -1], drawn + step
        latest = best.reshape(rows, registers).max(axis=1)
        going = time < latest[text]
        text, hashes, weight, time, drawn = (x[going] for x in (text, hashes, weight, time, drawn))
    return kept.reshape(rows, registers)


def band_keys(kept: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per text and band of registers; the band's number is part of it."""
    split = kept.reshape(len(kept), bands, -1)
    made = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), split.shape[:2])
    for k in range(split.shape[2]):
        made = mix(made * BASE_1 + split[:, :, k])
    return made.view(np.int64)


def probability_jaccard(one: np.ndarray, one_weight: np.ndarray, two: np.ndarray, two_weight: np.ndarray) -> float:
    """The sum over common elements d of 1 / sum over all e of max(v_e / v_d, w_e / w_d)."""
    _, at, to = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    v, w = one_weight[at], two_weight[to]
    only_one, only_two = one_weight.sum() - v.sum(), two_weight.sum() - w.sum()
    ratio, group = np.unique(w / v, return_inverse=True)
    share = np.bincount(group, v)
    return float(sum(share[k] / (np.maximum(v, w / r).sum() + only_one + only_two / r)
                     for k, r in enumerate(ratio.tolist())))


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The probability Jaccard similarity of one text to many; hashes are sorted.

    Where no shingle is repeated it is the share of common shingles, counted for all texts at once.
    """
    hashes, weight = one
    sizes = np.array([len(h) for h, _ in others], np.int64)
    every = np.concatenate([h for h, _ in others])
    place = np.minimum(np.searchsorted(hashes, every), len(hashes) - 1)
    common = np.add.reduceat(hashes[place] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
    found = common / (len(hashes) + sizes - common)
    single = weight.max() == 1
    for k, (h, w) in enumerate(others):
        if not single or w.max() != 1:
            found[k] = probability_jaccard(hashes, weight, h, w)
    return found


def node_of(text: Column) -> Column:
    """The node of a text: 128 bits of a digest of it."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def store(docs: DataFrame) -> DataFrame:
    """What later steps read, written to the shared folder: per row of (doc_id, text) its number, id, node
    (null for a text without words), band keys and registers (16 bits each)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(3)):
                part = batch.slice(first, last - first)
                shingles = Shingles(*flat(part.column(3)))
                kept = prob_minhash(shingles)
                some = np.diff(shingles.first) > 0
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    pa.array([k if s else None for k, s in zip(part.column(2).to_pylist(), some)], pa.binary()),
                    pa.array([b if s else [] for b, s in zip(band_keys(kept), some)], pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in kept.astype(np.uint16)], pa.binary())],
                    ["row", "doc_id", "node", "bands", "registers"])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         node_of(F.col("text")).alias("node"), F.col("text").cast("string").alias("text"))
    return settle(picked.mapInArrow(make, STORED), "signatures")


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed): the compressed text of each of these nodes, written to the shared folder."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [press.compress(t) for t in as_bytes(batch.column(1)).to_pylist()], pa.binary())], ["node", "packed"])

    packed = docs.select(node_of(F.col("text")).alias("node"), F.col("text").cast("string").alias("text")).mapInArrow(
        squeeze, "node binary, packed binary")
    needed = packed.join(nodes.hint("merge"), "node", "left_semi")
    return settle(needed.groupBy("node").agg(F.min("packed").alias("packed")), "node_texts")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes with at least this similarity, computed exactly."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                held = [expand.decompress(x) for k in (2, 3) for x in part.column(k).to_pylist()]
                s = Shingles(*flat(pa.array(held, pa.binary())))
                own = [(s.hash[a:b], s.weight[a:b]) for a, b in zip(s.first[:-1], s.first[1:])]
                near = [probability_jaccard(*a, *b) >= similarity - 1e-9
                        for a, b in zip(own[:part.num_rows], own[part.num_rows:])]
                yield part.select(["u", "v"]).filter(pa.array(near))

    def ends(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("packed").alias(f"{name}_packed")).hint("merge")

    joined = pairs.join(ends("u"), "u").join(ends("v"), "v").select("u", "v", "u_packed", "v_packed")
    return settle(joined.mapInArrow(check, "u binary, v binary"), "near_links")


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


class _Side:
    """One block of a bucket's members, as arrays."""

    def __init__(self, table: pa.Table):
        self.nodes, self.labels, self.packed = (table[n].to_pylist() for n in ("node", "label", "packed"))
        self.outside = np.array(table["outside"].to_pylist(), bool)
        self.bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(self.nodes), BANDS)
        self.registers = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)

    def shingles(self, rows: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        expand, out = zstandard.ZstdDecompressor(), {}
        for first in range(0, len(rows), 256):
            part = rows[first:first + 256]
            s = Shingles(*flat(pa.array([expand.decompress(self.packed[k]) for k in part], pa.binary())))
            out |= {k: (s.hash[a:b], s.weight[a:b]) for k, a, b in zip(part, s.first[:-1], s.first[1:])}
        return out


def _block_links(table: pa.Table, similarity: float) -> list[tuple[bytes, bytes]]:
    """Verified links between outsiders and members of one bucket that join two labels.

    A pair is looked at if both texts share a band: in its bucket the first they share, and where buckets are
    merged any. Where both are outsiders it is looked at from one side only; what has become one label is not
    compared further.
    """
    band = table["band"][0].as_py()
    role = pa.array(np.array(table["out"].to_pylist(), bool))
    out, other = _Side(table.filter(role)), _Side(table.filter(pa.compute.invert(role)))
    numbers = {label: k for k, label in enumerate({*out.labels, *other.labels})}
    root = list(range(len(numbers)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    other_number = np.array([numbers[x] for x in other.labels], np.int64)
    floor = SURELY_LESS - SIMILARITY + similarity
    likely: dict[int, list[int]] = {}
    for k, node in enumerate(out.nodes):
        rate = (other.registers == out.registers[k]).mean(axis=1)
        close = np.flatnonzero((rate >= floor) & (other_number != numbers[out.labels[k]]))
        shared = other.bands[close] == out.bands[k]
        held = shared.any(axis=1)
        if band is not None:
            held &= out.bands[k][shared.argmax(axis=1)] == band
        close = close[held]
        if chosen := [m for m in close.tolist() if not other.outside[m] or node < other.nodes[m]]:
            likely[k] = chosen
    own, others = out.shingles(list(likely)), other.shingles(sorted({m for ms in likely.values() for m in ms}))
    links = []
    for k, ms in likely.items():
        ms = [m for m in ms if find(numbers[out.labels[k]]) != find(int(other_number[m]))]
        if not ms:
            continue
        near = similarities(own[k], [others[m] for m in ms]) >= similarity - 1e-9
        for m in np.array(ms)[near].tolist():
            a, b = find(numbers[out.labels[k]]), find(int(other_number[m]))
            if a != b:
                root[a] = b
                links.append((min(out.nodes[k], other.nodes[m]), max(out.nodes[k], other.nodes[m])))
    return links


def leftover_links(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Verified links (u, v) inside buckets between a member outside the component of the bucket's pivot and
    any other component. `members` has bucket (one of a band, or several merged), band (null if merged), node, label,
    pivot_label, bands, registers and packed.

    The members of a bucket are dealt into blocks by a hash of the node, as many as their number asks for;
    a task sees one block of outsiders and one block of members at a time.
    """
    sizes = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") != F.col("pivot_label")).cast("long")).alias("n_out"))
    open_buckets = sizes.where((F.col("n_out") > 0) & (F.col("n") > 2)).select(
        "bucket", F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("n_out") / block).alias("out_blocks"))
    dealt = members.join(open_buckets.hint("merge"), "bucket").select(
        "*", F.xxhash64("node").alias("hash"), (F.col("label") != F.col("pivot_label")).alias("outside"))
    fields = ["band", "node", "label", "outside", "bands", "registers", "packed"]
    outsiders = dealt.where("outside").select(
        "bucket", F.pmod("hash", "out_blocks").alias("out_block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *fields, F.lit(True).alias("out"))
    others = dealt.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("out_block"),
        F.pmod("hash", "blocks").alias("block"), *fields, F.lit(False).alias("out"))

    def compare(table: pa.Table) -> pa.Table:
        links = _block_links(table, similarity)
        return pa.table({"u": pa.array([u for u, _ in links], pa.binary()),
                         "v": pa.array([v for _, v in links], pa.binary())})

    return outsiders.unionByName(others).groupBy("bucket", "out_block", "block").applyInArrow(
        compare, "u binary, v binary")


def unclear_members(known: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Members of buckets that may still hold several components: (bucket, band, node, label, pivot_label).

    The buckets of one pivot component mostly hold the same texts, as a group of near copies meets in every band. If
    together they have at most `overlap` times the texts of the largest, they become one bucket, named by the
    component, and each text stands in it once; else they stay apart.
    """
    members = settle(known.groupBy("pivot_label", "node", "label").agg(
        F.collect_list("bucket").alias("bands_in"), F.max("n").alias("n")), "bucket_members")  # a bucket for each band
    sizes = members.groupBy("pivot_label").agg(
        F.count(F.lit(1)).alias("texts"), F.max("n").alias("most"),
        F.max(F.col("label") != F.col("pivot_label")).alias("split")).where("split").select(
        "pivot_label", (F.col("texts") <= overlap * F.col("most")).alias("merged"))
    dealt = members.join(sizes.hint("merge"), "pivot_label")
    whole = dealt.where("merged").select(
        F.col("pivot_label").alias("bucket"), F.lit(None).cast(known.schema["bucket"].dataType).alias("band"), "node",
        "label", "pivot_label")
    apart = dealt.where("NOT merged").select(F.explode("bands_in").alias("band"), "node", "label", "pivot_label")
    return whole.unionByName(apart.withColumn("bucket", F.col("band").cast("string").cast("binary")))


def near_labels(docs: DataFrame, stored: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of every node with a near-duplicate: the component of its verified links."""
    nodes = settle(stored.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("bands", "registers")).alias("one")).select("node", "one.*"), "nodes")
    member = nodes.select(F.explode("bands").alias("bucket"), "node")
    pivots = member.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("bucket", "node").alias("draw"), "node")).alias("pivot")
    ).where("n > 1").select("bucket", "n", F.col("pivot.node").alias("pivot"))
    buckets = settle(member.join(pivots.hint("merge"), "bucket"), "buckets")
    stars = settle(buckets.where("node != pivot").select(*_ordered("node", "pivot")).distinct(), "stars")
    texts = node_texts(docs, buckets.select("node").distinct())
    first = verified(stars, texts, similarity)
    labels = components(first)

    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        told = labels.select(F.col("node").alias(node), F.col("label").alias(name))
        return df.join(told.hint("merge"), node, "left").withColumn(name, F.coalesce(name, node))

    known = settle(labelled(labelled(buckets.where("n > 2"), "node", "label"), "pivot", "pivot_label"), "known")
    unclear = unclear_members(known).join(nodes.hint("merge"), "node").join(texts.hint("merge"), "node")
    second = settle(leftover_links(unclear, similarity), "leftover_links")
    joined = settle(labelled(labelled(second, "u", "a"), "v", "b").select(
        F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "label_links")
    discard(nodes, buckets, stars, texts, known, first, second)
    if not joined.isEmpty():  # the links go between labels, so the components of labels are few
        merged = components(joined)
        old = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("whole")).hint("merge"),
                          "label", "left").select("node", F.coalesce("whole", "label").alias("label"))
        alone = merged.join(labels.select("node").hint("merge"), "node", "left_anti").select("node", "label")
        before, labels = labels, settle(old.unionByName(alone), "labels")
        discard(before, merged)
    discard(joined)
    return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document of `docs` (doc_id, text): its class of near-duplicates.

    `class_id` is the smallest doc_id of the class, `class_size` its number of rows, `kept` is true for one row
    of each class: the smallest doc_id, of equal ones the first row. Shingles are five words, unchanged; a text
    of one to four words is one shingle; a text without words (null, empty, white space) is a class of its own.
    A null doc_id sorts after all others. Other columns are not looked at; an empty table gives no rows.
    """
    return _decided(docs, similarity).select("doc_id", "class_id", "class_size", "kept")


def _decided(docs: DataFrame, similarity: float) -> DataFrame:
    stored = store(docs)
    rows = stored.select("row", "doc_id", "node")
    labels = near_labels(docs, stored, similarity)
    told = rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce(
        "label", "node", F.concat(F.lit(b"row"), F.col("row").cast("string").cast("binary"))))
    best = told.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best"),
        F.count(F.lit(1)).alias("class_size"))
    found = settle(told.join(best.hint("merge"), "label").select(
        "doc_id", "node", F.col("best.doc_id").alias("class_id"), "class_size",
        (F.col("row") == F.col("best.row")).alias("kept")), "classes")
    discard(stored, labels)
    return found


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each class of near-duplicates, all columns kept.

    Rows with equal doc_id and text are told apart only where one of them stays: then any one of them does.
    """
    key = next(n for n in map("key_{}".format, range(len(docs.columns) + 1)) if n not in docs.columns)

    def keyed(node: Column) -> Column:
        return F.concat(node, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias(key)

    rows = _decided(docs, similarity).where("node IS NOT NULL").select(keyed(F.col("node")), "kept")
    counts = settle(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")), "keys")
    gone = limited_broadcast(counts.where("NOT kept OR n > 1").select(key))
    numbered = docs.select("*", keyed(node_of(F.col("text"))))
    out = numbered.join(gone, key, "left_anti").drop(key)
    several = counts.where("kept AND n > 1").select(key)
    if several.isEmpty():
        return out
    again = numbered.join(limited_broadcast(several), key, "left_semi").dropDuplicates([key]).drop(key)
    return out.unionByName(again)
