"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends from the root over regions and racks to a shard. At each node every child draws
-ln(u) / weight, with u a hash of the document's key and the child's name, and the least draw wins. So a child
is chosen in proportion to its weight, and a change of a weight moves documents only into the subtree that
grew (or out of the one that shrank): the draws of all others stay as they were.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.settings import settle


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, where it stands, and its weight."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def regular_tree(shards: int, racks_in_region: int = 2, shards_in_rack: int = 2) -> tuple[Shard, ...]:
    """Shards of weight 1 that fill racks, and racks that fill regions, in order."""
    return tuple(Shard(k, f"region{k // (racks_in_region * shards_in_rack)}", f"rack{k // shards_in_rack}")
                 for k in range(shards))


def grown_tree(shards: Sequence[Shard], weight: float = 1.0) -> tuple[Shard, ...]:
    """The tree with one more shard, in a region and rack of its own: only that region's weight changes, so
    whatever moves goes into the new shard."""
    number = 1 + max(s.number for s in shards)
    taken = {s.region for s in shards}
    region = next(f"region{k}" for k in range(len(taken) + 1) if f"region{k}" not in taken)
    return (*shards, Shard(number, region, f"{region}rack", weight))


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits + 1) * F.lit(2.0 ** -53)) / F.lit(float(weight))


def _choice(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child with the least draw; a child without weight is never chosen."""
    drawn = [F.struct(_draw(key, name, weight).alias("draw"), value.alias("value"))
             for name, (weight, value) in children.items() if weight > 0]
    return F.array_min(F.array(*drawn))["value"]


def shard_of(key: Column, shards: Sequence[Shard]) -> Column:
    """The shard number of a key: a region, then a rack in it, then a shard in that."""
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def weight(group) -> float:
        return sum(s.weight for s in group)

    region = _choice(key, {r: (weight([s for rack in racks.values() for s in rack]), F.lit(r))
                           for r, racks in regions.items()})
    out = F.lit(None).cast("int")
    for r, racks in regions.items():
        rack = _choice(key, {f"{r}/{k}": (weight(group), F.lit(k)) for k, group in racks.items()
                             }) if weight([s for g in racks.values() for s in g]) > 0 else F.lit(None)
        inside = F.lit(None).cast("int")
        for k, group in racks.items():
            if weight(group) > 0:
                leaf = _choice(key, {f"{r}/{k}/{s.number}": (s.weight, F.lit(s.number)) for s in group})
                inside = F.when(rack == k, leaf).otherwise(inside)
        out = F.when(region == r, inside).otherwise(out)
    return out.cast("int")


def place(docs: DataFrame, shards: Sequence[Shard] | None = None) -> DataFrame:
    """One row per document of `docs` (doc_id, text) with its shard, slot and shard after growth.

    `size` is the text's UTF-8 bytes plus 1 and `text_crc32` its unsigned checksum, a null text counting as
    empty. The law is `key`: doc_id and the tree alone decide, so a repeated doc_id goes where the first one
    goes, and all null ones go to one shard. `slot` numbers the rows of a shard from 0 without gaps, in the
    order of a stored copy of the placed rows: rows are counted per stored part and shard, and numbered inside
    them, so no task sees a whole shard. `grown_shard` is the shard in `grown_tree`. Other columns are not
    looked at; an empty table gives no rows.
    """
    shards = tuple(shards or regular_tree(8))
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, shards).alias("shard"), shard_of(key, grown_tree(shards)).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    stored = settle(placed, "placed")
    counts = stored.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (stored.withColumn("inside", inside)
            .join(before.select("shard", "part", "before"), ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.coalesce("before", F.lit(0)) + F.col("inside")).cast("long").alias("slot"), "grown_shard"))
