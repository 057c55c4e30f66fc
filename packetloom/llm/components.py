"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.settings import discard, settle


def _with_least(links: DataFrame) -> DataFrame:
    """Every (u, v) with the least of u and its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    return links.join(least.hint("merge"), "u").withColumn("least", F.least("u", "least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the least neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_least(both).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours, and the node itself, are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _with_least(down)
    return (stars.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(stars.select("u", F.col("least").alias("v")))
            .where(F.col("u") != F.col("v")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v): the label is the least node of its component.

    Nodes may be of any type that can be ordered. Each round is written to the shared folder in place of the
    one before, and so are the labels; only a count
    and a checksum reach the driver. A node linked to a third of all others is split by Spark's skewed joins.
    """
    now = settle(links.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
        old, now = now, settle(_small_star(_large_star(now)), "links")
        discard(old)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = settle(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
    discard(now)
    return labels
