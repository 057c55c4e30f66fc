"""Exact ranks and percentiles without bringing a whole key, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.ordered import chunk_of, scan
from packetloom.settings import settle

BUCKET_BITS = 12


def bucket(value: Column) -> Column:
    """Order-keeping coarse bucket: the leading bits of a whole number with their width."""
    def leading(n: Column) -> Column:
        extra = F.greatest(F.length(F.bin(n)) - F.lit(BUCKET_BITS), F.lit(0))
        return extra.cast("bigint") * (1 << BUCKET_BITS) + F.floor(
            n / F.pow(F.lit(2.0), extra)).cast("bigint")

    whole = value.cast("bigint")
    return F.when(whole >= 0, leading(whole)).otherwise(-1 - leading(-whole))


def cumulative(df: DataFrame, keys: list[str], coarse: Column, value: str, weight: str,
               descending: bool = False) -> DataFrame:
    """Add `before`, the weight of the key's smaller values; `df` has one row per (keys, value)."""
    rows = df.withColumn("_bucket", coarse)
    step = [*keys, "_bucket"]

    def ordering(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    ahead = Window.partitionBy(*keys).orderBy(ordering("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    starts = rows.groupBy(*step).agg(F.sum(weight).alias("_w")).select(
        *step, F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*step).orderBy(ordering(value)).rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(
        starts, step).withColumn("before", F.col("_start") + F.col("_inside")).drop(
            "_bucket", "_start", "_inside")


def rank_descending(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """Number rows from 1 by `value` descending, then `tie` ascending; `tie` is unique.

    Rows are grouped by (value, chunk of tie), so equal values never share one task, and only the
    counts of those groups are accumulated. `df` is a grouped table; it is stored first, so that what
    it was grouped from is read once.
    """
    rows = settle(df, "ranked")
    rows = rows.withColumn("_chunk", chunk_of(tie, rows))
    counts = rows.groupBy(value, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    per_value = counts.groupBy(value).agg(F.sum("_n").alias("_n"))
    ahead = cumulative(per_value, [], bucket(F.col(value)), value, "_n", descending=True).select(
        value, "before")
    chunks_before = Window.partitionBy(value).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.join(ahead, value).select(
        value, "_chunk",
        (F.col("before") + F.coalesce(F.sum("_n").over(chunks_before), F.lit(0))).alias("_start"))
    inside = Window.partitionBy(value, "_chunk").orderBy(tie)
    return rows.withColumn("_at", F.row_number().over(inside)).join(
        starts, [value, "_chunk"]).withColumn(
            out, F.col("_start") + F.col("_at")).drop("_chunk", "_start", "_at")


def nearest_rank(df: DataFrame, keys: list[str], value: str, coarse: Column,
                 points: dict[str, float], weight: str) -> DataFrame:
    """Exact nearest-rank percentiles of a key, the index rounded half to even.

    `df` has one row per key and distinct value with its `weight`.
    """
    counts = df.withColumnRenamed(weight, "_n").withColumn("_bucket", coarse)
    by_key = Window.partitionBy(*keys)
    ahead = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    indexes = F.array(*[
        F.bround((F.col("_all") - 1) * F.lit(p), 0).cast("bigint") for p in points.values()])
    holding = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_w")).select(
        *keys, "_bucket", "_w", F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_start"),
        F.sum("_w").over(by_key).alias("_all"),
    ).withColumn("_index", indexes).where(F.exists(
        "_index", lambda i: (i >= F.col("_start")) & (i < F.col("_start") + F.col("_w"))))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = counts.join(holding.drop("_w"), [*keys, "_bucket"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.groupBy(*keys).agg(*[
        F.max(F.when((F.col("_index")[i] >= F.col("_before"))
                     & (F.col("_index")[i] < F.col("_before") + F.col("_n")), F.col(value))).alias(out)
        for i, out in enumerate(points)])


def by_frequency(counts: DataFrame, n: str = "n", first: str = "first_at",
                 out: str = "rank") -> DataFrame:
    """Number counters from the most frequent, ties by first appearance; nothing is cut off."""
    return rank_descending(counts, n, first, out)


def row_positions(df: DataFrame, keys: list[str], order: str, out: str, tasks: int | None = None) -> DataFrame:
    """Zero-based place of each row within its key."""
    return scan(df, keys, order, position=out, tasks=tasks).withColumn(out, F.col(out) - 1)
