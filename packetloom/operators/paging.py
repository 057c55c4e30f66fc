"""Pages of matching rows with exact totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import chunk_of
from packetloom.operators.ranking import row_positions

PAGE_ROWS = 1000
#: Rows that a task numbers or joins to pages, however well they compress.
ROWS_PER_TASK = 1 << 17


def _check(offset: int, limit: int) -> None:
    if offset < 0 or limit <= 0:
        raise ValueError("the offset must not be negative and the limit must be positive")


def page(df: DataFrame, order: str, offset: int = 0, limit: int = PAGE_ROWS) -> DataFrame:
    """Rows offset … offset+limit of `df` in capture order, numbered from 0 in `position`.

    Row counts per chunk of capture order tell which chunks the page touches; only those are sorted.
    """
    _check(offset, limit)
    rows = df.withColumn("_chunk", chunk_of(order))
    from pyspark.sql import Window

    before = Window.partitionBy().orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    touched = counts.where((F.col("_start") < offset + limit)
                           & (F.col("_start") + F.col("_n") > offset))
    inside = Window.partitionBy("_chunk").orderBy(order)
    return rows.join(touched.drop("_n"), "_chunk").withColumn(
        "position", F.col("_start") + F.row_number().over(inside) - 1
    ).where(F.col("position").between(offset, offset + limit - 1)).drop("_chunk", "_start")


def page_descriptor(total: Column, offset: Column, limit: Column) -> list[Column]:
    """What a page holds: limit, returned, total, has_more and the next offset."""
    returned = F.greatest(F.lit(0), F.least(limit, total - offset))
    more = offset + returned < total
    return [offset.alias("offset"), limit.alias("limit"), returned.alias("returned"),
            total.alias("total_matching"), more.alias("has_more"),
            F.when(more, offset + returned).alias("next_offset")]


def describe_page(df: DataFrame, offset: int = 0, limit: int | None = PAGE_ROWS) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.col("n"), F.lit(1)) if limit is None else F.lit(limit).cast("bigint")
    _check(offset, 1 if limit is None else limit)
    return counted.select(*page_descriptor(F.col("n"), F.lit(offset).cast("bigint"), size))


def paged_by_flow(df: DataFrame, requests: DataFrame, order: str, limit: int = PAGE_ROWS
                  ) -> DataFrame:
    """Rows of several requested pages at once; requests are (flow_key, offset)."""
    tasks = -(-df.count() // ROWS_PER_TASK) or 1
    rows = df.withColumn("_part", F.coalesce(chunk_of(order, df), F.lit(-1)))
    # asked flows are looked up per chunk, so that no task gets all rows of a flow
    parts = rows.select("flow_key", "_part").distinct().join(
        requests.select("flow_key").distinct(), "flow_key", "left_semi")
    asked = rows.repartition(tasks, "flow_key", "_part").join(parts, ["flow_key", "_part"], "left_semi").drop("_part")
    numbered = row_positions(asked, ["flow_key"], order, "position", tasks)
    return page_rows(numbered, requests, ["flow_key"], limit, tasks)


def page_rows(numbered: DataFrame, requests: DataFrame, keys: list[str], limit: int = PAGE_ROWS,
              tasks: int | None = None) -> DataFrame:
    """Rows numbered once per key in `position`, joined to the pages that ask for them (keys, offset).

    A page touches at most two blocks of `limit` positions, so a row meets only pages near it. `tasks` fixes how many
    tasks join the rows.
    """
    asked = requests.withColumn("_block", F.explode(F.array_distinct(F.array(
        F.floor(F.col("offset") / limit), F.floor((F.col("offset") + limit - 1) / limit)))))
    placed = numbered.withColumn("_block", F.floor(F.col("position") / limit))
    if tasks:
        placed = placed.repartition(tasks, *keys, "_block")
    return placed.join(asked, [*keys, "_block"]).where(
            (F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + limit)
    ).drop("_block")
