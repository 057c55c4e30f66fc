"""Ordered per-key operators that stay bounded when one key holds most of the rows.

Capture order (`frame_number`, or another unique number) is cut into chunks of a fixed number of
rows. Every window runs inside (key, chunk), so no task sorts more than one chunk of a key. What a
chunk needs from the rows before it is aggregated per (key, chunk), accumulated over the few chunk
rows of the key, and fed back as one leading row of the chunk. Keys that fit in one chunk produce no
such row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.chains import FAN
from packetloom.settings import chunk_rows, settle

SEQUENCE_SPACE = 1 << 16
HALF_SPACE = 1 << 15
DEFAULT_PAUSE_MS = 300.0


def chunk_of(order: str, df: DataFrame | None = None) -> Column:
    """Chunk of a place in capture order; where that is a struct (frame, slot), its first field counts."""
    place = F.col(order)
    if df is not None and isinstance(df.schema[order].dataType, T.StructType):
        place = place[df.schema[order].dataType.names[0]]
    return F.floor(place / F.lit(chunk_rows())).cast("bigint")


def place_in_packet(slot: Column, frame: str = "frame_number") -> Column:
    """Place of a value in capture order, however many values a packet holds."""
    return F.struct(F.col(frame).alias("frame"), slot.cast("bigint").alias("slot"))


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    position: str | None = None,
    previous: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add values taken from the earlier rows of the same key.

    `position` counts rows from 1, `previous` is the value of the row just before (null kept),
    `latest` the last non-null value before, `highest` the maximum before and `total` the sum before.
    `tasks` fixes how many tasks sort the rows; by default Spark merges small partitions by their compressed size.
    """
    wanted = [
        (kind, out, column)
        for kind, columns in (
            ("previous", previous), ("latest", latest), ("highest", highest), ("total", total))
        for out, column in (columns or {}).items()
    ]
    step = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(order, df)).withColumns(
        {f"_v{i}": column for i, (_, _, column) in enumerate(wanted)}
    ) if wanted else df.withColumn("_chunk", chunk_of(order, df))

    def at_end(i: int, kind: str) -> Column:
        value = F.col(f"_v{i}")
        if kind == "previous":
            return F.max_by(F.struct(value), F.col(order))[f"_v{i}"]
        if kind == "latest":
            return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
        return F.max(value) if kind == "highest" else F.sum(value)

    ends = rows.groupBy(*step).agg(
        F.count(F.lit(1)).alias("_n"),
        *[at_end(i, kind).alias(f"_v{i}") for i, (kind, _, _) in enumerate(wanted)],
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    chunks_before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)

    def carry(i: int, kind: str) -> Column:
        value = F.col(f"_v{i}")
        if kind == "previous":
            return F.lag(value).over(by_chunk)
        if kind == "latest":
            return F.last(value, ignorenulls=True).over(chunks_before)
        return (F.max(value) if kind == "highest" else F.sum(value)).over(chunks_before)

    carried = ends.select(
        *step,
        F.sum("_n").over(chunks_before).alias("_n"),
        *[carry(i, kind).alias(f"_v{i}") for i, (kind, _, _) in enumerate(wanted)],
    ).where(F.col("_n").isNotNull()).withColumn("_carried", F.lit(True))

    both = rows.withColumns({"_n": F.lit(1).cast("bigint"), "_carried": F.lit(False)}).unionByName(
        carried, allowMissingColumns=True)
    if tasks:
        both = both.repartition(tasks, *step)
    in_chunk = Window.partitionBy(*step).orderBy(F.col(order).asc_nulls_first())
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)

    def value_before(i: int, kind: str) -> Column:
        value = F.col(f"_v{i}")
        if kind == "previous":
            return F.lag(value).over(in_chunk)
        if kind == "latest":
            return F.last(value, ignorenulls=True).over(before)
        return (F.max(value) if kind == "highest" else F.sum(value)).over(before)

    added = {out: value_before(i, kind) for i, (kind, out, _) in enumerate(wanted)}
    if position:
        added[position] = F.sum("_n").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumns(added).where(~F.col("_carried")).drop(
        "_chunk", "_n", "_carried", *[f"_v{i}" for i in range(len(wanted))])


def packet_gaps(df: DataFrame, keys: list[str], time_ns: str, order: str = "frame_number",
                out: str = "gap_ms") -> DataFrame:
    """Add the milliseconds since the previous row of the key and a flag for backward time.

    A row without time breaks the chain: neither it nor the row after it has a gap.
    """
    step = F.col(time_ns) - F.col("_before")
    return scan(df, keys, order, previous={"_before": F.col(time_ns)}).withColumns({
        out: F.when(step >= 0, step / F.lit(1e6)),
        f"{out}_backward": F.coalesce(step < 0, F.lit(False)),
    }).drop("_before")


def gap_stats(df: DataFrame, keys: list[str], time_ns: str, order: str = "frame_number",
              threshold_ms: float = DEFAULT_PAUSE_MS) -> DataFrame:
    """Interval, pause, missing and backward counts with the largest and mean gap per key."""
    step = F.col(time_ns) - F.col("_before")
    forward = F.when(step >= 0, step)
    return scan(df, keys, order, previous={"_before": F.col(time_ns)}).groupBy(*keys).agg(
        F.count(forward).alias("interval_count"),
        (F.max(forward) / F.lit(1e6)).alias("max_gap_ms"),
        (F.sum(forward) / F.lit(1e6) / F.count(forward)).alias("mean_gap_ms"),
        F.count_if(forward / F.lit(1e6) >= threshold_ms).alias("pause_count"),
        F.count_if(F.col(time_ns).isNull()).alias("missing_timestamp_count"),
        F.count_if(step < 0).alias("backward_timestamp_count"),
    )


def sequence_anomalies(df: DataFrame, keys: list[str], seq: str,
                       order: str = "frame_number") -> DataFrame:
    """Mark rows as duplicate, out of order, or as following a gap of `missing` numbers."""
    seen = scan(df, [*keys, seq], order, position="_nth")
    high = scan(seen, keys, order, highest={"_high": F.col(seq)})
    new = F.col("_nth") == 1
    return high.withColumns({
        "is_duplicate": ~new,
        "is_out_of_order": F.coalesce(new & (F.col(seq) < F.col("_high")), F.lit(False)),
        "missing": F.when(new & (F.col(seq) > F.col("_high") + 1),
                          F.col(seq) - F.col("_high") - 1),
    }).withColumnRenamed("_high", "highest_before").drop("_nth")


def sequence_points(df: DataFrame, keys: list[str], seq: str,
                    order: str = "frame_number") -> DataFrame:
    """One row per distinct number of a key: first and last place, copies, maximum before."""
    distinct = df.groupBy(*keys, seq).agg(
        F.min(order).alias("first_at"), F.max(order).alias("last_at"),
        F.count(F.lit(1)).alias("copies"))
    return scan(distinct, keys, "first_at", highest={"highest_before": F.col(seq)})


def _wrapped(now: Column, before: Column) -> Column:
    return F.pmod(now - before + F.lit(HALF_SPACE), F.lit(SEQUENCE_SPACE)) - F.lit(HALF_SPACE)


def extend_sequence(df: DataFrame, keys: list[str], seq: str, order: str = "frame_number",
                    fan: int = FAN) -> DataFrame:
    """Unroll a 16-bit counter against its running maximum; adds `extended`, `highest_before`.

    Summing the wrapped steps between neighbours gives the same numbers until a row falls more than half the space
    below the maximum. From such a row on everything lies one space higher, and the maximum starts anew. The sums
    of each chunk, one row per stream and chunk, are stored and tell which streams fall at all; where they do
    is found chunk by chunk (`folds.counter_falls`), and each fall is one more step in the same sums.
    """
    from packetloom.operators.folds import counter_falls

    step = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(order)).withColumn("_seq", F.col(seq).cast("bigint"))
    in_chunk = Window.partitionBy(*step).orderBy(order)
    local = rows.select(
        *step, order, "_seq",
        F.coalesce(_wrapped(F.col("_seq"), F.lag("_seq").over(in_chunk)),
                   F.lit(0).cast("bigint")).alias("_move"),
    ).withColumn("_at", F.sum("_move").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn(
        "_drop", F.max("_at").over(in_chunk.rowsBetween(Window.unboundedPreceding, -1))
        - F.col("_at"))
    ends = local.groupBy(*step).agg(
        F.min_by("_seq", order).alias("_first"), F.max_by("_seq", order).alias("_last"),
        F.max_by("_at", order).alias("_moved"), F.max("_at").alias("_top"),
        F.min("_at").alias("_low"), F.max("_drop").alias("_drop"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    upto = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    chained = ends.withColumn(
        "_link", F.coalesce(_wrapped(F.col("_first"), F.lag("_last").over(by_chunk)),
                            F.col("_first"))
    ).withColumn("_end", F.sum(F.col("_link") + F.col("_moved")).over(upto)).withColumn(
        "_start", F.col("_end") - F.col("_moved")
    ).withColumn(
        "_high", F.max(F.col("_start") + F.col("_top")).over(
            by_chunk.rowsBetween(Window.unboundedPreceding, -1)))
    falls = F.coalesce((F.col("_drop") > HALF_SPACE) | (
        F.col("_high") - F.col("_start") - F.col("_low") > HALF_SPACE), F.lit(False))
    chained = settle(chained.withColumn("_falls", F.bool_or(falls).over(Window.partitionBy(*keys))).withColumn(
        "_last", F.lag("_last").over(by_chunk)).withColumn("_base", F.lag("_end").over(by_chunk)).select(
        *step, "_start", "_high", "_last", "_base", "_falls"), "sequence-chunks")

    falling = rows.select(*step, order, "_seq").join(chained.where("_falls").select(*step, "_start"), step)
    marks, entries = counter_falls(falling, keys, "_seq", order, fan)
    lift = F.coalesce(F.col("_count"), F.lit(0)) * SEQUENCE_SPACE
    carried = chained.where(F.col("_base").isNotNull()).join(entries, step, "left").select(
        *step, F.col("_last").alias("_seq"), (F.col("_base") + lift).alias("_base"),
        (F.coalesce(F.col("_entry"), F.col("_high")) + lift).alias("_top"), F.lit(0).alias("_kind"))
    both = rows.withColumn("_kind", F.lit(2)).unionByName(carried, allowMissingColumns=True).unionByName(
        marks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    ordered = Window.partitionBy(*step).orderBy(F.col(order).asc_nulls_first(), "_kind")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.col("_kind") == 1
    return both.withColumn("_move", F.coalesce(
        F.when(mark, F.lit(SEQUENCE_SPACE).cast("bigint")), F.col("_base"),
        _wrapped(F.col("_seq"), F.last("_seq", ignorenulls=True).over(before)), F.col("_seq"))
    ).withColumn(
        "extended", F.sum("_move").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "highest_before", F.max(F.when(~mark, F.coalesce(F.col("_top"), F.col("extended")))).over(before)
    ).where(F.col("_kind") == 2).select(*df.columns, "extended", "highest_before")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str = "frame_number",
                     cap: int | None = None, out: str = "position") -> DataFrame:
    """Distinct values of a key numbered by first appearance; `cap` keeps the first ones."""
    first = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(
        F.min(order).alias("first_at"))
    numbered = scan(first, keys, "first_at", position=out)
    return numbered.where(F.col(out) <= cap) if cap else numbered
