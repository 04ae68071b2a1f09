"""Positions, group numbers, chunks and offsets without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import checked_dim
from corpusloom.storage import stage

def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "row_number",
    within: Sequence[str] = (),
) -> DataFrame:
    """Append the 0-based position of each row in the order of ``order_by``.

    ``order_by`` must identify a row and hold no nulls; it is sorted ascending.
    With ``within`` (a leading part of ``order_by``) the count starts anew in
    each group, and a group of any size is still spread over many tasks.

    Spark deals the rows to consecutive ranges and sorts each. The sorted rows are
    written once with their place in their range; the rows of earlier ranges are
    added. Only the counts, one row for each range (and group), meet in one place.
    A group that holds most of the rows spreads over many ranges.
    """
    if list(order_by[: len(within)]) != list(within):
        raise ValueError("'within' must be the leading part of 'order_by'")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).withColumn(
        "_place", F.monotonically_increasing_id()))
    # The upper bits of a place are the range, the lower ones count its rows.
    located = ranged.withColumn("_range", F.shiftright("_place", 33))
    counts = located.groupBy(*within, "_range").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = stage(counts.select(*within, "_range", (
        F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    condition = reduce(lambda a, b: a & b, [
        F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*within, "_range")])
    return located.alias("n").join(offsets.alias("o"), condition).select(
        *[F.col(f"n.{c}") for c in df.columns],
        (F.col("n._place") + F.col("o._shift")).cast("bigint").alias(name))


def attach(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table, made from a staged one, back to its rows.

    Staging tells Catalyst the size. It broadcasts the table below the session's
    threshold; above it, the join shuffles and adaptive execution splits hot keys.
    """
    return df.join(small, list(on), how)


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def group_number(df: DataFrame, column: str, name: str = "group_id") -> DataFrame:
    """Append the 0-based rank of ``column`` among its distinct values."""
    ranks = number_rows(_values(df, column), [column], name)
    return attach(df, ranks, [column], "left").select(*df.columns, name)


def file_batch(df: DataFrame, column: str = "shard", size: int = 4,
               name: str = "batch") -> DataFrame:
    """Append the number of the slice of ``size`` consecutive files a row belongs to."""
    ranked = group_number(df, column, "_file_rank")
    return ranked.withColumn(name, F.floor(F.col("_file_rank") / size).cast("bigint")).drop(
        "_file_rank")


def file_slice(df: DataFrame, start: int, end: int | None, column: str = "shard") -> DataFrame:
    """The rows of files ``[start, end)`` in the sorted listing."""
    ranks = number_rows(_values(df, column), [column], "_file_rank")
    wanted = ranks.where(F.col("_file_rank") >= start)
    if end is not None:
        wanted = wanted.where(F.col("_file_rank") < end)
    return attach(df, wanted.select(column), [column], "left_semi")


def image_number(df: DataFrame, part: str = "part", img_name: str = "img_name",
                 name: str = "image_number") -> DataFrame:
    """Number all images in the order of ``(part, img_name)``."""
    return number_rows(df, [part, img_name], name)


def shard_offsets(df: DataFrame, shard: str = "shard") -> DataFrame:
    """Per shard its row count and the number of rows in all shards before it."""
    counts = df.groupBy(shard).agg(F.count(F.lit(1)).alias("n_rows"))
    ranked = number_rows(counts, [shard], "_rank")
    # Prefix sums in blocks of 4096 shards: sums inside a block plus the blocks before.
    blocked = ranked.withColumn("_block", F.floor(F.col("_rank") / 4096))
    totals = blocked.groupBy("_block").agg(F.sum("n_rows").alias("_total"))
    earlier = totals.select(
        "_block",
        F.coalesce(
            F.sum("_total").over(
                Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_block").orderBy("_rank").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        blocked.join(earlier, "_block")
        .select(
            shard, "n_rows",
            (F.col("_earlier") + F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
            .cast("bigint").alias("row_offset"))
    )


def chunk_fixed(df: DataFrame, size: int, shard: str = "shard", position: str = "row_index",
                name: str = "chunk") -> DataFrame:
    """Number chunks of ``size`` consecutive rows inside each shard, from 0."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    numbered = number_rows(df, [shard, position], "_position", within=[shard])
    return numbered.withColumn(name, F.floor(F.col("_position") / size).cast("bigint")).drop(
        "_position")


def rechunk(df: DataFrame, size: int, order_by: Sequence[str], name: str = "chunk",
            prefix: str | None = None) -> DataFrame:
    """Split all rows into ``ceil(n / size)`` chunks whose sizes differ by one at most.

    Chunks are numbered from 1 and the larger ones come first. With ``prefix``
    the name is ``{prefix}_{number padded to three digits}``.
    """
    if size <= 0:
        raise ValueError("chunk size must be positive")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    chunks = F.ceil(total / F.lit(size))
    small = F.floor(total / chunks)
    larger = total % chunks
    i = F.col("_position")
    edge = larger * (small + 1)
    number = F.when(i < edge, F.floor(i / (small + 1))).otherwise(
        larger + F.floor((i - edge) / small)) + 1
    numbered = number_rows(df, order_by, "_position").withColumn(name, number.cast("bigint"))
    if prefix is not None:
        text = F.col(name).cast("string")
        padded = F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))
        numbered = numbered.withColumn(name, F.concat(F.lit(f"{prefix}_"), padded))
    return numbered.drop("_position")


def concat_shards(frames: Sequence[DataFrame], shard: str = "shard", position: str = "row_index",
                  vector: str = "embedding") -> DataFrame:
    """All rows of all frames with a global position; every vector must have one width.

    The frames keep the element type of the first one. ``global_index`` is the
    row's position plus the rows of all shards before, as in one long matrix,
    so positions inside a shard have to run from 0 without gaps.
    """
    first = frames[0]
    kind = first.schema[vector].dataType
    joined = reduce(
        lambda a, b: a.unionByName(b),
        [f.withColumn(vector, F.col(vector).cast(kind)) for f in frames])
    head = first.select(F.size(vector)).first()
    if head is not None:
        joined = joined.withColumn(vector, checked_dim(F.col(vector), head[0]))
    offsets = shard_offsets(joined.select(shard), shard).select(shard, "row_offset")
    return (
        attach(joined, offsets, [shard])
        .withColumn("global_index", F.col("row_offset") + F.col(position))
        .select(*first.columns, "global_index")
    )


def corpus_stats(df: DataFrame, shard: str = "shard", vector: str = "embedding") -> DataFrame:
    """Rows, distinct files and the narrowest and widest vector."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(shard).alias("n_files"),
        F.min(F.size(vector)).cast("bigint").alias("min_dim"),
        F.max(F.size(vector)).cast("bigint").alias("max_dim"),
    )
