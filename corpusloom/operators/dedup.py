"""Order-aware removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import caption_head, caption_tail
from corpusloom.operators.numbering import file_batch


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order_by``; null counts as one value.

    Spark limits every key to one row in each task before the shuffle, so a
    key that holds most of the rows sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedup_head_tail(
    df: DataFrame,
    n: int = 15,
    scope: str = "global",
    batch_size: int = 4,
    caption: str = "caption",
    order_by: Sequence[str] = ("shard", "row_index"),
    keep_work_columns: bool = False,
) -> DataFrame:
    """Keep the first caption per head, then among those the first per tail.

    ``scope='batch'`` treats every ``batch_size`` consecutive files on their
    own; ``'global'`` treats the whole corpus as one. The two passes do not
    commute, hence two shuffles, of positions, beginnings and ends alone; captions
    join what is left. ``order_by`` identifies a row and holds no nulls.
    """
    if scope not in ("global", "batch"):
        raise ValueError("scope is 'global' or 'batch'")
    work = df.withColumns({
        "head": caption_head(F.col(caption), n),
        "tail": caption_tail(F.col(caption), n),
    })
    scope_keys: list[str] = []
    if scope == "batch":
        work = file_batch(work, order_by[0], batch_size)
        scope_keys = ["batch"]
    work = work.select(*order_by, *scope_keys, "head", "tail")
    work = keep_first(work, [*scope_keys, "head"], order_by)
    work = keep_first(work, [*scope_keys, "tail"], order_by)
    if keep_work_columns:
        return df.join(work, list(order_by)).select(*df.columns, *scope_keys, "head", "tail")
    return df.join(work, list(order_by), "left_semi").select(*df.columns)


def ordered_distinct(df: DataFrame, column: str, position: str) -> DataFrame:
    """Distinct values with the position at which each was first seen, in that order."""
    return df.groupBy(column).agg(F.min(position).alias("first_seen")).orderBy("first_seen")
