"""Filters, samples and train/validation splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.numbering import number_rows
from corpusloom.storage import stage

HASH_RANGE = 1 << 32


def filter_steps(df: DataFrame, steps: int = 50, column: str = "steps") -> DataFrame:
    return df.where(F.col(column) == steps)


def filter_prompted(df: DataFrame, column: str = "prompt") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def part_range(df: DataFrame, start: int, end: int, column: str = "part_id") -> DataFrame:
    """Parts ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(start, end))


def row_range(df: DataFrame, start: int, end: int, column: str) -> DataFrame:
    """Rows ``[start, end)``; pushed down to the row groups of a sorted table."""
    return df.where((F.col(column) >= start) & (F.col(column) < end))


def hash_key(key: str | Column, seed: int) -> Column:
    """A text that orders rows at random, the same under any partitioning."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def _hash_number(digest: Column) -> Column:
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")


def _digest_at(share: float) -> str:
    """The digest below which this share of all rows is expected; ``g`` is above every digest."""
    place = int(share * (1 << 60))
    return "g" if place >= 1 << 60 else f"{max(place, 0):015x}"


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) without replacement.

    ``key`` identifies a row. The rows with the n lowest digests are taken.
    Nearly all of them lie below a digest that the counts give; only the rows
    in a band of some ``sqrt(n)`` around the n-th are sorted.
    """
    total = df.count()
    if n >= total:
        return df
    hashed = df.withColumn("_digest", hash_key(key, seed))
    digest = F.col("_digest")
    slack = 6 * n ** 0.5 + 16
    while True:
        low, high = _digest_at((n - slack) / total), _digest_at((n + slack) / total)
        below, upto = hashed.agg(
            F.count_if(digest < low), F.count_if(digest < high)).first()
        if below <= n <= upto:
            break
        slack *= 4
    band = hashed.where((digest >= low) & (digest < high)).orderBy("_digest", key).limit(n - below)
    return hashed.where(digest < low).unionByName(band).drop("_digest")


def split_hash(df: DataFrame, key: str, test_size: float = 0.1, seed: int = 0,
               name: str = "is_test") -> DataFrame:
    """Mark about ``test_size`` of the rows by the hash of their key; no shuffle."""
    share = _hash_number(hash_key(key, seed)) < F.lit(int(test_size * HASH_RANGE))
    return df.withColumn(name, share)


def split_contiguous(df: DataFrame, ratio: float, order_by: Sequence[str],
                     name: str = "is_train") -> DataFrame:
    """Mark the first ``int(ratio * n)`` rows as training rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    edge = F.floor(total * F.lit(float(ratio)))
    return number_rows(df, order_by, "_position").withColumn(
        name, F.col("_position") < edge).drop("_position")


def bootstrap(df: DataFrame, key: str, n: int | None = None, seed: int = 0,
              name: str = "draw") -> DataFrame:
    """Exactly ``n`` rows (as many as there are, if not given) drawn with replacement.

    ``key`` identifies a row. Draw ``j`` takes the row whose place in the order of the
    key is a digest of (seed, j) modulo the number of rows, under any partitioning.
    """
    rows = number_rows(df, [key], "_row")
    total = rows.count()
    if total == 0:
        return rows.select(*df.columns, F.col("_row").alias(name))
    # 60 bits: every row of a table of any size can be drawn.
    digest = F.conv(F.left(hash_key("id", seed), F.lit(15)), 16, 10).cast("bigint")
    draws = df.sparkSession.range(total if n is None else n).select(
        F.col("id").alias(name), (digest % total).alias("_row"))
    return draws.join(rows, "_row").select(*df.columns, name)


def exclude_prompts(train: DataFrame, validation: DataFrame, n: int = 20, mode: str = "prefix",
                    prompt: str = "prompt") -> DataFrame:
    """Training rows that share no prompt beginning with a validation row.

    ``'prefix'`` compares beginnings on both sides; ``'literal'`` compares the
    training prompt's beginning with whole validation prompts.
    """
    if mode not in ("prefix", "literal"):
        raise ValueError("mode is 'prefix' or 'literal'")
    seen = F.col(prompt)
    if mode == "prefix":
        seen = F.left(seen, F.lit(n))
    else:
        # A longer prompt can't equal a beginning of n characters.
        validation = validation.where(F.length(prompt) <= n)
    seen_keys = validation.where(F.col(prompt).isNotNull()).select(
        seen.alias("_start")).distinct()
    # The beginning is a column of its own, so that a caller who drops the
    # prompt doesn't shuffle it.
    started = train.withColumn("_start", F.left(F.col(prompt), F.lit(n)))
    return started.join(seen_keys, "_start", "left_anti").select(*train.columns)


@dataclass(frozen=True)
class TrainValidation:
    train: DataFrame
    validation: DataFrame


def train_val_split(
    index: DataFrame,
    val_size: int,
    train_size: int,
    key: str,
    steps: int = 50,
    n: int = 20,
    mode: str = "prefix",
    exclude_val: bool = True,
    seed: int = 0,
) -> TrainValidation:
    """Filter, sample the validation set, exclude its prompts, sample the training set."""
    usable = filter_prompted(filter_steps(index, steps))
    # Staged: it is read three times, and its true size decides the join strategy.
    validation = stage(sample_n(usable, val_size, key, seed))
    rest = exclude_prompts(usable, validation, n, mode)
    if exclude_val:
        rest = rest.join(validation.select(key), key, "left_anti")
    # Keys alone are excluded and sampled; whole rows are picked up at the end.
    chosen = stage(sample_n(stage(rest.select(key)), train_size, key, seed + 1))
    return TrainValidation(usable.join(chosen, key, "left_semi"), validation)
