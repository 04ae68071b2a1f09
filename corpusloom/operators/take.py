"""Keyed alignment of metadata, vectors and neighbour lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ("shard", "row_index")


def take_vectors(meta: DataFrame, vectors: DataFrame, on: Sequence[str] = POSITION,
                 strict: bool = True) -> DataFrame:
    """The vector of every metadata row; repeated rows stay repeated.

    A position without a vector is an error that the running query raises: no
    second pass looks for it. Without ``strict`` such rows are left out.
    """
    if not strict:
        return meta.join(vectors, list(on), "inner")
    columns = [c for c in vectors.columns if c not in on]
    marked = vectors.withColumn("_found", F.lit(True))
    joined = meta.join(marked, list(on), "left")
    message = F.concat(F.lit("no vector at position "),
                       F.concat_ws("/", *[F.col(c).cast("string") for c in on]))
    # Every vector column carries the check, so column pruning can't remove it.
    checked = {
        c: F.when(F.col("_found"), F.col(c)).otherwise(F.raise_error(message)) for c in columns}
    return joined.withColumns(checked).drop("_found")


def pair_vectors(left: DataFrame, right: DataFrame, names: tuple[str, str],
                 on: Sequence[str] = POSITION, vector: str = "embedding") -> DataFrame:
    """Two vector sets side by side by position; a missing partner stays null."""
    a = left.select(*on, F.col(vector).alias(names[0]))
    b = right.select(*on, F.col(vector).alias(names[1]))
    return a.join(b, list(on), "full_outer")


def unpaired_counts(paired: DataFrame, names: tuple[str, str]) -> DataFrame:
    """How many rows lack a partner on either side."""
    return paired.agg(
        F.count_if(F.col(names[0]).isNull()).alias(f"without_{names[0]}"),
        F.count_if(F.col(names[1]).isNull()).alias(f"without_{names[1]}"))


def neighbour_meta(neighbours: DataFrame, index: DataFrame,
                   position: str = "image_number", strict: bool = True) -> DataFrame:
    """Look up the index row of every neighbour.

    A neighbour without one is an error; without ``strict`` its columns stay null.
    """
    columns = [c for c in index.columns if c != position]
    joined = neighbours.join(index.withColumn("_found", F.lit(True)),
                             F.col("doc_id") == F.col(position), "left").drop(position)
    if strict:
        missing = F.raise_error(F.concat(F.lit("no index row for "), F.col("doc_id").cast("string")))
        joined = joined.withColumns(
            {c: F.when(F.col("_found"), F.col(c)).otherwise(missing) for c in columns})
    return joined.drop("_found")


def widen_neighbours(neighbours: DataFrame) -> DataFrame:
    """One row per query with its documents and scores best first.

    A list holds the k entries of one query, so its size is bounded by k.
    """
    entry = F.struct("rank", "doc_id", "score")
    ordered = neighbours.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return ordered.select(
        "query_id", F.col("e.doc_id").alias("doc_ids"), F.col("e.score").alias("distances"))


def explode_neighbours(wide: DataFrame) -> DataFrame:
    """The long form of a wide neighbour table; ranks start at 1."""
    pairs = F.posexplode(F.arrays_zip("doc_ids", "distances")).alias("pos", "e")
    return wide.select("query_id", pairs).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("e.doc_ids").alias("doc_id"),
        F.col("e.distances").alias("score"))
