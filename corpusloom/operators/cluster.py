"""Two-level clustering: per shard, over the centroids, assignment, representatives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vectors import as_double
from corpusloom.operators.batches import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    Block,
    bounded_block,
    bounded_blocks,
    map_batches,
    to_lists,
    to_matrix,
)
from corpusloom.operators.nearest import (
    assign_nearest,
    best_in_block,
    knn_exact,
)
from corpusloom.operators.numbering import attach
from corpusloom.operators.split import hash_key
from corpusloom.storage import stage

SLICE_BYTES = BLOCK_BYTES  # vectors of one shard that one task assigns together


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return best_in_block(x, centers, np.arange(len(centers)), 1, "l2")[1]


def _rows_within(df: DataFrame, vector: str) -> int:
    """How many rows of vectors fit in ``SLICE_BYTES``."""
    width = df.agg(F.max(F.size(vector))).first()[0] or 1
    return max(1, SLICE_BYTES // (8 * width))


def _slice_counts(df: DataFrame, shard: str, rows: int) -> DataFrame:
    """Into how many slices each shard goes so that one holds about ``rows`` rows."""
    sizes = stage(df.groupBy(shard).agg(F.count(F.lit(1)).alias("_n")))
    return sizes.select(shard, F.ceil(F.col("_n") / rows).alias("_slices"))


def _sliced(df: DataFrame, counts: DataFrame, shard: str, row: str) -> DataFrame:
    """Append ``_slice``, by the hash of the row's position."""
    return df.join(counts, shard).withColumn(
        "_slice", F.pmod(F.xxhash64(F.col(row)), F.col("_slices")))


def _start(df: DataFrame, k: int, shard: str, key: list[str], vector: str, seed: int) -> DataFrame:
    """The rows with the k lowest key digests of each shard as its first centres.

    The sizes of the shards tell below which digest k rows are expected: only some
    ``sqrt(k)`` rows more than that are ranked. Where that falls short, the band is widened.
    """
    digest = hash_key(F.concat_ws("/", *key), seed)
    keyed = df.select(shard, *key, digest.alias("_digest"))
    sizes = stage(keyed.groupBy(shard).agg(F.count(F.lit(1)).alias("_size")))
    place = F.conv(F.left("_digest", F.lit(15)), 16, 10).cast("bigint")
    order = Window.partitionBy(shard).orderBy("_digest", *key)
    slack = 6 * k ** 0.5 + 16
    while True:
        edge = F.lit((k + slack) * float(1 << 60)) / F.col("_size")
        band = keyed.join(sizes, shard).where(place <= edge)
        # The rank is cut to k in each task before the shuffle; vectors follow afterwards.
        ranked = band.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        found = stage(ranked.select(shard, *key, (F.col("_n") - 1).cast("bigint").alias("centroid_id")))
        have = found.groupBy(shard).agg(F.count(F.lit(1)).alias("_have"))
        short = sizes.join(have, shard, "left").where(
            F.coalesce("_have", F.lit(0)) < F.least("_size", F.lit(k)))
        if short.isEmpty():
            break
        slack = 4 * slack + k
    return df.join(found, [shard, *key]).select(
        shard, "centroid_id", as_double(F.col(vector)).alias("center"))


def _won(df: DataFrame, centers: DataFrame, shard: str, key: list[str], vector: str,
         max_bytes: int) -> DataFrame:
    """Count and sum of the rows nearest to each centre of their shard: ``n, total``."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total")
    have, width = centers.agg(F.count(F.lit(1)), F.max(F.size("center"))).first()
    if have * (width or 0) * 8 > max_bytes:
        # Beyond the broadcast bound vectors meet their shard's centres in slices.
        row = F.struct(*key)
        named = df.select(shard, row.alias("_row"), as_double(F.col(vector)).alias("total"))
        near = assign_own_shard(named, centers, shard, "_row", "total", max_bytes=max_bytes)
        return named.join(near, [shard, "_row"]).groupBy(shard, "centroid_id").agg(
            F.count(F.lit(1)).cast("double").alias("n"), total)
    block = bounded_block(centers, "centroid_id", "center", [shard], max_bytes)
    shared = df.sparkSession.sparkContext.broadcast(block.parts)
    schema = T.StructType([
        df.schema[shard], T.StructField("centroid_id", T.LongType()),
        T.StructField("n", T.DoubleType()), T.StructField("total", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block(*shared.value)
        owners = np.array(held.extra[shard], dtype=object)
        counts, sums, kind = np.zeros(len(owners)), np.zeros_like(held.matrix), pa.null()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            kind = batch.column(shard).type
            matrix = to_matrix(batch.column(vector), held.matrix.shape[1])
            coded = batch.column(shard).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                rows, own = np.flatnonzero(codes == i), np.flatnonzero(owners == name)
                order = own[np.argsort(held.ids[own], kind="stable")]
                won = order[_nearest(matrix[rows], held.matrix[order])]
                counts += np.bincount(won, minlength=len(counts))
                np.add.at(sums, won, matrix[rows])
        hit = np.flatnonzero(counts)
        if len(hit):
            yield pa.RecordBatch.from_arrays([
                pa.array(owners[hit].tolist(), kind), pa.array(held.ids[hit], pa.int64()),
                pa.array(counts[hit]), to_lists(sums[hit], pa.float64())],
                names=[shard, "centroid_id", "n", "total"])

    return df.select(shard, vector).mapInArrow(run, schema).groupBy(shard, "centroid_id").agg(
        F.sum("n").alias("n"), total)


def kmeans_shard(df: DataFrame, k: int, shard: str = "shard", row: str | Sequence[str] = "row_index",
                 vector: str = "embedding", max_iter: int = 10, seed: int = 0,
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """min(k, rows) centroids for each shard: ``shard, centroid_id, center``.

    All rows of a shard are clustered together, whatever its size: it starts from the
    rows with the lowest digests of ``row`` and takes ``max_iter`` full Lloyd steps. Each
    task sends one count and sum for each centre that its rows won. A centre that wins no
    row stays. Ties go to the lower centroid.
    """
    key = [row] if isinstance(row, str) else list(row)
    centers = stage(_start(df, k, shard, key, vector, seed))
    for _ in range(max_iter):
        won = _won(df, centers, shard, key, vector, max_bytes)
        moved = F.transform("total", lambda x: x / F.col("n"))
        centers = stage(centers.join(won, [shard, "centroid_id"], "left").select(
            shard, "centroid_id", F.coalesce(moved, F.col("center")).alias("center")))
    return centers


def kmeans_final(centroids: DataFrame, k: int, center: str = "center", seed: int = 0,
                 max_iter: int = 10, key: Sequence[str] | None = None) -> DataFrame:
    """k-means over a table of vectors: ``centroid_id, center``; k is at most the row count.

    ``key`` identifies a row; all columns but the vector, if not given.
    """
    names = [c for c in centroids.columns if c != center] if key is None else list(key)
    one = centroids.select(F.lit(0).alias("_all"), *[
        F.col(c).alias(f"_key{i}") for i, c in enumerate(names)], F.col(center).alias("_vector"))
    keys = [f"_key{i}" for i in range(len(names))]
    return kmeans_shard(one, k, "_all", keys, "_vector", max_iter, seed).select(
        "centroid_id", "center")


def fit_cells(docs: DataFrame, nlist: int = 8, vector: str = "embedding", seed: int = 0,
              max_iter: int = 10, key: str = "doc_id") -> DataFrame:
    """The coarse centroids of a pruned search, fitted on all of ``docs``."""
    return kmeans_final(docs, nlist, vector, seed, max_iter, [key])


def assign_own_shard(df: DataFrame, centroids: DataFrame, shard: str = "shard",
                     row: str = "row_index", vector: str = "embedding",
                     slice_rows: int | None = None,
                     max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The nearest centroid of a vector among those of its own shard.

    All centroids go to every task if they are within ``max_bytes``. Otherwise
    vectors and centroids of a shard meet in slices of bounded size.
    """
    have, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("center"))).first()
    if have * (width or 0) * 8 <= max_bytes:
        block = next(bounded_blocks(centroids, "centroid_id", "center", [shard], max_bytes))
        shared = df.sparkSession.sparkContext.broadcast(block.parts)
        new = T.StructType([T.StructField("centroid_id", T.LongType())])

        def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            held = Block(*shared.value)
            owners = np.array(held.extra[shard])
            matrix = to_matrix(batch.column(vector), held.matrix.shape[1])
            coded = batch.column(shard).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            out = np.empty(len(matrix), dtype=np.int64)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                rows, own = np.flatnonzero(codes == i), np.flatnonzero(owners == name)
                _, ti, _ = best_in_block(matrix[rows], held.matrix[own], held.ids[own], 1, "l2")
                out[rows] = held.ids[own][ti]
            return {"centroid_id": pa.array(out)}

        return map_batches(df, [shard, row], vector, new, compute)

    counts = _slice_counts(df, shard, slice_rows or _rows_within(df, vector))
    work = _sliced(df.select(shard, row, vector), counts, shard, row)
    slices = counts.select(shard, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("_slices") - 1)).alias("_slice"))
    spread = centroids.select(shard, "centroid_id", "center").join(slices, shard)
    schema = T.StructType([df.schema[shard], df.schema[row],
                           T.StructField("centroid_id", T.LongType())])

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({shard: [], row: [], "centroid_id": []})
        right = right.sort_values("centroid_id")
        found = _nearest(np.stack(left[vector].to_numpy()).astype(np.float64),
                         np.stack(right["center"].to_numpy()).astype(np.float64))
        return pd.DataFrame({shard: left[shard], row: left[row],
                             "centroid_id": right["centroid_id"].to_numpy()[found]})

    return work.groupBy(shard, "_slice").cogroup(spread.groupBy(shard, "_slice")).applyInPandas(
        assign, schema)


def assign_two_hop(df: DataFrame, first: DataFrame, final: DataFrame, shard: str = "shard",
                   row: str = "row_index", vector: str = "embedding") -> DataFrame:
    """Vector to its shard's centroid, that centroid to its nearest final one."""
    hop_one = assign_own_shard(df, first, shard, row, vector)
    hop_two = stage(_final_of(first, final, shard))
    return attach(hop_one.withColumnRenamed("centroid_id", "first_id"), hop_two,
                  [shard, "first_id"]).select(shard, row, "first_id", "final_id")


def _final_of(first: DataFrame, final: DataFrame, shard: str) -> DataFrame:
    renamed = first.select(shard, F.col("centroid_id").alias("first_id"), "center")
    return assign_nearest(renamed, final, [shard, "first_id"], "center").select(
        shard, "first_id", F.col("centroid_id").alias("final_id"))


def representatives(df: DataFrame, final: DataFrame, scope: str = "shard", shard: str = "shard",
                    row: str = "row_index", vector: str = "embedding") -> DataFrame:
    """The vector nearest to each final centroid.

    ``scope='shard'``: one per centroid and shard, whatever cluster it is in.
    ``'cluster'``: one per centroid among the vectors assigned to it.
    """
    if scope == "shard":
        wanted = final.select(F.col("centroid_id").alias("query_id"),
                              F.col("center").alias(vector))
        found = knn_exact(df, wanted, 1, "l2", row, "query_id", vector, group=shard)
        return found.select(shard, F.col("query_id").alias("centroid_id"),
                            F.col("doc_id").alias(row), F.col("score").alias("distance"))
    if scope != "cluster":
        raise ValueError("scope is 'shard' or 'cluster'")
    near = assign_nearest(df, final, [shard, row], vector)
    return near.groupBy("centroid_id").agg(
        F.min(F.struct("distance", shard, row)).alias("_m")).select(
        "centroid_id", f"_m.{shard}", f"_m.{row}", "_m.distance")


@dataclass(frozen=True)
class Clustering:
    first: DataFrame
    final: DataFrame
    assignment: DataFrame
    representatives: DataFrame


def cluster_two_level(df: DataFrame, k_first: int = 10_000, k_final: int = 50_000,
                      shard: str = "shard", row: str = "row_index", vector: str = "embedding",
                      seed: int = 0, max_iter: int = 10) -> Clustering:
    """All steps; every intermediate result is a written table."""
    first = kmeans_shard(df, k_first, shard, row, vector, max_iter, seed)
    final = kmeans_final(first, k_final, "center", seed, max_iter, [shard, "centroid_id"])
    assignment = stage(assign_two_hop(df, first, final, shard, row, vector))
    chosen = stage(representatives(df, final, "shard", shard, row, vector))
    return Clustering(first, final, assignment, chosen)
