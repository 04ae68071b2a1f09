"""Mini-batch k-means of every shard, on batches that are dealt in one pass.

Rows are dealt to batches by a digest of their key and written once, a folder for each batch.
A step reads one batch: the rows of a shard's batch meet the shard's centres in one
task, which holds ``batch_size`` rows (about; they are dealt by hash) and k centres and
nothing else, whatever the size of the shard. A centre moves towards the mean of the rows it won by their
share of all rows it has won so far, so the rate falls with each centre's count. Centres
are written after each step: a lost executor costs a step, and none of them passes through the
driver.

First centres are found by parallel seeding over the first batches: in each round every row is
drawn with a chance in proportion to its squared distance to the centres drawn so far, so a
few rounds find rows all over the data; the drawn rows, weighted by the rows nearest to
them, are thinned to k in one task (some ``rounds * k / 2`` rows, whatever the shard's size). ``seeding='digest'`` takes the rows with the
lowest digests instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vectors import as_double
from corpusloom.operators.batches import to_lists, to_matrix
from corpusloom.operators.cluster import _rows_within, _slice_counts, _sliced, _start
from corpusloom.operators.nearest import best_in_block
from corpusloom.operators.split import _hash_number, hash_key
from corpusloom.storage import stage

BATCH_SIZE = 5_000
#: Rounds of parallel seeding, and the rows drawn in each: a share of k, and some more.
ROUNDS, DRAWN, MORE = 5, 0.5, 64
#: Full steps over the weighted candidates of a shard.
THINNING_STEPS = 10


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the lower on a tie, and the squared distance."""
    _, won, like = best_in_block(x, centers, np.arange(len(centers)), 1, "l2")
    return won, like.astype(np.float64) ** 2


def dealt_batches(df: DataFrame, shard: str, key: Sequence[str], vector: str, batch_size: int,
                  batches: int | None, seed: int) -> DataFrame:
    """Rows as ``shard``, ``_row``, ``_digest``, ``_v`` and ``_batch``, in one folder for each batch."""
    digest = hash_key(F.concat_ws("/", *key), seed)
    rows = df.select(shard, F.concat_ws("/", *key).alias("_row"), digest.alias("_digest"),
                     as_double(F.col(vector)).alias("_v"))
    if batches is None:
        sizes = stage(df.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("_n")))
        rows = rows.join(sizes, shard)
    else:
        rows = rows.withColumn("_n", F.lit(batches).cast("long"))
    placed = rows.withColumn("_batch", (_hash_number(F.col("_digest")) % F.col("_n")).cast("int")).drop("_n")
    return stage(placed.hint("rebalance", "_batch"), ["_batch"])


def _met(rows: DataFrame, centers: DataFrame, shard: str, per_slice: int):
    """Rows and centres of each shard side by side, rows in slices of bounded size."""
    counts = _slice_counts(rows, shard, per_slice)
    work = _sliced(rows.select(shard, "_row", "_v"), counts, shard, "_row").drop("_slices")
    spread = centers.join(counts, shard).select(*centers.columns, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("_slices") - 1)).alias("_slice"))
    return work.groupBy(shard, "_slice").cogroup(spread.groupBy(shard, "_slice"))


def _distances(rows: DataFrame, centers: DataFrame, shard: str, per_slice: int) -> DataFrame:
    """``shard``, ``_row``, the place of the nearest centre in the order of its ``_row``, and ``_cost``."""
    schema = T.StructType([rows.schema[shard], T.StructField("_row", T.StringType()),
                           T.StructField("_by", T.StringType()), T.StructField("_cost", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema_table(left, shard)
        right = right.sort_by("_by")
        won, cost = _nearest(to_matrix(left.column("_v")), to_matrix(right.column("_c")))
        return pa.table([left.column(shard), left.column("_row"), right.column("_by").take(pa.array(won)),
                         pa.array(cost)], names=schema.names)

    def schema_table(left: pa.Table, shard: str) -> pa.Table:
        kind = left.schema.field(shard).type if left.num_columns else pa.null()
        return pa.table([pa.array([], x) for x in (kind, pa.string(), pa.string(), pa.float64())],
                        names=schema.names)

    named = centers.select(shard, F.col("_row").alias("_by"), F.col("_v").alias("_c"))
    return _met(rows, named, shard, per_slice).applyInArrow(run, schema)


def _thinned(k: int, seed: int, shard: str, names: list[str]):
    """k centres from the weighted candidates of a shard.

    Candidates are taken one at a time, far ones by a higher chance, and then moved by full steps.
    """
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_row")
        x, weight = to_matrix(group.column("_v")), group.column("_weight").to_numpy().astype(np.float64)
        name = group.column(shard)[0].as_py()
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        cost = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(k, len(x)):
            chance = weight * cost
            chance[chosen] = 0
            if chance.sum() <= 0:  # copies of chosen rows only
                chance = np.ones(len(x))
                chance[chosen] = 0
            # Of a few drawn rows the one that leaves the least cost.
            drawn = rng.choice(len(x), size=2 + int(np.log(k)), p=chance / chance.sum())
            tried = [np.minimum(cost, ((x - x[i]) ** 2).sum(1)) for i in drawn]
            least = int(np.argmin([weight @ t for t in tried]))
            chosen.append(int(drawn[least]))
            cost = tried[least]
        centers = x[chosen]
        for _ in range(THINNING_STEPS):
            won, _ = _nearest(x, centers)
            mass = np.bincount(won, weights=weight, minlength=len(centers))
            total = np.zeros_like(centers)
            np.add.at(total, won, x * weight[:, None])
            hit = mass > 0
            centers[hit] = total[hit] / mass[hit, None]
        owner = group.column(shard).slice(0, 1).take(pa.array(np.zeros(len(chosen), np.int64)))
        return pa.table([owner, pa.array(np.arange(len(chosen))), to_lists(centers, pa.float64())], names=names)
    return run


def parallel_seeds(rows: DataFrame, k: int, shard: str, seed: int = 0, rounds: int = ROUNDS,
                   drawn: float = DRAWN) -> DataFrame:
    """First centres: ``shard, centroid_id, center``; min(k, rows) for each shard."""
    per_slice = _rows_within(rows, "_v")
    order = Window.partitionBy(shard).orderBy("_digest", "_row")
    # The lowest digest starts; the k lowest ones fill up where too few rows are drawn.
    lowest = stage(rows.select(shard, "_row", "_digest").withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= k))
    chosen = stage(lowest.where("_n = 1").select(shard, "_row"))
    for number in range(rounds):
        centers = stage(rows.join(chosen, [shard, "_row"], "left_semi"))
        cost = stage(_distances(rows, centers, shard, per_slice))
        total = stage(cost.groupBy(shard).agg(F.sum("_cost").alias("_total")))
        luck = _hash_number(hash_key(F.col("_row"), seed + 1 + number)) / F.lit(float(1 << 32))
        new = cost.join(total, shard).where(luck * F.col("_total") < F.lit(drawn * k + MORE) * F.col("_cost"))
        chosen = stage(chosen.unionByName(new.select(shard, "_row")).distinct())
    short = chosen.groupBy(shard).agg(F.count(F.lit(1)).alias("_have")).where(F.col("_have") < k)
    fill = lowest.join(short, shard).select(shard, "_row")
    candidates = stage(rows.join(chosen.unionByName(fill).distinct(), [shard, "_row"], "left_semi").select(
        shard, "_row", "_v"))
    weight = _distances(rows, candidates, shard, per_slice).groupBy(shard, F.col("_by").alias("_row")).agg(
        F.count(F.lit(1)).alias("_weight"))
    weighted = candidates.join(weight, [shard, "_row"], "left").fillna(0, ["_weight"]).withColumn(
        "_weight", F.greatest("_weight", F.lit(1)))
    names = [shard, "centroid_id", "center"]
    schema = T.StructType([rows.schema[shard], T.StructField("centroid_id", T.LongType()),
                           T.StructField("center", T.ArrayType(T.DoubleType()))])
    # Candidates of a shard: about rounds * drawn * k, whatever the shard's size.
    return stage(weighted.groupBy(shard).applyInArrow(_thinned(k, seed, shard, names), schema))


def _step(shard: str, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.table([pa.array([], pa.null())] * len(names), names=names)
        if not left.num_rows:
            return right.select(names)
        right = right.sort_by("centroid_id")
        x, centers = to_matrix(left.column("_v")), to_matrix(right.column("center"))
        weight = right.column("weight").to_numpy().astype(np.float64)
        won, _ = _nearest(x, centers)
        count = np.bincount(won, minlength=len(centers)).astype(np.float64)
        total = np.zeros_like(centers)
        np.add.at(total, won, x)
        hit = np.flatnonzero(count)
        weight[hit] += count[hit]
        centers = centers.copy()
        centers[hit] += (total[hit] - count[hit, None] * centers[hit]) / weight[hit, None]
        return pa.table([right.column(shard), right.column("centroid_id"), to_lists(centers, pa.float64()),
                         pa.array(weight)], names=names)
    return run


def kmeans_minibatch(df: DataFrame, k: int, shard: str = "shard", row: str | Sequence[str] = "row_index",
                     vector: str = "embedding", batch_size: int = BATCH_SIZE, epochs: int = 1,
                     batches: int | None = None, seeding: str = "parallel", seed: int = 0) -> DataFrame:
    """min(k, rows) centroids for each shard: ``shard, centroid_id, center``.

    Every row is dealt to a batch and read once for each of ``epochs``. ``batches`` sets their
    number for each shard in place of ``batch_size``. ``row`` identifies a row of a shard.
    Ties go to the lower centroid; a centre that wins no row stays. All vectors have one
    width; a shard without rows has no centroid.
    """
    if seeding not in ("parallel", "digest"):
        raise ValueError("seeding is 'parallel' or 'digest'")
    key = [row] if isinstance(row, str) else list(row)
    rows = dealt_batches(df, shard, key, vector, batch_size, batches, seed)
    last = rows.agg(F.max("_batch")).first()[0]
    names = [shard, "centroid_id", "center", "weight"]
    schema = T.StructType([df.schema[shard], T.StructField("centroid_id", T.LongType()),
                           T.StructField("center", T.ArrayType(T.DoubleType())),
                           T.StructField("weight", T.DoubleType())])
    if last is None:
        return df.sparkSession.createDataFrame([], T.StructType(schema.fields[:3]))
    if seeding == "digest":
        centers = _start(df, k, shard, key, vector, seed)
    else:
        # Enough batches for three rows to a centre.
        enough = max(1, -(-3 * k // batch_size)) if batches is None else last + 1
        centers = parallel_seeds(rows.where(F.col("_batch") < enough), k, shard, seed)
    centers = stage(centers.withColumn("weight", F.lit(0.0)))
    for _ in range(epochs):
        for number in range(last + 1):
            batch = rows.where(F.col("_batch") == number).select(shard, "_v")
            centers = stage(batch.groupBy(shard).cogroup(centers.groupBy(shard)).applyInArrow(
                _step(shard, names), schema))
    return centers.drop("weight")
