"""Mini-batch k-means against full Lloyd steps and a plain version."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_nearest import frame

from catalog.inputs import vectors
from corpusloom.operators import cluster, minibatch

RNG = np.random.default_rng(12)


def inertia(df, centers, shard="shard"):
    """Mean squared distance of each row to its shard's nearest centre."""
    table = centers.toPandas()
    total = rows = 0
    for name, part in df.toPandas().groupby(shard):
        own = np.stack(table[table[shard] == name]["center"])
        x = np.stack(part["embedding"])
        total += ((x[:, None] - own[None]) ** 2).sum(axis=2).min(axis=1).sum()
        rows += len(x)
    return total / rows


@pytest.fixture(scope="module")
def shards(spark):
    """Twelve clusters, some rows repeated; shard 'hot' holds most rows."""
    centers = RNG.normal(size=(12, 8)) * 4
    x = centers[RNG.integers(0, 12, 1500)] + RNG.normal(size=(1500, 8))
    x[100:300] = x[7]
    names = pa.array(["hot" if i < 1200 else "cold" for i in range(1500)])
    return frame(spark, range(1500), x, "row_index", shard=names)


def test_inertia_is_that_of_full_steps(spark, shards):
    tables = [(shards, 12, 100), (vectors(spark, "/root/testdata/sf0.1").drop("label"), 8, 100)]
    for df, k, batch in tables:
        full = inertia(df, cluster.kmeans_shard(df, k, max_iter=10))
        made = minibatch.kmeans_minibatch(df, k, batch_size=batch, epochs=2)
        assert inertia(df, made) <= 1.05 * full


def test_result_does_not_depend_on_the_partitioning(shards):
    key = ["shard", "centroid_id"]
    a, b = (minibatch.kmeans_minibatch(df, 6, batch_size=200).toPandas().sort_values(key)
            for df in (shards, shards.repartition(5)))
    assert (a[key].to_numpy() == b[key].to_numpy()).all()
    assert np.allclose(np.stack(a["center"]), np.stack(b["center"]))
    assert a.groupby("shard").size().to_dict() == {"hot": 6, "cold": 6}


def test_a_step_follows_each_centers_count(spark, shards):
    df = shards.where("shard = 'cold'")
    made = minibatch.kmeans_minibatch(df, 3, batches=3, seeding="digest").orderBy("centroid_id").collect()
    rows = minibatch.dealt_batches(df, "shard", ["row_index"], "embedding", 1, 3, 0).toPandas()
    centers = np.stack(rows.sort_values("_digest")["_v"].tolist())[:3]
    weight = np.zeros(3)
    for number in range(3):
        x = np.stack(rows[rows["_batch"] == number]["_v"].tolist())
        won = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2)).astype(np.float32).argmin(axis=1)
        for c in range(3):
            own = x[won == c]
            for v in own:  # one row after another gives the same place
                weight[c] += 1
                centers[c] = centers[c] + (v - centers[c]) / weight[c]
    assert np.allclose(np.stack([r["center"] for r in made]), centers)


def test_batches_are_read_one_at_a_time(spark, shards):
    rows = minibatch.dealt_batches(shards, "shard", ["row_index"], "embedding", 100, None, 0)
    assert rows.count() == 1500 and rows.select("_row").distinct().count() == 1500
    assert rows.where("shard = 'hot'").agg(F.max("_batch")).first()[0] == 11
    plan = rows.where("_batch = 3").select("_v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_batch" in plan


def test_few_rows_and_none(spark, shards):
    few = shards.where("row_index < 3 OR row_index >= 1498")
    for seeding in ("parallel", "digest"):
        made = minibatch.kmeans_minibatch(few, 4, seeding=seeding)
        assert {r[0]: r[1] for r in made.groupBy("shard").count().collect()} == {"hot": 3, "cold": 2}
    copies = shards.where("row_index >= 100 AND row_index < 300")
    assert minibatch.kmeans_minibatch(copies, 5).count() == 5
    assert minibatch.kmeans_minibatch(shards.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        minibatch.kmeans_minibatch(shards, 4, seeding="first")
