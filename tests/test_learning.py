import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_nearest import frame

from corpusloom.operators import cluster, quantize, reduce
from corpusloom.plans.reduction import reduce_corpus

RNG = np.random.default_rng(9)


@pytest.fixture(scope="module")
def shards(spark):
    """Four clear clusters; shard 'hot' holds most rows."""
    centers = RNG.normal(size=(4, 8)) * 10
    x = centers[np.arange(900) % 4] + RNG.normal(size=(900, 8)) * 0.1
    names = pa.array(["hot" if i < 700 else "cold" for i in range(900)])
    return x, frame(spark, range(900), x, "row_index", shard=names)


def test_kmeans_clusters_a_whole_shard(shards):
    x, df = shards
    got = cluster.kmeans_shard(df, 16).toPandas()
    assert set(got["shard"]) == {"hot", "cold"}
    for name, part in got.groupby("shard"):
        assert sorted(part["centroid_id"]) == list(range(16))
        own = x[:700] if name == "hot" else x[700:]
        gap = ((own[:, None] - np.stack(part["center"])[None]) ** 2).sum(axis=2).min(axis=1)
        spread = ((own - own.mean(axis=0)) ** 2).sum(axis=1)
        assert gap.mean() < 0.5 * spread.mean()
    # Neither the partitioning nor the way of assignment changes the centres.
    key = ["shard", "centroid_id"]
    a = got.sort_values(key)
    for again in (cluster.kmeans_shard(df.repartition(3), 16), cluster.kmeans_shard(df, 16, max_bytes=64)):
        b = again.toPandas().sort_values(key)
        assert np.allclose(np.stack(a["center"]), np.stack(b["center"]))


def test_final_clusters_are_capped_by_the_points(spark):
    df = frame(spark, range(3), np.eye(3), "centroid_id", "center")
    assert cluster.kmeans_final(df, 50).count() == 3


def test_own_shard_assignment_in_slices_equals_broadcast(shards):
    x, df = shards
    first = cluster.stage(cluster.kmeans_shard(df, 6, max_iter=2))
    small = cluster.assign_own_shard(df, first).toPandas().sort_values("row_index")
    sliced = cluster.assign_own_shard(df, first, slice_rows=150, max_bytes=64).toPandas()
    assert small["centroid_id"].tolist() == sliced.sort_values("row_index")["centroid_id"].tolist()
    table = first.toPandas()
    for i in (0, 10, 750, 899):
        own = table[table["shard"] == ("hot" if i < 700 else "cold")].sort_values("centroid_id")
        gap = ((x[i] - np.stack(own["center"])) ** 2).sum(axis=1)
        assert small["centroid_id"].iloc[i] == gap.argmin()


def test_two_level_clustering(shards):
    x, df = shards
    made = cluster.cluster_two_level(df, 8, 4)
    assert made.assignment.count() == 900
    got = made.assignment.toPandas().sort_values("row_index")["final_id"].to_numpy()
    final = {r[0]: np.array(r[1]) for r in made.final.collect()}
    first = made.first.toPandas()
    assert len(final) == 4 and len(first) == 16 and set(got) <= set(final)
    chosen = made.representatives.toPandas()
    assert len(chosen) == 8
    centers = {r[0]: np.array(r[1]) for r in made.final.collect()}
    for _, r in chosen.iterrows():
        rows = np.arange(700) if r["shard"] == "hot" else np.arange(700, 900)
        gap = np.sqrt(((x[rows] - centers[r["centroid_id"]]) ** 2).sum(axis=1)).astype(np.float32)
        assert rows[gap.argmin()] == r["row_index"]
    inside = cluster.representatives(df, made.final, "cluster").toPandas()
    assert len(inside) == 4
    with pytest.raises(ValueError):
        cluster.representatives(df, made.final, "all")


def test_codebooks_encode_and_search(spark):
    x = RNG.normal(size=(400, 8))
    x[100:250] = x[1]
    df = frame(spark, range(400), x).repartition(4)
    books = cluster.stage(quantize.pq_fit(df, m=4, nbits=3, max_iter=8))
    table = books.toPandas()
    assert sorted(table["part"].unique()) == [0, 1, 2, 3] and len(table) <= 32
    codes = cluster.stage(quantize.pq_encode(df, books, ["doc_id"]))
    coded = np.stack(codes.toPandas().sort_values("doc_id")["codes"])
    decoded = np.empty_like(x)
    for p in range(4):
        own = np.stack(table[table["part"] == p].sort_values("code")["center"])
        part = x[:, 2 * p:2 * p + 2]
        gap = np.sqrt(((part[:, None] - own[None]) ** 2).sum(axis=2)).astype(np.float32)
        assert (coded[:, p] == gap.argmin(axis=1)).all()
        decoded[:, 2 * p:2 * p + 2] = own[coded[:, p]]
    assert ((decoded - x) ** 2).mean() < 0.35 * x.var()
    queries = RNG.normal(size=(9, 8))
    q = frame(spark, range(9), queries, "query_id")
    score = np.sqrt(((queries[:, None] - decoded[None]) ** 2).sum(axis=2)).astype(np.float32)
    expected = {(i, r + 1): int(d) for i in range(9)
                for r, d in enumerate(np.lexsort((np.arange(400), score[i]))[:6])}
    for bound in (1 << 20, 8 * 8 * 4):
        got = quantize.pq_search(codes, q, books, 6, max_bytes=bound).collect()
        assert {(r["query_id"], r["rank"]): r["doc_id"] for r in got} == expected


def test_codes_may_carry_any_number(spark):
    books = frame(spark, [40, 7], [[0.0], [1.0]], "code", "center").withColumn("part", F.lit(0))
    df = frame(spark, [1, 2], [[0.1], [0.9]])
    codes = quantize.pq_encode(df, books, ["doc_id"])
    assert {r[0]: r[1] for r in codes.collect()} == {1: [40], 2: [7]}
    q = frame(spark, [0], [[0.8]], "query_id")
    assert [r["doc_id"] for r in quantize.pq_search(codes, q, books, 1).collect()] == [2]


def test_cells_with_residual_codes_beat_codes_alone(spark):
    from corpusloom.operators.nearest import assign_cells, knn_exact, recall

    x = RNG.normal(size=(600, 8)) + RNG.integers(0, 3, size=(600, 1)) * 8
    df = frame(spark, range(600), x)
    q = frame(spark, range(30), x[:30] + 0.05, "query_id")
    cells = cluster.stage(cluster.fit_cells(df, 6, max_iter=8))
    docs = cluster.stage(assign_cells(df, cells))
    rest = quantize.residuals(docs, cells, ["doc_id"])
    books = cluster.stage(quantize.pq_fit(rest, m=4, nbits=4, max_iter=6))
    codes = quantize.pq_encode(docs, books, ["doc_id"], centroids=cells)
    found = quantize.pq_search(codes, q, books, 5, centroids=cells, nprobe=6)
    assert found.count() == 150
    exact = knn_exact(df, q, 5, "l2")
    assert recall(found, exact).first()[0] > 0.4


def test_reshape_checks_the_width(spark):
    flat = spark.range(12).select(F.lit(0).alias("batch"), F.col("id").alias("pos"),
                                  (F.col("id") * 10).alias("code"))
    got = {r["row_in_batch"]: r["codes"] for r in quantize.reshape_codes(flat, 4).collect()}
    assert got == {0: [0, 10, 20, 30], 1: [40, 50, 60, 70], 2: [80, 90, 100, 110]}
    with pytest.raises(Exception, match="wide"):
        quantize.reshape_codes(flat.where("pos <> 5"), 4).collect()
    with pytest.raises(Exception, match="(?i)overflow"):
        quantize.reshape_codes(flat.withColumn("code", F.lit(70000)), 4).collect()


def test_encoder_rejects_wrong_widths(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, [1.0]), (3, None), (4, [1.0, None])],
                               "id bigint, embedding array<float>")
    layer = reduce.Layer(np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), np.array([0.5, 0.5, 0.5]))
    assert sorted(tuple(r) for r in reduce.encode_mlp(df, [layer], ["id"]).collect()) == [
        (1, [1.5, 0.0, 0.0]), (2, None), (3, None), (4, None)]
    same = reduce.Autoencoder((reduce.Layer(np.eye(2), np.zeros(2), relu=False),), ())
    assert tuple(reduce.reconstruction_mse(df, same, ["id"]).first()) == (0.0, 4, 3)
    _, rejected = reduce.split_by_width(df, 2)
    assert sorted(r[0] for r in rejected.collect()) == [2, 3, 4]


def test_patches_beyond_the_width_are_an_error(spark):
    patches = spark.createDataFrame(
        [(i, p, [float(p)]) for i, n in ((1, 4), (2, 6)) for p in range(n)],
        "image_id long, pos long, embedding array<double>")
    book = spark.createDataFrame([(0, [0.0]), (1, [3.0])], "centroid_id long, center array<double>")
    good = quantize.codebook_codes(patches.where("image_id = 1"), book, 4).collect()
    assert [r["codes"] for r in good] == [[0, 0, 1, 1]]
    with pytest.raises(Exception, match="not 4 patches in image 2"):
        quantize.codebook_codes(patches, book, 4).collect()


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(1)
    layers = [*reduce._start([5, 4, 3], rng, True), *reduce._start([3, 4, 5], rng, False)]
    x = rng.normal(size=(7, 5))
    _, grads = reduce._gradients(x, layers)
    for n, layer in enumerate(layers):
        for slot, part in enumerate((layer.weight, layer.bias)):
            i = tuple(0 for _ in part.shape)
            keep = part[i]
            part[i] = keep + 1e-6
            up, _ = reduce._gradients(x, layers)
            part[i] = keep - 1e-6
            down, _ = reduce._gradients(x, layers)
            part[i] = keep
            assert grads[2 * n + slot][i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def flat_data(spark):
    """Vectors on a plane of three dimensions in a space of ten."""
    x = RNG.normal(size=(400, 3)) @ RNG.normal(size=(3, 10))
    return x, frame(spark, range(400), x, "row_index", shard=pa.array(["s"] * 400))


def test_pca_restores_rank_deficient_data(spark, flat_data):
    x, df = flat_data
    model = reduce.fit_reducer(df, df, 10, 3, "row_index")
    error = reduce.reconstruction_mse(df, model, ["row_index"]).first()[0]
    assert error < 1e-9
    again = reduce.read_weights(reduce.weights_table(spark, model))
    assert reduce.reconstruction_mse(df, again, ["row_index"]).first()[0] == pytest.approx(
        error, abs=1e-12)


def test_mlp_training_lowers_the_error(flat_data):
    x, df = flat_data
    few = df.where("row_index < 200")
    options = dict(hidden=(16,), batch_size=50, learning_rate=0.01, epoch_length=12, seed=3, lanes=2)
    short = reduce.fit_reducer(few, few, 10, 4, "row_index", "mlp", epochs=1, **options)
    start = reduce.reconstruction_mse(few, short, ["row_index"]).first()[0]
    more = reduce.fit_reducer(few, few, 10, 4, "row_index", "mlp", epochs=4, start=short, **options)
    assert reduce.reconstruction_mse(few, more, ["row_index"]).first()[0] < 0.9 * start
    with pytest.raises(ValueError):
        reduce.fit_reducer(few, few, 10, 4, "row_index", "svd")


@pytest.fixture(scope="module")
def curve(spark):
    """Vectors on a bent line in a space of eight dimensions; a third of the rows share one key."""
    t = RNG.uniform(-1, 1, size=600)
    x = np.stack([t, t ** 2, np.abs(t), np.sin(3 * t), np.cos(3 * t), t ** 3, 1 - t, np.cos(2 * t)], axis=1)
    keys = [0 if i < 200 else i for i in range(600)]
    return cluster.stage(frame(spark, keys, x, "row_index"))


CURVED = dict(hidden=(32,), batch_size=32, learning_rate=0.01, epoch_length=40, seed=4, lanes=3)


def _weights(model):
    return np.concatenate([p.ravel() for la in (*model.encoder, *model.decoder)
                           for p in (la.weight, la.bias)])


def test_mlp_beats_pca_on_a_curve_with_two_reads_an_epoch(spark, curve):
    read = {"train": spark.sparkContext.accumulator(0), "validation": spark.sparkContext.accumulator(0)}

    def counted(name):
        def run(batches):
            for b in batches:
                read[name].add(b.num_rows)
                yield b
        return curve.mapInArrow(run, curve.schema)

    model = reduce.fit_mlp(counted("train"), counted("validation"), 8, 2, "row_index", epochs=5, **CURVED)
    assert read["validation"].value == 5 * 600
    assert read["train"].value == 6 * 600  # and once to count the rows
    linear = reduce.fit_pca(curve, 2)
    errors = [reduce.reconstruction_mse(curve, m, []).first()[0] for m in (model, linear)]
    assert errors[0] < 0.5 * errors[1]


def test_training_goes_on_from_written_epochs(spark, curve, tmp_path):
    def fit(folder, epochs, data=curve, **more):
        return reduce.fit_mlp(data, curve, 8, 2, "row_index", epochs=epochs, folder=str(tmp_path / folder),
                              **{**CURVED, "epoch_length": 8, **more})

    whole = fit("whole", 4, keep_epochs=1)
    fit("parts", 2)
    (tmp_path / "parts" / "weights" / "epoch=2").mkdir()  # an epoch that was cut off
    again = fit("parts", 4, curve.repartition(5))
    assert (_weights(whole) == _weights(again)).all()
    assert len(list((tmp_path / "whole" / "weights").glob("epoch=*"))) <= 2
    errors = spark.read.parquet(str(tmp_path / "parts" / "errors")).orderBy("epoch").collect()
    assert [r["epoch"] for r in errors] == [0, 1, 2, 3] and errors[-1]["steps"] == 32
    # Nothing is left to do, so nothing but the weights is read.
    assert (_weights(fit("parts", 4)) == _weights(whole)).all()
    with pytest.raises(ValueError, match="widths"):
        fit("parts", 5, hidden=(7,))


def test_training_without_rows_and_with_wrong_rows(spark, curve):
    none = curve.where("false")
    start = reduce.fit_pca(curve, 2)
    same = reduce.fit_mlp(none, curve, 8, 2, "row_index", start=start, epochs=2)
    assert (_weights(same) == _weights(start)).all()
    made = reduce.fit_mlp(curve, none, 8, 2, "row_index", epochs=1, **{**CURVED, "epoch_length": 2})
    assert np.isfinite(_weights(made)).all()
    wrong = frame(spark, [1], [[1.0, 2.0]], "row_index")
    with pytest.raises(Exception, match="width"):
        reduce.fit_mlp(wrong, curve, 8, 2, "row_index", epochs=1, **{**CURVED, "epoch_length": 2})


def test_whole_reduction(spark, flat_data):
    _, df = flat_data
    extra = frame(spark, [900], [[1.0, 2.0]], "row_index", shard=pa.array(["s"]))
    made = reduce_corpus(df.unionByName(extra), 10, 3)
    assert made.validation_error < 1e-9
    assert made.reduced.count() == 400 and made.rejected.count() == 1
