import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster, nearest, quantize
from corpusloom.operators.batches import bounded_block, bounded_blocks

RNG = np.random.default_rng(5)


def frame(spark, ids, matrix, id_col="doc_id", vector="embedding", **extra):
    table = pa.table({id_col: pa.array(ids, pa.int64()),
                      vector: pa.array(list(matrix), pa.list_(pa.float64())), **extra})
    return spark.createDataFrame(table)


def brute(queries, docs, k, metric):
    """Ids 0.. of the best k by float score, lower id first on a tie."""
    if metric == "cosine":
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1), 1e-8)[:, None]
        docs = docs / np.maximum(np.linalg.norm(docs, axis=1), 1e-8)[:, None]
    if metric == "l2":
        score = -np.sqrt(((queries[:, None] - docs[None]) ** 2).sum(axis=2))
    else:
        score = (queries[:, None] * docs[None]).sum(axis=2)
    score = score.astype(np.float32)
    order = [np.lexsort((np.arange(len(docs)), -s))[:k] for s in score]
    return {(q, r + 1): int(d) for q, row in enumerate(order) for r, d in enumerate(row)}


def ranked(df):
    return {(r["query_id"], r["rank"]): r["doc_id"] for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    docs = RNG.normal(size=(700, 12)) * RNG.uniform(0.1, 5, size=(700, 1))
    docs[300:540] = docs[3]  # a third of the rows are copies
    docs[10] = 0.0
    queries = np.concatenate([RNG.normal(size=(20, 12)), docs[3:4], np.zeros((1, 12))])
    return docs, queries


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_exact_search_against_brute_force(spark, data, metric):
    docs, queries = data
    d = frame(spark, range(len(docs)), docs)
    q = frame(spark, range(len(queries)), queries, "query_id")
    expected = brute(queries, docs, 7, metric)
    assert ranked(nearest.knn_exact(d.repartition(9), q, 7, metric)) == expected
    assert ranked(nearest.knn_exact(d.coalesce(1), q, 7, metric)) == expected
    blocks = nearest.knn_exact(d.repartition(3), q, 7, metric, max_bytes=12 * 8 * 5)
    assert ranked(blocks) == expected


def test_scores_follow_the_metric(spark):
    d = frame(spark, [1, 2], [[1.0, 0.0], [3.0, 4.0]])
    q = frame(spark, [0], [[2.0, 0.0]], "query_id")

    def scores(**options):
        return {r["doc_id"]: r["score"] for r in nearest.knn_exact(d, q, 2, **options).collect()}

    assert scores(metric="inner_product") == {1: 2.0, 2: 6.0}
    assert scores(metric="cosine") == pytest.approx({1: 1.0, 2: 0.6})
    assert scores(metric="l2") == pytest.approx({1: 1.0, 2: 17 ** 0.5})
    turned = nearest.knn_exact(d, q, 1, negate_query=True).collect()
    assert [r["doc_id"] for r in turned] == [1]
    with pytest.raises(ValueError):
        nearest.knn_exact(d, q, 1, "manhattan")


def test_fewer_documents_than_k_and_no_queries(spark):
    d = frame(spark, [1, 2], [[1.0], [2.0]])
    q = frame(spark, [0], [[1.0]], "query_id")
    assert nearest.knn_exact(d, q, 5).count() == 2
    assert nearest.knn_exact(d, q.where("false"), 5).count() == 0
    assert nearest.knn_exact(d.where("false"), q, 5).count() == 0


def test_wrong_width_is_an_error(spark):
    d = frame(spark, [1, 2], [[1.0, 2.0], [2.0]])
    q = frame(spark, [0], [[1.0, 1.0]], "query_id")
    with pytest.raises(Exception, match="expected 2"):
        nearest.knn_exact(d, q, 1).collect()


def test_groups_have_their_own_best(spark):
    docs = RNG.normal(size=(200, 4))
    names = pa.array([f"s{i % 3}" for i in range(200)])
    d = frame(spark, range(200), docs, shard=names)
    q = frame(spark, range(5), docs[:5] + 0.01, "query_id")
    got = nearest.knn_exact(d.repartition(4), q, 2, "l2", group="shard").collect()
    assert len(got) == 5 * 2 * 3
    for s in range(3):
        own = np.arange(s, 200, 3)
        expected = brute(docs[:5] + 0.01, docs[own], 2, "l2")
        found = {(r["query_id"], r["rank"]): r["doc_id"] for r in got if r["shard"] == f"s{s}"}
        assert found == {key: int(own[v]) for key, v in expected.items()}


@pytest.mark.parametrize("max_bytes", [1 << 20, 4 * 6 * 8])
def test_nearest_centroid(spark, max_bytes):
    x, c = RNG.normal(size=(500, 6)), RNG.normal(size=(17, 6))
    c[9] = c[4]  # a tie goes to the lower id
    x[0] = c[9]
    df = frame(spark, range(500), x, "row_index").repartition(5)
    cen = frame(spark, range(17), c, "centroid_id", "center")
    got = nearest.assign_nearest(df, cen, ["row_index"], max_bytes=max_bytes).toPandas()
    got = got.sort_values("row_index")
    distance = np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)).astype(np.float32)
    assert got["centroid_id"].tolist() == distance.argmin(axis=1).tolist()
    assert np.allclose(got["distance"], distance.min(axis=1), atol=1e-6)


def test_grouped_centers_skip_most_distances():
    rng = np.random.default_rng(8)
    spots = rng.normal(size=(60, 16)) * 20
    centers = np.repeat(spots, 50, axis=0) + rng.normal(size=(3000, 16))
    centers[77] = centers[2000]  # a tie goes to the lower id
    x = centers[rng.integers(0, 3000, 900)] + rng.normal(size=(900, 16)) * 0.3
    x[0] = centers[77]
    ids = rng.permutation(3000)
    ids[[77, 2000]] = [2999 + 5, 4]
    order = np.argsort(ids)
    at, like, computed = nearest.GroupedCenters.of(centers).nearest(x, centers, ids)
    gap = np.sqrt(((x[:, None] - centers[order][None]) ** 2).sum(axis=2)).astype(np.float32)
    assert (ids[at] == ids[order][gap.argmin(axis=1)]).all()
    assert np.allclose(-like, gap.min(axis=1), atol=1e-5)
    assert computed < 900 * 3000 / 5
    # Without any structure the result is the same.
    centers, x = rng.normal(size=(200, 4)), rng.normal(size=(300, 4))
    at, _, _ = nearest.GroupedCenters.of(centers).nearest(x, centers, np.arange(200))
    gap = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(axis=2)).astype(np.float32)
    assert (at == gap.argmin(axis=1)).all()
    one = nearest.GroupedCenters.of(centers[:1]).nearest(x, centers[:1], np.array([9]))
    assert (one[0] == 0).all()


def test_cells_of_any_number_of_centroids(spark, data):
    docs, _ = data
    d = frame(spark, range(700), docs)
    cells = cluster.stage(cluster.fit_cells(d, 9, max_iter=1))
    whole = nearest.assign_cells(d, cells).select("doc_id", "cell")
    parts = nearest.assign_cells(d, cells, max_bytes=3 * 12 * 8).select("doc_id", "cell")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_pruned_search(spark, data):
    docs, queries = data
    d = frame(spark, range(len(docs)), docs)
    q = frame(spark, range(len(queries)), queries, "query_id")
    cells = cluster.fit_cells(d, 8, max_iter=5)
    placed = nearest.assign_cells(d, cells)
    assert placed.columns == ["doc_id", "embedding", "cell"]
    everything = nearest.knn_ivf(placed, q, cells, 5, 8, "l2")
    exact = nearest.knn_exact(d, q, 5, "l2")
    assert ranked(everything) == ranked(exact)
    some = nearest.knn_ivf(placed, q, cells, 5, 3, "l2")
    share = nearest.recall(some, exact).first()[0]
    assert 0.5 < share <= 1.0
    # Against brute force over the probed cells only.
    centers = np.array([r[1] for r in sorted(cells.collect())])
    cell = np.sqrt(((docs[:, None] - centers[None]) ** 2).sum(axis=2)).astype(np.float32).argmin(1)
    probe = np.sqrt(((queries[:, None] - centers[None]) ** 2).sum(axis=2)).astype(np.float32)
    expected = {}
    for i, query in enumerate(queries):
        own = np.flatnonzero(np.isin(cell, np.argsort(probe[i], kind="stable")[:3]))
        for (_, r), v in brute(query[None], docs[own], 5, "l2").items():
            expected[(i, r)] = int(own[v])
    assert ranked(some) == expected
    blocks = nearest.knn_ivf(placed, q, cells, 5, 3, "l2", max_bytes=12 * 8 * 5)
    assert ranked(blocks) == expected


def test_a_stored_cell_column_prunes_partitions(spark, tmp_path, data):
    docs, queries = data
    d = frame(spark, range(len(docs)), docs)
    cells = cluster.fit_cells(d, 8, max_iter=3)
    nearest.assign_cells(d, cells).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    q = frame(spark, [0], queries[:1], "query_id")
    probes = nearest.probe_cells(q, cells, 2, "query_id", "embedding")
    sliced, _, _ = nearest.dealt(stored, probes, ["doc_id", "embedding"], ["query_id", "embedding"],
                                 "embedding", "embedding", "cell")
    assert "dynamicpruning" in sliced._jdf.queryExecution().executedPlan().toString()
    stored = stored.withColumn("cell", F.col("cell").cast("bigint"))
    assert nearest.knn_ivf(stored, q, cells, 5, 2).count() == 5


@pytest.mark.parametrize("metric", nearest.METRICS)
def test_bounded_cells_lose_nothing(spark, data, metric):
    docs, queries = data
    d = frame(spark, range(len(docs)), docs)
    q = frame(spark, range(len(queries)), queries, "query_id")
    cells = cluster.stage(cluster.fit_cells(d, 12, max_iter=3))
    placed = nearest.store_cells(d, cells)
    for k, first, bound in ((6, 3, 4_000), (800, 1, 1 << 20)):
        made = nearest.knn_pruned(placed, q, cells, k, metric, first=first, max_bytes=bound)
        assert ranked(made.found) == brute(queries, docs, k, metric)
        pairs = made.read.count()
        assert made.read.distinct().count() == pairs <= len(queries) * 12
        assert k < 800 or pairs == len(queries) * placed.select("cell").distinct().count()


def test_far_cells_are_not_read(spark):
    """Tight clusters: a query reads its own and few others."""
    centers = RNG.normal(size=(20, 6)) * 50
    docs = np.repeat(centers, 30, axis=0) + RNG.normal(size=(600, 6))
    d = frame(spark, range(600), docs)
    q = frame(spark, range(40), docs[::15] + 0.1, "query_id")
    cells = frame(spark, range(20), centers, "centroid_id", "center")
    made = nearest.knn_pruned(nearest.store_cells(d, cells), q, cells, 5, "l2")
    assert ranked(made.found) == brute(docs[::15] + 0.1, docs, 5, "l2")
    assert made.read.count() <= 2 * 40


def test_bounded_cells_without_rows(spark, data):
    docs, queries = data
    d, q = frame(spark, range(700), docs), frame(spark, range(22), queries, "query_id")
    cells = cluster.stage(cluster.fit_cells(d, 3, max_iter=1))
    placed = nearest.assign_cells(d, cells)
    assert nearest.knn_pruned(placed, q.where("false"), cells).found.count() == 0
    empty = nearest.knn_pruned(placed.where("false"), q, cells)
    assert empty.found.count() == 0 and empty.read.count() == 0


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_bounded_codes_lose_nothing(spark, data, metric):
    docs, queries = data
    d, q = frame(spark, range(len(docs)), docs), frame(spark, range(len(queries)), queries, "query_id")
    exact = brute(queries, docs, 5, metric)
    for bits, bound in ((2, 1 << 20), (5, 3_000)):
        books = cluster.stage(quantize.pq_fit(d, m=4, nbits=bits, max_iter=3))
        codes = cluster.stage(quantize.pq_encode(d, books, ["doc_id"], with_error=True))
        made = quantize.pq_search_bounded(codes, d, q, books, 5, metric, max_bytes=bound)
        assert ranked(made.found) == exact
        few = quantize.pq_search_bounded(codes.where("doc_id < 3"), d, q, books, 5, metric)
        assert few.found.count() == 3 * len(queries)
    cells = cluster.stage(cluster.fit_cells(d, 4, max_iter=2))
    placed = nearest.store_cells(d, cells)
    books = cluster.stage(quantize.pq_fit(quantize.residuals(placed, cells, ["doc_id"]), m=4, nbits=4, max_iter=3))
    codes = quantize.pq_encode(placed, books, ["doc_id", "cell"], centroids=cells, with_error=True)
    made = quantize.pq_search_bounded(codes, d, q, books, 5, metric, centroids=cells, nprobe=4)
    assert ranked(made.found) == exact


def test_merge_cuts_in_each_task_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "query_id bigint, doc_id bigint, score float")
    plan = nearest.topk_merge(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_search_plan_has_no_pairs(spark, data):
    docs, queries = data
    d, q = frame(spark, range(700), docs), frame(spark, range(22), queries, "query_id")
    plan = nearest.knn_exact(d, q)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "FlatMapCoGroupsInArrow" in plan
    # One shuffle for each side, one to merge.
    assert plan.count("Exchange hashpartitioning") == 3


def test_queries_stay_off_the_driver(spark, data, monkeypatch):
    """Neither search collects rows: only counts and single rows reach the driver."""
    docs, queries = data
    d, q = frame(spark, range(700), docs), frame(spark, range(22), queries, "query_id")
    cells = cluster.stage(cluster.fit_cells(d, 4, max_iter=1))
    placed = nearest.store_cells(d, cells)
    seen = []
    kind = type(d)
    plain = kind.toArrow

    def watched(df):
        seen.append(df.columns)
        return plain(df)

    monkeypatch.setattr(kind, "toArrow", watched)
    monkeypatch.setattr(kind, "toPandas", lambda df: pytest.fail("collected"))
    exact = nearest.knn_exact(d, q, 5, "l2", max_bytes=1000)
    pruned = nearest.knn_ivf(placed, q, cells, 5, 4, "l2", max_bytes=1000)
    assert all("query_id" not in c and "doc_id" not in c for c in seen)
    assert ranked(exact) == ranked(pruned)


def test_bounds_are_checked(spark, data):
    docs, _ = data
    d = frame(spark, range(700), docs)
    with pytest.raises(ValueError, match="bound"):
        bounded_block(d, "doc_id", "embedding", max_bytes=1000)
    blocks = list(bounded_blocks(d, "doc_id", "embedding", max_bytes=100 * 12 * 8))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == 700


def test_block_search_in_tiles(monkeypatch):
    """Copies, ties and rows over many tiles; the products take little memory at any size."""
    import tracemalloc
    docs = np.round(RNG.normal(size=(4000, 6)) * 2)
    docs[500:900] = docs[3]
    queries = np.concatenate([np.round(RNG.normal(size=(90, 6))), docs[3:4], np.zeros((1, 6))])
    for metric in nearest.METRICS:
        for k in (1, 5, 30):
            qi, di, _ = nearest.best_in_block(queries, docs, np.arange(len(docs)), k, metric)
            expected = brute(queries, docs, k, metric)
            assert [expected[q, r + 1] for q in range(len(queries)) for r in range(k)] == di.tolist()
            assert qi.tolist() == np.repeat(np.arange(len(queries)), k).tolist()
    many = RNG.normal(size=(3000, 6))
    tracemalloc.start()
    nearest.best_in_block(many, docs, np.arange(len(docs)), 5, "cosine")
    assert tracemalloc.get_traced_memory()[1] < 32e6  # all products at once are 96 MB
    tracemalloc.stop()


def test_comparisons_are_bounded_by_rows_and_have_tasks(spark, data, monkeypatch):
    """Time follows the pairs: neither bytes nor coalescing decide how many a task has."""
    docs, queries = data
    d, q = frame(spark, range(700), docs), frame(spark, range(22), queries, "query_id")
    exact = brute(queries, docs, 5, "l2")
    monkeypatch.setattr(nearest, "PIECE_ROWS", 100)
    monkeypatch.setattr(nearest, "TASK_PAIRS", 100)
    cells = cluster.stage(cluster.fit_cells(d, 2, max_iter=1))
    placed = nearest.store_cells(d, cells)
    probes = nearest.probe_cells(q, cells, 2, "query_id", "embedding")
    for pair in ((d, q, None), (placed, probes, "cell")):
        left, right, named = nearest.dealt(pair[0], pair[1], ["doc_id", "embedding"], ["query_id", "embedding"],
                                           "embedding", "embedding", pair[2])
        sizes = [r["count"] for r in left.groupBy(*named).count().collect()]
        assert len(sizes) >= 7 and max(sizes) < 200
        assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() >= 4 * 7
    assert ranked(nearest.knn_exact(d, q, 5, "l2")) == exact


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_bounded_codes_form_no_rows_of_pairs(spark, data, metric):
    """Candidates are a share of all pairs: a task scores them and returns k rows for each query."""
    from corpusloom.storage import staged_count
    docs, queries = data
    d, q = frame(spark, range(700), docs), frame(spark, range(22), queries, "query_id")
    books = cluster.stage(quantize.pq_fit(d, m=4, nbits=2, max_iter=2))
    codes = cluster.stage(quantize.pq_encode(d, books, ["doc_id"], with_error=True))
    staged = staged_count()
    made = quantize.pq_search_bounded(codes, d, q, books, 5, metric)
    assert ranked(made.found) == brute(queries, docs, 5, metric)
    assert staged_count() == staged
    left = made.candidates
    assert left.join(made.found, ["query_id", "doc_id"], "left_semi").count() == 5 * len(queries)


def test_code_search_in_tiles():
    """Over many tiles, with copies and with a centroid: the same as whole vectors."""
    docs = np.round(RNG.normal(size=(3000, 6)) * 3, 1)
    docs[700:1000] = docs[3]
    queries, center = np.concatenate([docs[:60], RNG.normal(size=(20, 6))]), docs.mean(axis=0)
    ids = np.arange(len(docs))
    for middle in (None, center):
        rest = docs if middle is None else docs - middle
        books = ([np.arange(9)] * 6, [np.linspace(-8, 8, 9)[:, None]] * 6)
        coded = quantize.encode(rest, books)
        error = np.sqrt(((rest - quantize.decode(coded, books)) ** 2).sum(axis=1))
        for metric in ("l2", "inner_product"):
            _, di, _ = quantize._code_best(queries, middle, coded, error, docs, ids, books, 5, metric)
            expected = brute(queries, docs, 5, metric)
            assert di.tolist() == [expected[q, r + 1] for q in range(len(queries)) for r in range(5)]
