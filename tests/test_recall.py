"""Recall of the pruned and quantised searches against brute force."""

import pytest
from pyspark.sql import functions as F

from catalog import search
from catalog.inputs import centroids
from corpusloom.operators import nearest, quantize
from corpusloom.storage import stage

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def _tables(spark, sf=SF):
    docs = search._docs(spark, sf)
    sample = search._queries(spark, sf).where("query_id % 20 = 0")
    return docs, sample, stage(centroids(spark, sf))


def test_probes_for_a_recall_of_nine_tenths(spark):
    docs, sample, cells = _tables(spark)
    stored = nearest.store_cells(docs, cells)
    exact = nearest.knn_exact(docs, sample, 5)
    shares = nearest.recall_by_nprobe(stored, sample, cells, 5)
    for n in (3, len(shares)):
        found = nearest.knn_ivf(stored, sample, cells, 5, n)
        assert abs(nearest.recall(found, exact).first()[0] - shares[n - 1]) < 1e-9
    assert shares[-1] == 1
    n = nearest.nprobe_for_recall(stored, sample, cells, 5, 0.9)
    assert nearest.recall(nearest.knn_ivf(stored, sample, cells, 5, n), exact).first()[0] >= 0.9
    assert n == 1 or shares[n - 2] < 0.9


def test_reranked_codes_reach_nine_tenths(spark):
    docs, sample, cells = _tables(spark)
    books = stage(search._books(cells))
    codes = stage(quantize.pq_encode(docs, books, ["doc_id"]))
    exact = nearest.knn_exact(docs, sample, 5, "l2")
    longer = quantize.pq_search(codes, sample, books, docs.count() // 2)
    found = nearest.rerank(longer, docs, sample, 5, "l2")
    assert found.groupBy("query_id").count().where(F.col("count") != 5).count() == 0
    assert nearest.recall(found, exact).first()[0] >= 0.9


@pytest.mark.parametrize(("name", "metric"), [
    ("knn_ivf", "inner_product"), ("knn_ivf_fitted", "inner_product"), ("knn_pruned_ip", "inner_product"),
    ("knn_pruned_cosine", "cosine"), ("knn_pruned_l2", "l2"), ("pq_search", "l2"), ("pq_search_ivf", "l2")])
def test_registered_searches(spark, name, metric, sf=LARGE):
    """Over the queries with an id divisible by 20; bounded searches lose nothing."""
    docs, sample, _ = _tables(spark, sf)
    found = search.QUERIES[name](spark, sf).where("query_id % 20 = 0")
    share = nearest.recall(found, nearest.knn_exact(docs, sample, 5, metric)).first()[0]
    assert share >= (1 if name.startswith("knn_pruned") or name == "pq_search" else 0.9)


@pytest.mark.parametrize("sf", [SF, LARGE])
def test_few_rows_are_scored_again(spark, sf):
    docs, sample, _ = _tables(spark, sf)
    books = stage(quantize.pq_fit(docs, **search.BOOKS))
    codes = stage(quantize.pq_encode(docs, books, ["doc_id"], with_error=True))
    for metric in ("l2", "inner_product"):
        made = quantize.pq_search_bounded(codes, docs, sample, books, 5, metric)
        exact = nearest.knn_exact(docs, sample, 5, metric)
        assert nearest.recall(made.found, exact).first()[0] == 1
        assert made.candidates.count() < 0.1 * docs.count() * sample.count()
