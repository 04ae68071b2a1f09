"""A stored index: reopened, extended, and equal to the exact search."""

import numpy as np
import pyarrow as pa
import pytest
from test_nearest import frame

from corpusloom.operators import cluster
from corpusloom.operators.index import build_index, open_index
from corpusloom.operators.nearest import knn_exact

RNG = np.random.default_rng(17)
CODES = {"m": 4, "nbits": 4, "max_iter": 3}


@pytest.fixture(scope="module")
def vectors(spark):
    """Five clusters, one of them with half of all rows."""
    centers = RNG.normal(size=(5, 8)) * 6
    x = centers[np.where(np.arange(500) < 250, 0, np.arange(500) % 5)] + RNG.normal(size=(500, 8))
    return cluster.stage(frame(spark, range(500), x)), cluster.stage(
        frame(spark, range(20), x[::25] + 0.1, "query_id"))


def _found(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(float(r["score"]), 4)) for r in df.collect())


def test_reopened_and_extended_index_equals_the_exact_search(spark, vectors, tmp_path):
    docs, queries = vectors
    folder = str(tmp_path / "index")
    build_index(docs.where("doc_id < 300"), folder, 6, CODES, fit_steps=4)
    first = open_index(spark, folder)
    assert first.parts == {0: 300}
    first.add(docs.where("doc_id >= 300"))
    whole = open_index(spark, folder)
    assert whole.parts == {0: 300, 1: 200}
    whole.check()
    for metric in ("inner_product", "cosine", "l2"):
        assert _found(whole.search(queries, 4, metric)) == _found(knn_exact(docs, queries, 4, metric))
    exact = _found(knn_exact(docs, queries, 4, "l2"))
    assert _found(whole.search(queries, 4, "l2", nprobe=6)) == exact
    assert _found(whole.search_codes(queries, 4, "l2", nprobe=6)) == exact
    # A reader keeps the parts it opened.
    assert _found(first.search(queries, 4, "l2")) == _found(knn_exact(docs.where("doc_id < 300"), queries, 4, "l2"))
    with pytest.raises(ValueError, match="already"):
        build_index(docs, folder)


def test_a_part_that_was_cut_off_is_not_read(spark, vectors, tmp_path):
    docs, queries = vectors
    folder = str(tmp_path / "index")
    build_index(docs.where("doc_id < 400"), folder, 4, fit_steps=2)
    # Ids that are there already: the vectors are written, the line of the part isn't.
    with pytest.raises(ValueError, match="already or comes twice"):
        open_index(spark, folder).add(docs.where("doc_id BETWEEN 390 AND 410"))
    with pytest.raises(ValueError, match="already or comes twice"):
        open_index(spark, folder).add(docs.where("doc_id = 450").unionByName(docs.where("doc_id = 450")))
    index = open_index(spark, folder)
    assert index.parts == {0: 400}
    assert _found(index.search(queries, 3, "l2")) == _found(knn_exact(docs.where("doc_id < 400"), queries, 3, "l2"))
    again = index.add(docs.where("doc_id >= 400"))
    assert again.parts == {0: 400, 1: 100}
    assert _found(again.search(queries, 3, "l2")) == _found(knn_exact(docs, queries, 3, "l2"))
    with pytest.raises(ValueError, match="without codes"):
        again.search_codes(queries)


def test_odd_vectors_and_empty_parts(spark, vectors, tmp_path):
    docs, queries = vectors
    folder = str(tmp_path / "index")
    index = build_index(docs, folder, 4, CODES, fit_steps=2)
    extra = frame(spark, [900], [[1.0, 2.0]], note=pa.array(["x"]))
    none = spark.createDataFrame([(901, None)], "doc_id long, embedding array<double>")
    holed = spark.createDataFrame([(902, [1.0] * 7 + [None])], "doc_id long, embedding array<double>")
    no_id = spark.createDataFrame([(None, [1.0] * 8)], "doc_id long, embedding array<double>")
    for wrong in (extra, none, holed, no_id):
        with pytest.raises(Exception, match="an id is null or a vector isn't 8 numbers wide"):
            index.add(wrong)
    same = index.add(docs.where("false"))
    assert open_index(spark, folder).parts == {0: 500, 1: 0}
    same.check()
    assert _found(same.search(queries, 3)) == _found(knn_exact(docs, queries, 3))
    assert same.search(queries.where("false"), 3).count() == 0
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, str(tmp_path / "nowhere"))


def test_a_part_that_lost_files_is_an_error(spark, vectors, tmp_path):
    docs, _ = vectors
    index = build_index(docs, str(tmp_path / "index"), 4, fit_steps=1)
    index.check()
    wrong = type(index)(spark, index.folder, {0: 501})
    with pytest.raises(ValueError, match="part 0 has 500 rows of vectors, not 501"):
        wrong.check()
