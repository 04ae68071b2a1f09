"""Documents of three and more languages."""

import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from corpusloom.llm import langid  # noqa: E402
from corpusloom.llm.registry import table  # noqa: E402

SF = "/root/testdata/sf0.01"


def _prose(spark):
    docs = table(spark, SF, "documents")
    rows = docs.where("length(text) > 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()
    return docs, {r.lang: r.text for r in rows}


def test_a_text_in_four_languages_is_a_mixture_of_four(spark):
    docs, one = _prose(spark)
    assert len(one) == 4
    mixed = spark.createDataFrame(
        [(1, "\n".join(t[:3000] for t in one.values()))], "doc_id long, text string")
    got = langid.identify(mixed, langid.train(docs)).first()
    assert {m.lang for m in got.mixture} == set(one)
    assert got.score < 0.32


def test_sets_of_any_size_match_a_search_of_all_sizes():
    r = np.random.default_rng(4)
    chance = r.dirichlet(np.full(500, 0.05), 9).T + 1e-4
    chance /= chance.sum(0)
    model = langid.Mixture([f"l{i}" for i in range(9)], chance)
    sizes = [1, 2, 4, 5, 7, 9, 1, 3]
    gram = [r.choice(500, 4000, p=chance[:, :n].mean(1)) for n in sizes]
    share = model.fit(np.repeat(np.arange(len(sizes)), 4000), np.concatenate(gram), len(sizes))
    assert [(row > 0).sum() for row in share] == sizes
    assert np.allclose(share.sum(1), 1)
    for row, n in zip(share, sizes, strict=True):
        assert np.allclose(row[:n], 1 / n, atol=0.06)


def test_pipeline_keeps_documents_of_several_languages(spark, tmp_path):
    docs, one = _prose(spark)
    a, b, c, d = (one[lang] for lang in sorted(one))
    new = "Ma ka hale o ke kumu e noho ana na keiki a pau i ke ahiahi. " * 40
    odd = spark.createDataFrame([
        (90_001, a[:1600] + "\n" + b[:1200] + "\n" + c[:1200], None, "s", 4002),
        (90_002, "\n".join(t[:1500] for t in (a, b, c, d)), None, "s", 6003),
        (90_003, new, None, "s", len(new)),
        (90_004, "12 34 ...", None, "s", 9), (90_005, None, None, "s", None),
    ], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = langid.identify(read, langid.train(langid.learned_from(read)))
    assert {r.doc_id for r in found.where("score < 0.5 AND lang_pred <> 'und'").collect()} >= {90_001, 90_002}
    kept = corpus_pipeline.language(spark, read, str(tmp_path)).where("doc_id > 90000").collect()
    assert {r.doc_id for r in kept} == {90_001, 90_002, 90_003}
