"""The pipeline's stages, each on its own input, against plain-Python versions."""

import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusloom.llm import langid  # noqa: E402

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The small tables with odd rows and columns whose names clash with the operators'."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id = 3").first()
    odd = spark.createDataFrame([
        (None, None, "en", "s", None), (900, "", "fr", "s", 0), (901, "12 34 ...", None, None, 9),
        (902, some.text + " end", some.lang, "s", 1), (3, some.text, some.lang, some.source, some.n_chars),
        (None, some.text, some.lang, "s", 1), (903, "word", "en", "s", 4),
    ], docs.schema)
    docs.unionByName(odd).withColumns({"score": F.lit("x"), "spans": F.lit(1), "_x": F.lit(2)}).repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def results(spark, sf_dir, tmp_path_factory):
    """The input and each stage's result, written and read again."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        step(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(results):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in results[1:-1]:
        assert df.schema == results[0].schema


def test_language_drops_what_has_none(results):
    docs, kept = results[:2]
    model = langid.train(langid.learned_from(docs))
    found = langid.identify(docs.select("doc_id", "text"), model, ["doc_id", "text"]).where(
        "lang_pred <> 'und' AND score >= 0.5")
    assert sorted(map(repr, _rows(kept))) == sorted(map(repr, _rows(found)))
    lost = {t for _, t in _rows(docs)} - {t for _, t in _rows(kept)}
    assert {None, "", "12 34 ..."} == lost


def test_one_document_of_each_class_stays(results):
    docs, kept = _rows(results[1]), _rows(results[2])
    near = brute.near_classes([t for _, t in docs])
    least = {}
    for d, t in docs:
        least.setdefault(near[t], []).append((d is None, d or 0, t))
    assert sorted(near[t] for _, t in kept) == sorted(least)
    for d, t in kept:
        assert (d is None, d or 0) == min(least[near[t]])[:2]


def test_repeated_strings_are_cut(results):
    docs, kept = _rows(results[2]), _rows(results[3])
    gone = brute.removed_bytes(docs)
    want = []
    for d, t in docs:
        flags, raw, parts = gone[d, t], t.encode(), [bytearray()]
        for byte, cut in zip(raw, flags, strict=True):
            if cut:
                parts.append(bytearray())
            else:
                parts[-1].append(byte)
        left = "".join(p.decode(errors="ignore") for p in parts)
        if not any(flags) or left.strip():
            want.append((d, left))
    assert sorted(map(repr, kept)) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in results[3].collect())


def test_contaminated_documents_go(spark, sf_dir, results):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, kept = _rows(results[3]), _rows(results[4])
    want = []
    for d, t in docs:
        words, hit, _ = brute.hits(t, items)
        if not (hit and 20 * hit >= words):
            want.append((d, t))
    assert sorted(map(repr, kept)) == sorted(map(repr, want)) and len(kept) < len(docs)


def test_pieces_hold_all_tokens(results):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in _rows(results[4]):
        ids = [*made.encode(t, add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s:s + 2048], "<u4")
            want.append((d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    got = results[5].collect()
    assert sorted((repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got)) == sorted(
        map(repr, want))


def test_run_gives_the_last_stage(spark, sf_dir, results):
    got = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(
        map(repr, results[5].select(columns).collect()))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_dir).count() == 0
