"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``, whatever further columns there are. ``run`` writes each stage's result
to the shared folder and reads it back for the next, so a lost executor costs one stage at
most. There is no SQL for the whole: three of the stages are learned, searched or drawn by
hash; the tests hold it against a brute-force version.

Edge cases are those of the operators. Null ids and repeated rows are allowed: of rows with
the same id and text the near-duplicate stage keeps one. Empty documents give an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontaminate import benchmark_hits, contaminated
from corpusloom.llm.langid import UNKNOWN, identify, learned_from, train
from corpusloom.llm.minhash import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.suffix_dedup import repeated_spans
from corpusloom.storage import drop_staged, stage, staged_count

ORACLE_SQL = None


#: Rows that go to Python at once, unless the session says otherwise: whole texts are wide, and
#: the JVM holds a batch beside the worker that works on it.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` under names that no operator uses, these names, and which is which."""
    if docs.sparkSession.conf.get(_BATCH, None) is None:
        docs.sparkSession.conf.set(_BATCH, str(BATCH_ROWS))
    names = [f"c{i}__" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, dict(zip(docs.columns, names, strict=True))


def _text_key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_h")


def _without(own: DataFrame, text: str, rejected: DataFrame) -> DataFrame:
    """Rows whose text isn't among the rejected keys.

    A verdict on a text holds for all rows with it. Only keys go through Python and back, and the
    written table of rejected ones tells Catalyst its size: a small one is broadcast.
    """
    gone = stage(rejected.select("_h").distinct())
    return own.withColumn("_h", _text_key(text)).join(gone, "_h", "left_anti").select(*own.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language, in however many they are; drops those without one."""
    own, names, of = _renamed(docs)
    model = train(learned_from(own, of["doc_id"]), of["text"], of["lang"])
    found = identify(own.select(_text_key(of["text"]), of["text"]), model, ["_h"], of["text"])
    return _without(own, of["text"], found.where(F.col("lang_pred") == UNKNOWN)).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the smallest id."""
    own, names, of = _renamed(docs)
    doc_id, text = of["doc_id"], of["text"]
    keyed = own.select("*", _text_key(text),
                       F.xxhash64(*[c for c in names if c != text]).alias("_o"))
    winners = near_duplicates(own, doc_id, text).where("first").select(
        F.col("text_md5").alias("_h")).distinct()
    # One row of the winning text, chosen on narrow rows.
    chosen = keyed.select("_h", F.struct(F.col(doc_id).isNull(), doc_id, "_o").alias("_r")).groupBy(
        "_h").agg(F.min("_r").alias("_r")).join(winners, "_h", "left_semi").select(
        "_h", F.col("_r._o").alias("_o"))
    kept = keyed.join(chosen, ["_h", "_o"], "left_semi").dropDuplicates(["_h", "_o"])
    return kept.select(*names).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that also start earlier; drops documents of which nothing is left."""
    own, names, of = _renamed(docs)
    text = of["text"]
    cut = repeated_spans(own, [c for c in names if c != text], of["doc_id"], text, with_text=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"\S"))
    columns = {**{c: F.col(c) for c in names if c != text}, text: F.col("kept_text")}
    if "n_chars" in of:
        columns[of["n_chars"]] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in names]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more stands in benchmark passages."""
    own, _, of = _renamed(docs)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = benchmark_hits(own.select(_text_key(of["text"]), of["text"]), benchmark, ["_h"], of["text"])
    return _without(own, of["text"], found.where(contaminated())).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens."""
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), staged_count()
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        drop_staged(spark, first, -1)  # what the stage read and wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
