"""The library's inputs made from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import as_double
from corpusloom.operators.ensemble import mean_pool


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def captions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("shard"), F.col("doc_id").alias("row_index"),
        F.col("text").alias("caption"))


CAPTIONS = "cap AS (SELECT source AS shard, doc_id AS row_index, text AS caption FROM documents)"


def index(spark: SparkSession, sf: str) -> DataFrame:
    """An image per document; Spanish ones lack a prompt, long ones took 50 steps."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("part"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".webp")).alias("img_name"),
        F.when(F.col("lang") != "es", F.col("text")).alias("prompt"),
        F.when(F.col("n_chars") >= 1000, 50).otherwise(25).alias("steps"),
        "doc_id")


INDEX = """idx AS (
  SELECT source AS part, doc_id || '.webp' AS img_name,
         CASE WHEN lang <> 'es' THEN text END AS prompt,
         CASE WHEN n_chars >= 1000 THEN 50 ELSE 25 END AS steps, doc_id
  FROM documents)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, in four shards, stretched so that the metrics rank differently."""
    stretch = 1 + F.col("vec_id") % 5
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4).alias("shard"), F.col("vec_id").alias("row_index"),
        F.transform(as_double(F.col("embedding")), lambda x: x * stretch).alias("embedding"),
        F.col("label").cast("bigint").alias("label"))


VECTORS = """vec AS (
  SELECT vec_id % 4 AS shard, vec_id AS row_index, label::BIGINT AS label,
         list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS embedding
  FROM embeddings)"""

# One row per vector element.
ELEMENTS = """el AS (
  SELECT shard, row_index, label, pos, embedding[pos] AS x
  FROM vec, unnest(range(1, len(embedding) + 1)) AS u(pos))"""


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector per label."""
    return mean_pool(vectors(spark, sf), ["label"], name="center").withColumnRenamed(
        "label", "centroid_id")


CENTROIDS = """cen AS (
  SELECT label AS centroid_id, list(m ORDER BY pos) AS center
  FROM (SELECT label, pos, avg(x) AS m FROM el GROUP BY label, pos) GROUP BY label)"""


def shard_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The mean vector per shard and label."""
    return mean_pool(vectors(spark, sf), ["shard", "label"], name="center").withColumnRenamed(
        "label", "centroid_id")


SHARD_CENTROIDS = """scen AS (
  SELECT shard, label AS centroid_id, list(m ORDER BY pos) AS center
  FROM (SELECT shard, label, pos, avg(x) AS m FROM el GROUP BY shard, label, pos)
  GROUP BY shard, label)"""

CATEGORIES = ["medium", "movement", "flavor"]  # fixed values


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """A label per vector label and residue class; the class gives the category."""
    grouped = mean_pool(
        vectors(spark, sf).withColumn("c", F.col("row_index") % 3), ["label", "c"],
        name="embedding")
    number = F.col("label") * 3 + F.col("c")
    return grouped.select(
        F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("c").cast("int")).alias("category"),
        number.alias("label_id"), F.concat(F.lit("t"), number.cast("string")).alias("label"),
        "embedding")


KEYWORDS = """kw AS (
  SELECT CASE c WHEN 0 THEN 'medium' WHEN 1 THEN 'movement' ELSE 'flavor' END AS category,
         label * 3 + c AS label_id, 't' || (label * 3 + c) AS label, list(m ORDER BY pos) AS embedding
  FROM (SELECT label, row_index % 3 AS c, pos, avg(x) AS m FROM el
        GROUP BY label, row_index % 3, pos)
  GROUP BY label, c)"""

TAGS = """near AS (
  SELECT v.row_index AS image_id, k.category, k.label_id, k.label,
         (list_dot_product(v.embedding, k.embedding)
          / (sqrt(list_dot_product(v.embedding, v.embedding))
             * sqrt(list_dot_product(k.embedding, k.embedding))))::FLOAT AS score
  FROM vec v, kw k),
tags AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, category
                               ORDER BY score DESC, label_id) AS rank
  FROM near
  QUALIFY rank <= CASE WHEN category = 'flavor' THEN 3 ELSE 1 END)"""

SUFFIXES = """suf AS (
  SELECT image_id,
         ', ' || max(label) FILTER (category = 'medium')
         || ', ' || max(label) FILTER (category = 'movement')
         || ', ' || string_agg(label, ', ' ORDER BY rank) FILTER (category = 'flavor')
         || ', fine details, masterpiece' AS suffix
  FROM tags GROUP BY image_id)"""


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Generated captions: a conversation is an image, its turns are the prompts."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("image_id"), F.col("turn").alias("seq"),
        F.col("role").alias("model"), "text")


PROMPTS = """pr AS (
  SELECT conv_id AS image_id, turn AS seq, role AS model, text FROM conversations)"""

# Code points that count as blank, as the engine's regular expressions write them.
SQL_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
