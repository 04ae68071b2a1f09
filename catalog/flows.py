"""Whole flows from input tables to their result."""

from pyspark.sql import functions as F

from catalog.inputs import (
    CAPTIONS,
    ELEMENTS,
    INDEX,
    KEYWORDS,
    PROMPTS,
    SQL_BLANK,
    SUFFIXES,
    TAGS,
    VECTORS,
    captions,
    index,
    keywords,
    prompts,
    vectors,
)
from catalog.registry import query, r4, sql_r4, with_tables
from catalog.rows import _SPLIT
from catalog.search import _FITTED_KNN, _docs, _queries
from corpusloom.operators import ensemble
from corpusloom.operators.numbering import image_number
from corpusloom.plans import diversify, reduction, search, submission, training_set
from corpusloom.storage import stage


def _strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


@query("diverse_vectors", with_tables(CAPTIONS, f"""clean AS (
  SELECT row_index % 4 AS shard, row_index, caption,
         left(caption, 15) AS head, right(caption, 15) AS tail
  FROM (SELECT row_index, {_strip('caption')} AS caption FROM cap)
  WHERE len(list_filter(string_split_regex(caption, '{SQL_BLANK}+'), lambda w: w <> '')) >= 5)""",
    """heads AS (
  SELECT * FROM clean
  QUALIFY row_number() OVER (PARTITION BY head ORDER BY shard, row_index) = 1)""", """kept AS (
  SELECT * FROM heads
  QUALIFY row_number() OVER (PARTITION BY tail ORDER BY shard, row_index) = 1)""", VECTORS) + f"""
SELECT v.shard, v.row_index, k.caption, {sql_r4('list_sum(v.embedding)')} AS total,
       ((row_number() OVER (PARTITION BY v.shard ORDER BY v.row_index) - 1) // 10)::BIGINT AS chunk
FROM kept k JOIN vec v USING (row_index)""")
def diverse_vectors(spark, sf):
    texts = captions(spark, sf).withColumn("shard", F.col("row_index") % 4)
    taken = diversify.diverse_vectors(texts, vectors(spark, sf).drop("label"), chunk_rows=10, strict=False)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return taken.select("shard", "row_index", "caption", r4(total).alias("total"), "chunk")


@query("training_lists", _SPLIT + """
SELECT 'train' AS part_of, '/data/' || part || '/' || img_name AS path, prompt FROM train
UNION ALL SELECT 'validation', '/data/' || part || '/' || img_name, prompt FROM val""")
def training_lists(spark, sf):
    return training_set.training_lists(index(spark, sf), "/data", 20, 300, "doc_id", seed=5)


@query("caption_submission", with_tables(
    VECTORS, ELEMENTS, KEYWORDS, TAGS, SUFFIXES, PROMPTS, f"""said AS (
  SELECT image_id, seq, {_strip(
      "replace(replace(rtrim(text, ' .,') || suffix, 'there is', ''), 'this is', '')")} AS t
  FROM pr JOIN suf USING (image_id))""", f"""tok AS (
  SELECT image_id, seq, md5(w) AS h FROM said,
    unnest(list_filter(string_split_regex(t, '{SQL_BLANK}+'), lambda x: x <> '')) AS u(w))""",
    """sums AS (
  SELECT image_id, seq, ('0x' || left(h, 8))::BIGINT % 384 AS pos,
         sum(CASE WHEN h[9] < '8' THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM tok GROUP BY ALL)""", """norms AS (
  SELECT image_id, seq, sqrt(sum(s * s)) AS n FROM sums GROUP BY image_id, seq)""", """many AS (
  SELECT image_id, count(*) AS n_prompts FROM said GROUP BY image_id)""", """pooled AS (
  SELECT image_id, pos, sum((s / n)::FLOAT::DOUBLE) AS total
  FROM sums JOIN norms USING (image_id, seq) GROUP BY image_id, pos)""") + f"""
SELECT image_id || '_' || p AS "imgId_eId",
       {sql_r4('coalesce(total, 0) / n_prompts')} AS val
FROM many CROSS JOIN range(384) r(p) LEFT JOIN pooled
  ON pooled.image_id = many.image_id AND pooled.pos = p""".replace(
      "SELECT image_id ||", "SELECT many.image_id ||"))
def caption_submission(spark, sf):
    images = vectors(spark, sf).select(F.col("row_index").alias("image_id"), "embedding")
    tags = ensemble.select_tags(images, stage(keywords(spark, sf)))
    made = submission.caption_submission(prompts(spark, sf), ensemble.suffixes(tags))
    return made.select("imgId_eId", r4("val").alias("val"))


@query("search_images", with_tables(*_FITTED_KNN, INDEX, """num AS (
  SELECT *, row_number() OVER (ORDER BY part, img_name) - 1 AS image_number FROM idx)""") + f"""
SELECT query_id, rank, knn.doc_id, {sql_r4('score')} AS score, part, img_name,
  coalesce(steps, -1) AS steps
FROM knn LEFT JOIN num ON image_number = knn.doc_id""")
def search_images(spark, sf):
    numbered = image_number(index(spark, sf).select("part", "img_name", "steps"))
    found = search.search_images(_docs(spark, sf), _queries(spark, sf), numbered, strict=False,
                                 fit_steps=2)
    return found.withColumns({"score": r4("score"), "steps": F.coalesce("steps", F.lit(-1))})


@query("reduce_corpus")
def reduce_corpus(spark, sf):
    made = reduction.reduce_corpus(vectors(spark, sf), 64, 16).reduced
    return made.select("shard", "row_index", F.size("reduced").cast("bigint").alias("dim"))
