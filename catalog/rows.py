"""Deduplication, numbering, chunks, samples, splits, joins by key and aggregates."""

from pyspark.sql import functions as F

from catalog.inputs import (
    CAPTIONS,
    ELEMENTS,
    INDEX,
    VECTORS,
    captions,
    index,
    table,
    vectors,
)
from catalog.registry import query, r4, sql_r4, with_tables
from corpusloom.functions import vectors as vec
from corpusloom.operators import dedup, ensemble, numbering, split, take


def _dedup_sql(scope: str) -> str:
    return with_tables(CAPTIONS, f"""work AS (
  SELECT shard, row_index, left(caption, 15) AS head, right(caption, 15) AS tail,
         (dense_rank() OVER (ORDER BY shard) - 1) // 4 AS batch FROM cap)""", f"""heads AS (
  SELECT * FROM work
  QUALIFY row_number() OVER (PARTITION BY {scope}head ORDER BY shard, row_index) = 1)""") + f"""
SELECT shard, row_index, head, tail FROM heads
QUALIFY row_number() OVER (PARTITION BY {scope}tail ORDER BY shard, row_index) = 1"""


@query("dedup_global", _dedup_sql(""))
def dedup_global(spark, sf):
    return dedup.dedup_head_tail(captions(spark, sf), keep_work_columns=True).drop("caption")


@query("dedup_batch", _dedup_sql("batch, "))
def dedup_batch(spark, sf):
    return dedup.dedup_head_tail(
        captions(spark, sf), scope="batch", keep_work_columns=True).drop("caption", "batch")


@query("ordered_distinct", """
SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id""")
def ordered_distinct(spark, sf):
    return dedup.ordered_distinct(table(spark, sf, "events"), "user_id", "event_id")


@query("group_number", with_tables(INDEX) + """
SELECT img_name, part, (dense_rank() OVER (ORDER BY part) - 1)::BIGINT AS part_id FROM idx""")
def group_number(spark, sf):
    return numbering.group_number(index(spark, sf).select("img_name", "part"), "part", "part_id")


@query("image_number", with_tables(INDEX) + """
SELECT part, img_name, (row_number() OVER (ORDER BY part, img_name) - 1)::BIGINT AS image_number
FROM idx""")
def image_number(spark, sf):
    return numbering.image_number(index(spark, sf).select("part", "img_name"))


@query("topk_merge", """
SELECT user_id AS query_id, event_id AS doc_id, value AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
  FROM events)
WHERE rank <= 5""")
def topk_merge(spark, sf):
    from corpusloom.operators.nearest import topk_merge as merge

    found = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"),
        F.col("value").alias("score"))
    return merge(found, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("chunk_fixed", with_tables(CAPTIONS) + """
SELECT shard, row_index,
       ((row_number() OVER (PARTITION BY shard ORDER BY row_index) - 1) // 7)::BIGINT AS chunk
FROM cap""")
def chunk_fixed(spark, sf):
    return numbering.chunk_fixed(captions(spark, sf).select("shard", "row_index"), 7)


@query("rechunk", """
WITH s AS (SELECT count(*) AS n, (count(*) + 698) // 699 AS k FROM events),
p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, n // k AS q, n % k AS r
      FROM events, s)
SELECT event_id, 'chunk_' || lpad(c::VARCHAR, greatest(3, length(c::VARCHAR))::INTEGER, '0') AS chunk
FROM (SELECT event_id, 1 + CASE WHEN i < r * (q + 1) THEN i // (q + 1)
                               ELSE r + (i - r * (q + 1)) // q END AS c FROM p)""")
def rechunk(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return numbering.rechunk(events, 699, ["event_id"], prefix="chunk")


@query("shard_offsets", with_tables(CAPTIONS) + """
SELECT shard, n_rows, coalesce(sum(n_rows) OVER (
    ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_offset
FROM (SELECT shard, count(*) AS n_rows FROM cap GROUP BY shard)""")
def shard_offsets(spark, sf):
    return numbering.shard_offsets(captions(spark, sf))


@query("concat_shards", """
WITH u AS (
  SELECT 'a' || vec_id % 4 AS shard, vec_id // 4 AS row_index, embedding FROM embeddings
  UNION ALL SELECT 'b' || vec_id % 3, vec_id // 3, embedding FROM embeddings)
SELECT shard, row_index, len(embedding)::BIGINT AS dim,
       (row_number() OVER (ORDER BY shard, row_index) - 1)::BIGINT AS global_index FROM u""")
def concat_shards(spark, sf):
    v = table(spark, sf, "embeddings")

    def shards(prefix, n):
        return v.select(
            F.concat(F.lit(prefix), (F.col("vec_id") % n).cast("string")).alias("shard"),
            F.floor(F.col("vec_id") / n).cast("bigint").alias("row_index"), "embedding")

    joined = numbering.concat_shards([shards("a", 4), shards("b", 3)])
    return joined.select(
        "shard", "row_index", F.size("embedding").cast("bigint").alias("dim"), "global_index")


@query("corpus_stats", with_tables(VECTORS) + """
SELECT count(*) AS n_rows, count(DISTINCT shard) AS n_files,
       min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim FROM vec""")
def corpus_stats(spark, sf):
    return numbering.corpus_stats(vectors(spark, sf))


_DIGEST = "md5('{seed}:' || {key})"
_NUMBER = "('0x' || left(" + _DIGEST + ", 8))::BIGINT"


@query("sample_n", f"""
SELECT event_id, event_type, value FROM events
ORDER BY {_DIGEST.format(seed=7, key='event_id')}, event_id LIMIT 250""")
def sample_n(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return split.sample_n(events, 250, "event_id", seed=7)


@query("split_hash", f"""
SELECT doc_id, {_NUMBER.format(seed=3, key='doc_id')} < 429496729 AS is_test FROM documents""")
def split_hash(spark, sf):
    return split.split_hash(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, seed=3)


@query("split_contiguous", """
SELECT event_id, row_number() OVER (ORDER BY event_id) - 1
       < floor((SELECT count(*) FROM events) * 0.9::DOUBLE) AS is_train FROM events""")
def split_contiguous(spark, sf):
    return split.split_contiguous(
        table(spark, sf, "events").select("event_id"), 0.9, ["event_id"])


@query("bootstrap", f"""
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings),
draws AS (SELECT i AS draw, ('0x' || left({_DIGEST.format(seed=11, key='i')}, 15))::BIGINT
            % (SELECT count(*) FROM embeddings) AS r
          FROM range((SELECT count(*) FROM embeddings)) u(i))
SELECT draw, vec_id, label FROM draws JOIN numbered USING (r)""")
def bootstrap(spark, sf):
    return split.bootstrap(table(spark, sf, "embeddings"), "vec_id", seed=11).select(
        "draw", "vec_id", "label")


_SPLIT = with_tables(INDEX, """usable AS (
  SELECT * FROM idx WHERE steps = 50 AND prompt IS NOT NULL)""", f"""val AS (
  SELECT * FROM usable ORDER BY {_DIGEST.format(seed=5, key='doc_id')}, doc_id LIMIT 20)""",
    f"""train AS (
  SELECT * FROM usable u
  WHERE NOT EXISTS (SELECT 1 FROM val v WHERE left(v.prompt, 20) = left(u.prompt, 20))
    AND NOT EXISTS (SELECT 1 FROM val v WHERE v.doc_id = u.doc_id)
  ORDER BY {_DIGEST.format(seed=6, key='doc_id')}, doc_id LIMIT 300)""")


@query("train_val_split", _SPLIT + """
SELECT 'train' AS part_of, doc_id, part, img_name, prompt FROM train
UNION ALL SELECT 'validation', doc_id, part, img_name, prompt FROM val""")
def train_val_split(spark, sf):
    sets = split.train_val_split(index(spark, sf), 20, 300, "doc_id", seed=5)
    columns = ["part_of", "doc_id", "part", "img_name", "prompt"]
    return sets.train.withColumn("part_of", F.lit("train")).select(columns).unionByName(
        sets.validation.withColumn("part_of", F.lit("validation")).select(columns))


def _labelled(spark, sf):
    """Prompts of documents labelled good, as a validation set."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return index(spark, sf).join(good, "doc_id")


_VALIDATION = """val AS (
  SELECT prompt FROM idx JOIN labels USING (doc_id) WHERE quality = 1 AND prompt IS NOT NULL)"""


@query("anti_prefix", with_tables(INDEX, _VALIDATION) + """
SELECT doc_id, part FROM idx WHERE NOT EXISTS (
  SELECT 1 FROM val WHERE left(val.prompt, 20) = left(idx.prompt, 20))""")
def anti_prefix(spark, sf):
    return split.exclude_prompts(index(spark, sf), _labelled(spark, sf)).select("doc_id", "part")


@query("anti_literal", with_tables(INDEX, _VALIDATION) + """
SELECT doc_id, part FROM idx WHERE NOT EXISTS (
  SELECT 1 FROM val WHERE val.prompt = left(idx.prompt, 20))""")
def anti_literal(spark, sf):
    return split.exclude_prompts(
        index(spark, sf), _labelled(spark, sf), mode="literal").select("doc_id", "part")


@query("take_vectors", with_tables(VECTORS) + f"""
SELECT l.doc_id % 4 AS shard, l.doc_id AS row_index, l.toxic,
       {sql_r4('list_sum(v.embedding)')} AS total
FROM labels l JOIN vec v ON l.doc_id = v.row_index AND l.doc_id % 4 = v.shard
WHERE l.quality = 1""")
def take_vectors(spark, sf):
    meta = table(spark, sf, "labels").where("quality = 1").select(
        (F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("row_index"), "toxic")
    taken = take.take_vectors(meta, vectors(spark, sf).drop("label"), strict=False)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return taken.select("shard", "row_index", "toxic", r4(total).alias("total"))


@query("pair_vectors", with_tables(VECTORS) + f"""
SELECT coalesce(v.shard, l.doc_id % 4) AS shard, coalesce(v.row_index, l.doc_id) AS row_index,
       {sql_r4('list_sum(v.embedding)')} AS text_total,
       (l.quality + l.toxic)::DOUBLE AS image_total
FROM vec v FULL JOIN labels l ON l.doc_id = v.row_index AND l.doc_id % 4 = v.shard""")
def pair_vectors(spark, sf):
    other = table(spark, sf, "labels").select(
        (F.col("doc_id") % 4).alias("shard"), F.col("doc_id").alias("row_index"),
        F.array("quality", "toxic").cast("array<double>").alias("embedding"))
    paired = take.pair_vectors(vectors(spark, sf), other, ("text", "image"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return paired.select("shard", "row_index", r4(total("text")).alias("text_total"),
                         total("image").alias("image_total"))


@query("union_models", """
SELECT 'documents' AS model, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations""")
def union_models(spark, sf):
    return ensemble.union_models({
        "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
        "benchmark": table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        "conversations": table(spark, sf, "conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"),
    })


@query("mean_pool", with_tables(VECTORS, ELEMENTS) + f"""
SELECT label, (pos - 1)::BIGINT AS pos, {sql_r4('avg(x)')} AS val FROM el GROUP BY label, pos""")
def mean_pool(spark, sf):
    pooled = ensemble.mean_pool(vectors(spark, sf), ["label"])
    return pooled.select("label", F.posexplode("pooled").alias("pos", "val")).select(
        "label", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


@query("submission_long", with_tables(VECTORS, ELEMENTS) + f"""
SELECT label || '_' || (pos - 1) AS "imgId_eId", {sql_r4('avg(x)')} AS val
FROM el GROUP BY label, pos""")
def submission_long(spark, sf):
    pooled = ensemble.mean_pool(vectors(spark, sf), ["label"])
    return ensemble.submission_long(pooled, "label").select("imgId_eId", r4("val").alias("val"))


@query("weighted_mean", f"""
SELECT l_returnflag, {sql_r4('sum(l_extendedprice * l_quantity) / sum(l_quantity)')} AS loss
FROM lineitem GROUP BY l_returnflag""")
def weighted_mean(spark, sf):
    return ensemble.weighted_mean(
        table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]
    ).select("l_returnflag", r4("weighted_mean").alias("loss"))


_OWN = """own AS (
  SELECT v.row_index, v.embedding AS a, c.center AS b FROM vec v JOIN cen c
  ON v.label = c.centroid_id)"""


def _with_center(spark, sf):
    from catalog.inputs import centroids

    return vectors(spark, sf).join(centroids(spark, sf), F.col("label") == F.col("centroid_id"))


def _vec_sql(expression: str) -> str:
    from catalog.inputs import CENTROIDS

    return with_tables(VECTORS, ELEMENTS, CENTROIDS, _OWN) + (
        f"SELECT row_index, {sql_r4(expression)} AS val FROM own")


@query("vec_dot", _vec_sql("list_dot_product(a, b)"))
def vec_dot(spark, sf):
    return _with_center(spark, sf).select(
        "row_index", r4(vec.dot(F.col("embedding"), F.col("center"))).alias("val"))


@query("vec_l2", _vec_sql("list_distance(a, b)"))
def vec_l2(spark, sf):
    return _with_center(spark, sf).select(
        "row_index", r4(vec.l2_distance(F.col("embedding"), F.col("center"))).alias("val"))


@query("vec_cosine", _vec_sql("list_cosine_similarity(a, b)"))
def vec_cosine(spark, sf):
    return _with_center(spark, sf).select(
        "row_index", r4(vec.cosine(F.col("embedding"), F.col("center"))).alias("val"))


@query("vec_normalize", with_tables(VECTORS, ELEMENTS) + f"""
SELECT el.row_index, (pos - 1)::BIGINT AS pos,
       {sql_r4('x / sqrt(list_dot_product(embedding, embedding))')} AS val
FROM el JOIN vec USING (row_index)""")
def vec_normalize(spark, sf):
    scaled = vectors(spark, sf).select(
        "row_index", F.posexplode(vec.normalize(F.col("embedding"))).alias("pos", "val"))
    return scaled.select("row_index", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


@query("vec_affine", with_tables(VECTORS, ELEMENTS) + f"""
SELECT row_index, (pos - 1)::BIGINT AS pos, {sql_r4('2 * x - 1')} AS val,
       {sql_r4('-x')} AS negated FROM el""")
def vec_affine(spark, sf):
    c = F.col("embedding")
    both = F.arrays_zip(vec.affine(c, 2.0, -1.0).alias("a"), vec.negate(c).alias("n"))
    return vectors(spark, sf).select("row_index", F.posexplode(both).alias("pos", "e")).select(
        "row_index", F.col("pos").cast("bigint").alias("pos"),
        r4(F.col("e.a")).alias("val"), r4(F.col("e.n")).alias("negated"))
