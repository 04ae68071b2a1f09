"""Nearest-neighbour search, clustering, quantisation, reduction and embedding."""

import numpy as np
from pyspark.sql import functions as F

from catalog.inputs import (
    CENTROIDS,
    ELEMENTS,
    INDEX,
    KEYWORDS,
    PROMPTS,
    SHARD_CENTROIDS,
    SQL_BLANK,
    SUFFIXES,
    TAGS,
    VECTORS,
    centroids,
    index,
    keywords,
    prompts,
    shard_centroids,
    table,
    vectors,
)
from catalog.registry import QUERIES, query, r4, sql_r4, with_tables  # noqa: F401
from corpusloom.operators import (
    cluster, embed, ensemble, minibatch, nearest, numbering, quantize, reduce, take)
from corpusloom.operators.index import build_index, open_index
from corpusloom.storage import new_path, stage


def _docs(spark, sf):
    return vectors(spark, sf).select(F.col("row_index").alias("doc_id"), "embedding")


def _queries(spark, sf):
    return vectors(spark, sf).select(F.col("row_index").alias("query_id"), "embedding")


def _tidy(df, *extra):
    return df.select(*extra, "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"),
                     r4("score").alias("score"))


_SCORE = {
    "inner_product": ("list_dot_product(q.embedding, d.embedding)", "DESC"),
    "cosine": ("list_cosine_similarity(q.embedding, d.embedding)", "DESC"),
    "l2": ("list_distance(q.embedding, d.embedding)", "ASC"),
}


def _knn(metric: str, source: str = "vec q, vec d") -> str:
    score, order = _SCORE[metric]
    return f"""knn AS (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank
  FROM (SELECT q.row_index AS query_id, d.row_index AS doc_id, ({score})::FLOAT AS score
        FROM {source})
  QUALIFY rank <= 5)"""


_TIDY = f"SELECT query_id, doc_id, rank, {sql_r4('score')} AS score FROM knn"


def _register_exact(name: str, metric: str) -> None:
    @query(name, with_tables(VECTORS, _knn(metric)) + _TIDY)
    def run(spark, sf):
        return _tidy(nearest.knn_exact(_docs(spark, sf), _queries(spark, sf), 5, metric))


_register_exact("knn_exact_ip", "inner_product")
_register_exact("knn_exact_cosine", "cosine")
_register_exact("knn_exact_l2", "l2")


@query("neighbour_meta", with_tables(VECTORS, _knn("inner_product"), INDEX, """num AS (
  SELECT *, row_number() OVER (ORDER BY part, img_name) - 1 AS image_number FROM idx)""") + """
SELECT query_id, rank, knn.doc_id, part, img_name, coalesce(steps, -1) AS steps
FROM knn LEFT JOIN num ON image_number = knn.doc_id""")
def neighbour_meta(spark, sf):
    found = nearest.knn_exact(_docs(spark, sf), _queries(spark, sf))
    wide = take.widen_neighbours(found)
    numbered = numbering.image_number(index(spark, sf).select("part", "img_name", "steps"))
    return take.neighbour_meta(take.explode_neighbours(wide), numbered, strict=False).select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "part", "img_name",
        F.coalesce("steps", F.lit(-1)).alias("steps"))


_NEAR = """near AS (
  SELECT v.shard, v.row_index, c.centroid_id,
         list_distance(v.embedding, c.center)::FLOAT AS d FROM vec v, cen c)"""
_CELL = """cell AS (
  SELECT row_index, centroid_id AS cell FROM near
  QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY d, centroid_id) = 1)"""
_PROBES = """probe AS (
  SELECT row_index, centroid_id AS cell FROM near
  QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY d, centroid_id) <= 3)"""


@query("assign_nearest", with_tables(VECTORS, ELEMENTS, CENTROIDS, _NEAR) + f"""
SELECT shard, row_index, centroid_id, {sql_r4('d')} AS distance FROM near
QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY d, centroid_id) = 1""")
def assign_nearest(spark, sf):
    found = nearest.assign_nearest(
        vectors(spark, sf), stage(centroids(spark, sf)), ["shard", "row_index"])
    return found.withColumn("distance", r4("distance"))


@query("assign_two_hop", with_tables(
    VECTORS, ELEMENTS, CENTROIDS, SHARD_CENTROIDS, """one AS (
  SELECT v.shard, v.row_index, s.centroid_id AS first_id FROM vec v JOIN scen s USING (shard)
  QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY
    list_distance(v.embedding, s.center)::FLOAT, s.centroid_id) = 1)""", """two AS (
  SELECT s.shard, s.centroid_id AS first_id, c.centroid_id AS final_id FROM scen s, cen c
  QUALIFY row_number() OVER (PARTITION BY s.shard, s.centroid_id ORDER BY
    list_distance(s.center, c.center)::FLOAT, c.centroid_id) = 1)""") + """
SELECT shard, row_index, first_id, final_id FROM one JOIN two USING (shard, first_id)""")
def assign_two_hop(spark, sf):
    return cluster.assign_two_hop(
        vectors(spark, sf), stage(shard_centroids(spark, sf)), stage(centroids(spark, sf)))


_REPRESENTATIVES = with_tables(VECTORS, ELEMENTS, CENTROIDS, _NEAR, _CELL)


@query("representatives", _REPRESENTATIVES + f"""
SELECT shard, centroid_id, row_index, {sql_r4('d')} AS distance FROM near
QUALIFY row_number() OVER (PARTITION BY shard, centroid_id ORDER BY d, row_index) = 1""")
def representatives(spark, sf):
    found = cluster.representatives(vectors(spark, sf), stage(centroids(spark, sf)))
    return found.withColumn("distance", r4("distance"))


@query("representatives_in_cluster", _REPRESENTATIVES + f"""
SELECT n.centroid_id, n.shard, n.row_index, {sql_r4('n.d')} AS distance
FROM near n JOIN cell ON cell.row_index = n.row_index AND cell.cell = n.centroid_id
QUALIFY row_number() OVER (PARTITION BY n.centroid_id ORDER BY d, n.shard, n.row_index) = 1""")
def representatives_in_cluster(spark, sf):
    found = cluster.representatives(
        vectors(spark, sf), stage(centroids(spark, sf)), "cluster")
    return found.withColumn("distance", r4("distance"))


def _tags(spark, sf):
    images = vectors(spark, sf).select(F.col("row_index").alias("image_id"), "embedding")
    return ensemble.select_tags(images, stage(keywords(spark, sf)))


_TAGGED = (VECTORS, ELEMENTS, KEYWORDS, TAGS)


@query("tag_topk", with_tables(*_TAGGED) + f"""
SELECT image_id, category, rank, label_id, label, {sql_r4('score')} AS score FROM tags""")
def tag_topk(spark, sf):
    return _tags(spark, sf).withColumns(
        {"rank": F.col("rank").cast("bigint"), "score": r4("score")})


@query("suffix_by_image", with_tables(*_TAGGED, SUFFIXES, PROMPTS) + """
SELECT image_id, seq, model, text || suffix AS text FROM pr JOIN suf USING (image_id)""")
def suffix_by_image(spark, sf):
    return ensemble.attach_suffix(prompts(spark, sf), ensemble.suffixes(_tags(spark, sf)))


@query("suffix_tiled", with_tables(*_TAGGED, SUFFIXES, PROMPTS, """slots AS (
  SELECT *, row_number() OVER (ORDER BY image_id) - 1 AS slot FROM suf)""") + """
SELECT p.image_id, seq, model, text || suffix AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY image_id, seq) - 1 AS j FROM pr) p
JOIN slots ON slot = j % (SELECT count(*) FROM suf)""")
def suffix_tiled(spark, sf):
    return ensemble.attach_suffix(
        prompts(spark, sf), stage(ensemble.suffixes(_tags(spark, sf))), "tiled")


# Quantisation: the codebook of a slice holds the slices of the mean vectors.
PARTS, STEP = 8, 8
_BOOKS = f"""book AS (
  SELECT p AS part, centroid_id AS code, center[p * {STEP} + 1:p * {STEP} + {STEP}] AS center
  FROM cen, range({PARTS}) r(p))"""


def _coded(vector: str = "v.embedding", source: str = "vec v") -> str:
    return f"""codes AS (
  SELECT v.row_index, b.part, b.code
  FROM {source}, book b
  QUALIFY row_number() OVER (PARTITION BY v.row_index, b.part ORDER BY list_distance(
    ({vector})[b.part * {STEP} + 1:b.part * {STEP} + {STEP}], b.center)::FLOAT, b.code) = 1)"""


def _books(centers):
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    return centers.select("centroid_id", "center", parts).select(
        "part", F.col("centroid_id").alias("code"),
        F.slice("center", F.col("part") * STEP + 1, F.lit(STEP)).alias("center"))


@query("pq_encode", with_tables(VECTORS, ELEMENTS, CENTROIDS, _BOOKS, _coded()) + """
SELECT row_index, string_agg(code::VARCHAR, ',' ORDER BY part) AS codes FROM codes
GROUP BY row_index""")
def pq_encode(spark, sf):
    coded = quantize.pq_encode(
        vectors(spark, sf), _books(stage(centroids(spark, sf))), ["row_index"])
    return coded.select("row_index", F.array_join(F.col("codes").cast("array<string>"), ",").alias(
        "codes"))


@query("reshape_codes", with_tables(VECTORS) + """
SELECT label, row_in_batch, string_agg(code::VARCHAR, ',' ORDER BY pos) AS codes FROM (
  SELECT vec_id AS label, i AS pos, i // 16 AS row_in_batch,
         round(embedding[i + 1]::DOUBLE * 1000)::BIGINT AS code
  FROM embeddings, range(64) r(i))
GROUP BY label, row_in_batch""")
def reshape_codes(spark, sf):
    flat = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("batch"), F.posexplode("embedding").alias("pos", "x"))
    coded = flat.withColumn("code", F.round(F.col("x").cast("double") * 1000).cast("int"))
    return quantize.reshape_codes(coded, 16).select(
        F.col("batch").alias("label"), "row_in_batch",
        F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


# An image is a vector, its patches are the slices.
@query("codebook_codes", with_tables(VECTORS, ELEMENTS, CENTROIDS, f"""code AS (
  SELECT v.row_index AS image_id, p AS pos, c.code
  FROM vec v, range({PARTS}) r(p), (SELECT centroid_id * {PARTS} + s AS code,
    center[s * {STEP} + 1:s * {STEP} + {STEP}] AS center FROM cen, range({PARTS}) t(s)) c
  QUALIFY row_number() OVER (PARTITION BY v.row_index, p ORDER BY list_distance(
    v.embedding[p * {STEP} + 1:p * {STEP} + {STEP}], c.center)::FLOAT, c.code) = 1)""")
       + """
SELECT image_id, string_agg(code::VARCHAR, ',' ORDER BY pos) AS codes FROM code
GROUP BY image_id""")
def codebook_codes(spark, sf):
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("pos")
    patches = vectors(spark, sf).select(
        F.col("row_index").alias("image_id"), "embedding", parts).withColumn(
        "embedding", F.slice("embedding", F.col("pos") * STEP + 1, F.lit(STEP)))
    # Every slice of every centre is an entry.
    book = stage(centroids(spark, sf).select("centroid_id", "center", parts).select(
        (F.col("centroid_id") * PARTS + F.col("pos")).alias("centroid_id"),
        F.slice("center", F.col("pos") * STEP + 1, F.lit(STEP)).alias("center")))
    coded = quantize.codebook_codes(patches, book, PARTS)
    return coded.select("image_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias(
        "codes"))


def _weights(out_dim: int, in_dim: int, relu: bool = True) -> reduce.Layer:
    i, j = np.indices((out_dim, in_dim))
    return reduce.Layer(((i * 31 + j * 17) % 13 - 6) / 10.0, (np.arange(out_dim) % 3 - 1) / 10.0,
                        relu)


def _layer_sql(source: str, out_dim: int, in_dim: int, relu: bool) -> str:
    total = (f"list_sum(list_transform(range({in_dim}), lambda j: ((i * 31 + j * 17) % 13 - 6)"
             f" / 10.0::DOUBLE * {source}[j + 1])) + (i % 3 - 1) / 10.0::DOUBLE")
    inner = f"greatest({total}, 0.0)" if relu else total
    return f"list_transform(range({out_dim}), lambda i: {inner})"


_ENCODED = f"""hid AS (SELECT row_index, embedding, {_layer_sql('embedding', 16, 64, True)} AS h
  FROM vec),
enc AS (SELECT row_index, embedding, {_layer_sql('h', 8, 16, True)} AS z FROM hid)"""


@query("encode_mlp", with_tables(VECTORS, _ENCODED) + f"""
SELECT row_index, (i)::BIGINT AS pos, {sql_r4('(z[i + 1])::FLOAT')} AS val
FROM enc, range(8) r(i)""")
def encode_mlp(spark, sf):
    made = reduce.encode_mlp(
        vectors(spark, sf), [_weights(16, 64), _weights(8, 16)], ["row_index"])
    return made.select("row_index", F.posexplode("reduced").alias("pos", "val")).select(
        "row_index", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


@query("reconstruction_mse", with_tables(VECTORS, _ENCODED, f"""dec1 AS (
  SELECT row_index, embedding, {_layer_sql('z', 16, 8, True)} AS h FROM enc)""", f"""dec2 AS (
  SELECT row_index, embedding, {_layer_sql('h', 64, 16, False)} AS y FROM dec1)""") + f"""
SELECT {sql_r4('avg(list_sum(list_transform(range(1, 65), '
               'lambda i: power(y[i] - embedding[i], 2))) / 64.0::DOUBLE)')} AS mse,
  count(*) AS n_rows, 0::BIGINT AS n_rejected FROM dec2""")
def reconstruction_mse(spark, sf):
    model = reduce.Autoencoder((_weights(16, 64), _weights(8, 16)),
                               (_weights(16, 8), _weights(64, 16, False)))
    return reduce.reconstruction_mse(vectors(spark, sf), model, ["row_index"]).withColumn(
        "mse", r4("mse"))


@query("embed_text", rf"""
WITH tok AS (
  SELECT doc_id, md5(w) AS h
  FROM documents, unnest(list_filter(string_split_regex(text, '{SQL_BLANK}+'), lambda x: x <> ''))
    AS u(w)),
sums AS (
  SELECT doc_id, ('0x' || left(h, 8))::BIGINT % 384 AS pos,
         sum(CASE WHEN h[9] < '8' THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM tok GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM sums GROUP BY doc_id)
SELECT doc_id, pos, {sql_r4('(s / n)::FLOAT')} AS val FROM sums JOIN norms USING (doc_id)
WHERE s <> 0""")
def embed_text(spark, sf):
    made = embed.embed_text(table(spark, sf, "documents"), ["doc_id"], text="text")
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "val")).where(
        "val <> 0").select("doc_id", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


def _lloyd_sql(name: str, source: str, k: int, key: str, steps: int, shard: str = "0") -> list[str]:
    """Tables ``{name}0 .. {name}{steps}`` of centres: k lowest digests, then Lloyd steps."""
    parts = [f"""{name}p AS (SELECT {shard} AS s, {key} AS key, embedding FROM {source})""",
             f"""{name}0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || key), key) - 1
  AS id, embedding AS center FROM {name}p QUALIFY id < {k})"""]
    for i in range(steps):
        parts += [f"""{name}a{i} AS (SELECT p.s, p.key, c.id, p.embedding FROM {name}p p JOIN {name}{i} c ON p.s = c.s
  QUALIFY row_number() OVER (PARTITION BY p.s, p.key ORDER BY list_distance(p.embedding, c.center)::FLOAT, c.id) = 1)""",
                  f"""{name}m{i} AS (SELECT s, id, list(m ORDER BY pos) AS center FROM (
  SELECT s, id, pos, avg(embedding[pos]) AS m FROM {name}a{i}, unnest(range(1, 65)) AS u(pos)
  GROUP BY ALL) GROUP BY s, id)""",
                  f"""{name}{i + 1} AS (SELECT c.s, c.id, coalesce(m.center, c.center) AS center
  FROM {name}{i} c LEFT JOIN {name}m{i} m ON c.s = m.s AND c.id = m.id)"""]
    return parts


def _long(df, *keys):
    return df.select(*keys, "centroid_id", F.posexplode("center").alias("pos", "val")).select(
        *keys, "centroid_id", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


_LONG = f"id AS centroid_id, i AS pos, {sql_r4('center[i + 1]')} AS val"
_SHARDED = _lloyd_sql("sh", "vec", 8, "row_index::VARCHAR", 2, "shard")
_ALL = _lloyd_sql("al", "vec", 10, "row_index::VARCHAR", 3)
_CELLS = _lloyd_sql("fc", "vec", 8, "row_index::VARCHAR", 2)
_SECOND = _lloyd_sql("tw", "(SELECT s, id, center AS embedding FROM sh2)", 10,
                     "s || '/' || id", 2)


@query("kmeans_shard", with_tables(VECTORS, *_SHARDED) + f"""
SELECT s AS shard, {_LONG} FROM sh2, range(64) r(i)""")
def kmeans_shard(spark, sf):
    return _long(cluster.kmeans_shard(vectors(spark, sf), 8, max_iter=2), "shard")


def _minibatch_sql(k: int, batches: int) -> list[str]:
    """Tables ``mb0 .. mb{batches}`` of centres and the rows they have won so far."""
    parts = [f"""mbp AS (SELECT shard AS s, row_index::VARCHAR AS key, embedding,
  md5('0:' || row_index) AS digest, ('0x' || left(md5('0:' || row_index), 8))::BIGINT % {batches} AS batch FROM vec)""",
             f"""mb0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY digest, key) - 1 AS id,
  embedding AS center, 0::DOUBLE AS weight FROM mbp QUALIFY id < {k})"""]
    for i in range(batches):
        parts += [f"""mba{i} AS (SELECT p.s, p.key, c.id, p.embedding FROM mbp p JOIN mb{i} c ON p.s = c.s
  WHERE p.batch = {i} QUALIFY row_number() OVER (PARTITION BY p.s, p.key ORDER BY
    list_distance(p.embedding, c.center)::FLOAT, c.id) = 1)""",
                  f"""mbm{i} AS (SELECT s, id, any_value(n) AS n, list(t ORDER BY pos) AS total FROM (
  SELECT s, id, pos, count(*) AS n, sum(embedding[pos]) AS t FROM mba{i}, unnest(range(1, 65)) AS u(pos)
  GROUP BY ALL) GROUP BY s, id)""",
                  f"""mb{i + 1} AS (SELECT c.s, c.id, c.weight + coalesce(m.n, 0) AS weight,
  CASE WHEN m.n IS NULL THEN c.center ELSE list_transform(range(1, 65), lambda j:
    c.center[j] + (m.total[j] - m.n * c.center[j]) / (c.weight + m.n)) END AS center
  FROM mb{i} c LEFT JOIN mbm{i} m ON c.s = m.s AND c.id = m.id)"""]
    return parts


@query("kmeans_minibatch", with_tables(VECTORS, *_minibatch_sql(8, 4)) + f"""
SELECT s AS shard, {_LONG} FROM mb4, range(64) r(i)""")
def kmeans_minibatch(spark, sf):
    return _long(minibatch.kmeans_minibatch(vectors(spark, sf), 8, batches=4, seeding="digest"), "shard")


@query("kmeans_final", with_tables(VECTORS, *_ALL) + f"""
SELECT {_LONG} FROM al3, range(64) r(i)""")
def kmeans_final(spark, sf):
    return _long(cluster.kmeans_final(
        vectors(spark, sf), 10, "embedding", max_iter=3, key=["row_index"]))


@query("cluster_two_level", with_tables(VECTORS, *_SHARDED, *_SECOND, """one AS (
  SELECT v.shard, v.row_index, c.id AS first_id FROM vec v JOIN sh2 c ON v.shard = c.s
  QUALIFY row_number() OVER (PARTITION BY v.row_index ORDER BY
    list_distance(v.embedding, c.center)::FLOAT, c.id) = 1)""", """two AS (
  SELECT a.s AS shard, a.id AS first_id, c.id AS final_id FROM sh2 a, tw2 c
  QUALIFY row_number() OVER (PARTITION BY a.s, a.id ORDER BY
    list_distance(a.center, c.center)::FLOAT, c.id) = 1)""") + """
SELECT shard, row_index, first_id, final_id FROM one JOIN two USING (shard, first_id)""")
def cluster_two_level(spark, sf):
    return cluster.cluster_two_level(vectors(spark, sf), 8, 10, max_iter=2).assignment


FITTED_CELLS = (*_CELLS, """cen AS (SELECT id AS centroid_id, center FROM fc2)""")


def _books_sql(m: int, width: int, entries: int, steps: int) -> list[str]:
    """Tables ``bk0 .. bk{steps}``: the slices of the rows with the lowest digests, then Lloyd steps."""
    parts = [f"""bkp AS MATERIALIZED (SELECT p, row_index AS key, md5('0:' || row_index) AS digest,
  embedding[p * {width} + 1 : (p + 1) * {width}] AS slice FROM vec, range({m}) r(p))""",
             f"""bk0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY slice) - 1 AS code, slice AS center
  FROM (SELECT DISTINCT p, slice FROM (SELECT p, slice FROM bkp
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY digest, key) <= {entries})))"""]
    for i in range(steps):
        parts += [f"""bka{i} AS MATERIALIZED (SELECT bkp.p, code, slice FROM bkp JOIN bk{i} ON bkp.p = bk{i}.p
  QUALIFY row_number() OVER (PARTITION BY bkp.p, key ORDER BY list_distance(slice, center)::FLOAT, code) = 1)""",
                  f"""bkm{i} AS MATERIALIZED (SELECT p, code, list(v ORDER BY pos) AS center FROM (
  SELECT p, code, pos, avg(slice[pos]) AS v FROM bka{i}, unnest(range(1, {width + 1})) AS u(pos)
  GROUP BY ALL) GROUP BY p, code)""",
                  f"""bk{i + 1} AS MATERIALIZED (SELECT b.p, b.code, coalesce(n.center, b.center) AS center
  FROM bk{i} b LEFT JOIN bkm{i} n ON b.p = n.p AND b.code = n.code)"""]
    return parts


@query("pq_fit", with_tables(VECTORS, *_books_sql(8, 8, 32, 5)) + f"""
SELECT p::INT AS part, code, i AS pos, {sql_r4('center[i + 1]')} AS val FROM bk5, range(8) r(i)""")
def pq_fit(spark, sf):
    books = quantize.pq_fit(vectors(spark, sf), m=8, nbits=5, key="row_index", max_iter=5)
    return books.select("part", "code", F.posexplode("center").alias("pos", "val")).select(
        "part", "code", F.col("pos").cast("bigint").alias("pos"), r4("val").alias("val"))


_PROBED = ("vec q JOIN probe USING (row_index) JOIN cell USING (cell) JOIN vec d "
           "ON d.row_index = cell.row_index")


_FITTED_KNN = (VECTORS, *FITTED_CELLS, _NEAR, _CELL, _PROBES, _knn("inner_product", _PROBED))


@query("knn_ivf_fitted", with_tables(*_FITTED_KNN) + _TIDY)
def knn_ivf_fitted(spark, sf):
    cells = cluster.fit_cells(_docs(spark, sf), 8, max_iter=2)
    docs = nearest.store_cells(_docs(spark, sf), cells)
    return _tidy(nearest.knn_ivf(docs, _queries(spark, sf), cells, 5, 3))


def _ten_cells(spark, sf):
    """Ten fitted cells and the documents stored by them."""
    cells = stage(cluster.fit_cells(_docs(spark, sf), 10, max_iter=3))
    return cells, nearest.store_cells(_docs(spark, sf), cells)


# Four of ten cells: a recall of 0.98 on the queries with id % 20 = 0 (tests/test_recall.py).
@query("knn_ivf", with_tables(
    VECTORS, *_ALL, "cen AS (SELECT id AS centroid_id, center FROM al3)", _NEAR, _CELL,
    _PROBES.replace("<= 3", "<= 4"), _knn("inner_product", _PROBED)) + _TIDY)
def knn_ivf(spark, sf):
    cells, docs = _ten_cells(spark, sf)
    return _tidy(nearest.knn_ivf(docs, _queries(spark, sf), cells, 5, 4))


def _register_pruned(name: str, metric: str) -> None:
    """Cells are read until none can hold a better document: the SQL is that of the exact search."""
    @query(name, with_tables(VECTORS, _knn(metric)) + _TIDY)
    def run(spark, sf):
        cells, docs = _ten_cells(spark, sf)
        return _tidy(nearest.knn_pruned(docs, _queries(spark, sf), cells, 5, metric).found)


_register_pruned("knn_pruned_ip", "inner_product")
_register_pruned("knn_pruned_cosine", "cosine")
_register_pruned("knn_pruned_l2", "l2")

# Two parts, written one after the other, and reopened: together they are all vectors.
@query("index_search", with_tables(VECTORS, _knn("l2")) + _TIDY)
def index_search(spark, sf):
    docs, folder = _docs(spark, sf), new_path(spark)
    late = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    build_index(docs.where(~late), folder, 10, fit_steps=3)
    open_index(spark, folder).add(docs.where(late))
    return _tidy(open_index(spark, folder).search(_queries(spark, sf), 5, "l2"))


#: Codebooks of the registered searches: a slice for each dimension, 64 entries each.
BOOKS = {"m": 64, "nbits": 6, "max_iter": 2}


# Errors bound what the codes leave open, so the SQL is that of the exact search.
@query("pq_search", with_tables(VECTORS, _knn("l2")) + _TIDY)
def pq_search(spark, sf):
    docs = _docs(spark, sf)
    books = stage(quantize.pq_fit(docs, **BOOKS))
    codes = stage(quantize.pq_encode(docs, books, ["doc_id"], with_error=True))
    return _tidy(quantize.pq_search_bounded(codes, docs, _queries(spark, sf), books, 5, "l2").found)


# The same for the differences to coarse cells, three of eight fitted ones.
@query("pq_search_ivf", with_tables(
    VECTORS, *FITTED_CELLS, _NEAR, _CELL, _PROBES, _knn("l2", _PROBED)) + _TIDY)
def pq_search_ivf(spark, sf):
    cells = stage(cluster.fit_cells(_docs(spark, sf), 8, max_iter=2))
    docs = nearest.store_cells(_docs(spark, sf), cells)
    books = stage(quantize.pq_fit(quantize.residuals(docs, cells, ["doc_id"]), **BOOKS))
    codes = stage(quantize.pq_encode(docs, books, ["doc_id", "cell"], centroids=cells, with_error=True), ["cell"])
    return _tidy(quantize.pq_search_bounded(
        codes, docs, _queries(spark, sf), books, 5, "l2", centroids=cells, nprobe=3).found)


@query("fit_reducer")
def fit_reducer(spark, sf):
    data = vectors(spark, sf)
    model = reduce.fit_reducer(data, data, 64, 16, "row_index")
    return reduce.reconstruction_mse(data, model, ["row_index"])


# The trained weights have no SQL; that they beat the best constant has: rows, and their mean
# variance, which the error must be under.
@query("fit_reducer_epochs", with_tables(VECTORS) + f"""
SELECT (SELECT count(*) FROM vec) AS n_rows, 0::BIGINT AS n_rejected, {sql_r4('avg(v)')} AS variance,
  TRUE AS below_variance
FROM (SELECT pos, var_pop(embedding[pos]) AS v FROM vec, unnest(range(1, 65)) AS u(pos) GROUP BY pos)""")
def fit_reducer_epochs(spark, sf):
    data = vectors(spark, sf)
    model = reduce.fit_reducer(data, data, 64, 16, "row_index", "mlp", hidden=(48,), epochs=3,
                               epoch_length=40, batch_size=64, learning_rate=0.01, lanes=4)
    error = reduce.reconstruction_mse(data, model, ["row_index"])
    variance = data.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(
        F.var_pop("x").alias("v")).agg(F.avg("v")).first()[0]
    return error.select("n_rows", "n_rejected", r4(F.lit(variance)).alias("variance"),
                        (F.col("mse") < F.lit(variance)).alias("below_variance"))
