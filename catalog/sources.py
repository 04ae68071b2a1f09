"""Readers and writers, over the given files and over tables written to the staging folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import ELEMENTS, INDEX, KEYWORDS, VECTORS, index, keywords, table, vectors
from catalog.registry import query, r4, sql_r4, with_tables
from corpusloom.functions.vectors import to_codes, to_float
from corpusloom.operators.numbering import chunk_fixed
from corpusloom.sources import matrix, tables
from corpusloom.storage import new_path


@query("read_captions", """
SELECT 'documents.parquet' AS file, doc_id, length(text)::BIGINT AS n FROM documents""")
def read_captions(spark, sf):
    read = tables.read_captions(spark, f"{sf.rstrip('/')}/documents.parquet", ["doc_id", "text"])
    # The given table may be one file or a folder of them.
    return read.select(F.lit("documents.parquet").alias("file"), "doc_id",
                       F.length("text").cast("bigint").alias("n"))


@query("csv_index", with_tables(INDEX, """num AS (
  SELECT part, img_name, prompt, steps, dense_rank() OVER (ORDER BY part) - 1 AS part_id,
         row_number() OVER (ORDER BY part, img_name) - 1 AS image_number FROM idx)""") + """
SELECT part, img_name, prompt, steps, part_id::INTEGER AS part_id, image_number FROM num""")
def csv_index(spark, sf):
    """An index written as CSV, line breaks and quotes in its prompts, and read again."""
    path = new_path(spark)
    tables.write_csv(tables.build_image_index(index(spark, sf).drop("doc_id")), path)
    return tables.read_index(spark, path)


@query("csv_queries", """
SELECT conv_id || '_' || turn AS "imgId", text AS prompt FROM conversations""")
def csv_queries(spark, sf):
    path = new_path(spark)
    tables.write_csv(table(spark, sf, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("imgId"), F.col("text").alias("prompt")), path)
    return tables.read_queries(spark, path)


@query("keyword_table", with_tables(VECTORS, ELEMENTS, KEYWORDS) + f"""
SELECT category, label_id, label, {sql_r4('list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE))')} AS total
FROM kw""")
def keyword_table(spark, sf):
    path = new_path(spark)
    keywords(spark, sf).select("category", "label_id", "label", to_float(F.col("embedding")).alias(
        "embedding")).write.parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tables.read_keywords(spark, path).select(
        "category", F.col("label_id").cast("bigint").alias("label_id"), "label", r4(total).alias("total"))


@query("parquet_chunks", with_tables(VECTORS) + """
SELECT shard::BIGINT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY row_index) - 1) // 16 AS chunk,
  row_index FROM vec""")
def parquet_chunks(spark, sf):
    """Chunks written as a folder each and found again by their folders."""
    path = new_path(spark)
    tables.write_chunks(chunk_fixed(vectors(spark, sf).select("shard", "row_index"), 16), path)
    return spark.read.parquet(path).select(
        F.col("shard").cast("bigint").alias("shard"), F.col("chunk").cast("bigint").alias("chunk"),
        "row_index")


@query("vec_cast", with_tables(VECTORS) + f"""
SELECT row_index, i AS pos, {sql_r4('embedding[i + 1]::FLOAT')} AS single,
  round(embedding[i + 1] * 100)::SMALLINT AS code FROM vec, range(64) r(i)""")
def vec_cast(spark, sf):
    both = vectors(spark, sf).select(
        "row_index", to_float(F.col("embedding")).alias("f"),
        to_codes(F.transform("embedding", lambda x: F.round(x * 100))).alias("c"))
    return both.select("row_index", F.posexplode(F.arrays_zip("f", "c")).alias("pos", "e")).select(
        "row_index", F.col("pos").cast("bigint").alias("pos"), r4("e.f").alias("single"),
        F.col("e.c").alias("code"))


#: Bytes of text that are worth a file, and so a task, of their own.
FILE_BYTES = 64 * 1024 * 1024


@query("file_positions", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, length(text)::BIGINT AS n FROM documents""")
def file_positions(spark, sf):
    """Documents written in order, numbered by their places in the files alone."""
    path = new_path(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(4, -(-held // FILE_BYTES))
    docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return tables.read_positions(spark, path, ["doc_id", "text"]).select(
        "doc_id", "position", F.length("text").cast("bigint").alias("n"))


def _written(spark, sf, files):
    path = new_path(spark)
    matrix.write_vectors(vectors(spark, sf).select("row_index", "embedding"), path, order_by="row_index",
                         files=files)
    return path


_TOTAL = sql_r4("list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE))")


def _total():
    return r4(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("total")


@query("matrix_positions", with_tables(VECTORS) + f"""
SELECT row_number() OVER (ORDER BY row_index) - 1 AS position, {_TOTAL} AS total FROM vec""")
def matrix_positions(spark, sf):
    """Vectors written as matrix files and numbered by the manifest when read again."""
    path = _written(spark, sf, 4)
    placed = matrix.with_position(matrix.read_vectors(spark, path), matrix.manifest(spark, path))
    return placed.select("position", _total())


@query("matrix_row_range", with_tables(VECTORS) + f"""
SELECT row_index, total FROM (
  SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, {_TOTAL} AS total FROM vec)
WHERE row_index >= 60 AND row_index < 260""")
def matrix_row_range(spark, sf):
    """A range of rows of a matrix file; only its bytes are read."""
    read = matrix.read_vectors(spark, _written(spark, sf, 1), rowsPerPartition="50")
    return read.where("row_index >= 60 AND row_index < 260").select("row_index", _total())


@query("matrix_manifest", """
SELECT vec_id % 4 AS shard, count(*) AS n_rows, any_value(len(embedding))::BIGINT AS dim,
  coalesce(sum(count(*)) OVER (ORDER BY vec_id % 4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
    AS row_offset FROM embeddings GROUP BY vec_id % 4""")
def matrix_manifest(spark, sf):
    """A folder for each shard, found again by a search below their root."""
    path = new_path(spark)
    docs = vectors(spark, sf)
    for shard in range(4):
        matrix.write_vectors(docs.where(F.col("shard") == shard).select("embedding"), f"{path}/{shard}", files=1)
    found = matrix.manifest(spark, path, recursive="true")
    return found.select(F.substring_index("shard", "/", 1).cast("bigint").alias("shard"),
                        F.col("rows").alias("n_rows"), "dim", F.col("offset").alias("row_offset"))
