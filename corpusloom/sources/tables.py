"""Readers and writers of captions, image indexes, query lists and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.operators.numbering import group_number, image_number, shard_offsets
from corpusloom.storage import stage

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_captions(spark: SparkSession, path: str | Sequence[str],
                  columns: Sequence[str] = ("row_index", "caption"),
                  recursive: bool = False, glob: str = "*.parquet") -> DataFrame:
    """The named columns of caption files and the file each row is from, as ``shard``.

    The position of a row in its file must be one of the columns: files are
    split between tasks, so reading order says nothing.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
    paths = [path] if isinstance(path, str) else list(path)
    return reader.parquet(*paths).select(
        F.col("_metadata.file_name").alias("shard"), *columns)


def read_positions(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                   chunk: int | None = None, over_all: bool = True, recursive: bool = False,
                   glob: str = "*.parquet") -> DataFrame:
    """Columns of parquet files with the position of each row, taken from the files themselves.

    Appends ``shard`` (file name), ``row_index`` (place in the file), ``position`` over all files in
    the order of their paths (with ``over_all``), and the number of the ``chunk`` of so many
    consecutive rows of the file. Rows aren't sorted or shuffled: files are counted from
    their footers, and the counts are a small side of a join.
    """
    if chunk is not None and chunk <= 0:
        raise ValueError("chunk size must be positive")
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob)
    read = reader.parquet(*([path] if isinstance(path, str) else path))
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    rows = read.select(*columns, file.alias("_file"), F.col("_metadata.file_name").alias("shard"),
                       place.alias("row_index"))
    made = [*columns, "shard", "row_index"]
    if over_all:
        offsets = stage(shard_offsets(read.select(file.alias("_file")), "_file"))
        rows = rows.join(offsets, "_file").withColumn("position", F.col("row_offset") + F.col("row_index"))
        made.append("position")
    if chunk is not None:
        rows = rows.withColumn("chunk", F.floor(F.col("row_index") / chunk).cast("bigint"))
        made.append("chunk")
    return rows.select(*made)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and doubled quotes; empty fields are null."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.IMAGE_INDEX)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.QUERY_LIST)


def explode_part(df: DataFrame, part: Column, json: Column) -> DataFrame:
    """One row per image of part metadata: ``part, img_name, prompt, steps``."""
    parsed = F.from_json(json, schemas.PART_METADATA, {"mode": "FAILFAST"})
    return df.select(part.alias("part"), F.explode(parsed).alias("img_name", "m")).select(
        "part", "img_name", F.col("m.p").alias("prompt"), F.col("m.st").alias("steps"))


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    """The images of all ``{part}/{part}.json`` files below ``root``.

    One file is one value; a part is a folder of some thousand images.
    """
    files = spark.read.text(
        root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    part = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    return explode_part(files, part, F.col("value"))


def build_image_index(images: DataFrame) -> DataFrame:
    """Append ``part_id`` and ``image_number``; parts and images count from 0."""
    with_part = group_number(images, "part", "part_id").withColumn(
        "part_id", F.col("part_id").cast("int"))
    return image_number(with_part)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.KEYWORDS).parquet(path)


def write_chunks(df: DataFrame, path: str, shard: str = "shard", chunk: str = "chunk") -> None:
    """Parquet, a folder per shard and chunk.

    Rows are spread by both columns, so one task writes one chunk and a large
    shard is written by many tasks.
    """
    df.repartition(shard, chunk).write.mode("overwrite").partitionBy(shard, chunk).parquet(path)


def write_batches(df: DataFrame, path: str, batch: str = "batch", max_records: int = 0) -> None:
    """Parquet, a folder per batch; ``max_records`` limits the rows of a file.

    Rows are gathered by batch first, so that a task doesn't write a file for every batch; a
    batch of any size spreads over several tasks.
    """
    df.hint("rebalance", batch).write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(
        batch).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become JSON text, since CSV has no array type."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").options(
        header=True, quote='"', escape='"').csv(path)
