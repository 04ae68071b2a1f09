"""Shards by jump consistent hashing, with gapless slots.

The shard of a row is a function of its key and the number of shards alone, so no
ring table exists, and one more shard takes rows only into itself. A slot numbers
the rows of a shard in the order of their key digest. Numbering sorts narrow rows by
range over (shard, digest, ...), with the row's place in the input as the last sort
key, so a key that a third of the rows share is cut into many ranges; the row's
number inside its range plus the counts of earlier ranges gives the slot. Only those
counts, one row for each range and shard, meet in one place.

Edge cases: a null key is one more key value; rows with the same key share a shard and
get different slots (rows that are equal in all columns are interchangeable); a null
text has size 1 and checksum 0; an empty table gives an empty result. Further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table
from corpusloom.storage import stage

_STEP = "CAST(2862933555777941757 AS DECIMAL(19, 0))"
_WRAP = "CAST(18446744073709551616 AS DECIMAL(20, 0))"


def key_digest(key: Column) -> Column:
    """The first 60 bits of the key's MD5: a stable number for keys of any type."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shard(digest: str, shards: int) -> Column:
    """Jump consistent hash of a column of non-negative longs into ``shards`` buckets.

    Each step multiplies the state as an unsigned 64-bit number (as a decimal, which
    does not overflow) and jumps ahead; the last place below ``shards`` is the shard.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    return F.expr(f"""
        aggregate(sequence(1, {shards}),
          named_struct('k', CAST({digest} AS DECIMAL(20, 0)), 'b', 0L, 'j', 0L),
          (s, x) -> IF(s.j >= {shards}, s, transform(array(
              CAST((s.k * {_STEP} + 1) % {_WRAP} AS DECIMAL(20, 0))), k -> named_struct(
                'k', k, 'b', s.j,
                'j', CAST(floor(CAST(s.j + 1 AS DOUBLE)
                     * (2147483648D / CAST((k div 8589934592) + 1 AS DOUBLE))) AS BIGINT)))[0]),
          s -> CAST(s.b AS INT))""")


def jump_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot and grown_shard (with one more shard)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(raw) + 1).cast("long").alias("_size"),
                       F.crc32(raw).alias("_crc"), key_digest(F.col(key)).alias("_h"))
    placed = rows.select(
        "*", jump_shard("_h", shards).alias("_shard"), jump_shard("_h", shards + 1).alias("_grown"),
        F.monotonically_increasing_id().alias("_at"))
    order = ["_shard", "_h", "_key", "_size", "_crc", "_at"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The place of a row in its range comes from the sorted partition itself; written once,
    # so that counts and rows see the same numbers.
    ranged = stage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "_key", "_size", "_crc", "_shard", "_grown", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    counts = stage(ranged.groupBy(part.alias("_p"), F.col("_shard").alias("_s")).agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                         - F.col("_first")).alias("_shift"))
    joined = ranged.join(offsets, (part == F.col("_p")) & (F.col("_shard") == F.col("_s")))
    return joined.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_id") + F.col("_shift")).alias("slot"),
        F.col("_grown").alias("grown_shard"))


_SQL = """
WITH RECURSIVE tables(i, k, c) AS (
  SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
  FROM tables WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM tables WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
crc AS (SELECT rid, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(
          regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM d, tbl),
jump(rid, key, b) AS (
  SELECT rid, h::UHUGEINT, 0::BIGINT FROM d
  UNION ALL
  SELECT rid, k, floor((b + 1)::DOUBLE * (2147483648::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT rid, b, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k
        FROM jump WHERE b < 17)),
s AS (SELECT rid, max(b) FILTER (b < 16) AS shard, max(b) FILTER (b < 17) AS grown_shard
      FROM jump GROUP BY rid)
SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law,
  shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard
    ORDER BY h, doc_id NULLS FIRST, strlen(text), crc) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM d JOIN crc USING (rid) JOIN s USING (rid)"""


@query("op7_jump_shards", _SQL)
def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jump_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")
