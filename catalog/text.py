"""Scans, projections, filters and text functions."""

from pyspark.sql import functions as F

from catalog.inputs import (
    CAPTIONS,
    INDEX,
    SQL_BLANK,
    captions,
    index,
    prompts,
    table,
)
from catalog.registry import query, with_tables
from corpusloom.functions import paths, text
from corpusloom.functions.structs import flatten_struct
from corpusloom.operators import numbering, split
from corpusloom.sources.tables import explode_part


@query("scan_captions", with_tables(CAPTIONS) + "SELECT shard, row_index, caption FROM cap")
def scan_captions(spark, sf):
    return captions(spark, sf)


@query("json_part_explode",
       with_tables(INDEX) + "SELECT part, img_name, prompt, steps FROM idx")
def json_part_explode(spark, sf):
    entry = F.create_map("img_name", F.struct(F.col("prompt").alias("p"), F.col("steps").alias("st")))
    return explode_part(index(spark, sf), F.col("part"), F.to_json(entry))


@query("file_slice", with_tables(CAPTIONS) + """
SELECT shard, row_index FROM (
  SELECT shard, row_index, dense_rank() OVER (ORDER BY shard) - 1 AS r FROM cap)
WHERE r >= 2 AND r < 7""")
def file_slice(spark, sf):
    return numbering.file_slice(captions(spark, sf).select("shard", "row_index"), 2, 7)


@query("row_range_scan", """
SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id >= (SELECT count(*) FROM documents) // 4
  AND doc_id < (SELECT count(*) FROM documents) * 3 // 4""")
def row_range_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    n = docs.count()
    return split.row_range(docs, n // 4, n * 3 // 4, "doc_id")


@query("head_tail", with_tables(CAPTIONS) + """
SELECT row_index, left(caption, 15) AS head, right(caption, 15) AS tail FROM cap""")
def head_tail(spark, sf):
    c = F.col("caption")
    return captions(spark, sf).select(
        "row_index", text.caption_head(c).alias("head"), text.caption_tail(c).alias("tail"))


@query("filter_steps", with_tables(INDEX) + "SELECT img_name, steps FROM idx WHERE steps = 50")
def filter_steps(spark, sf):
    return split.filter_steps(index(spark, sf)).select("img_name", "steps")


@query("filter_not_null",
       with_tables(INDEX) + "SELECT img_name, prompt FROM idx WHERE prompt IS NOT NULL")
def filter_not_null(spark, sf):
    return split.filter_prompted(index(spark, sf)).select("img_name", "prompt")


@query("strip_ws", with_tables(CAPTIONS) + rf"""
SELECT row_index, regexp_replace(
    chr(160) || chr(9) || caption || chr(133) || ' ',
    '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g') AS stripped
FROM cap""")
def strip_ws(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("caption"), F.lit("\u0085 "))
    return captions(spark, sf).select("row_index", text.strip_blank(padded).alias("stripped"))


@query("min_words", with_tables(CAPTIONS) + rf"""
SELECT row_index, caption FROM cap
WHERE len(list_filter(string_split_regex(caption, '{SQL_BLANK}+'), lambda w: w <> '')) >= 5""")
def min_words(spark, sf):
    return captions(spark, sf).where(text.has_min_words(F.col("caption"))).select(
        "row_index", "caption")


@query("null_like", with_tables(CAPTIONS) + rf"""
SELECT row_index, c FROM (
  SELECT row_index, CASE d.lang WHEN 'es' THEN NULL WHEN 'de' THEN 'NULL' || chr(10)
                                WHEN 'fr' THEN chr(160) || ' ' ELSE caption END AS c
  FROM cap JOIN documents d ON d.doc_id = cap.row_index)
WHERE c IS NOT NULL AND NOT regexp_matches(c, '\A(?:{SQL_BLANK}*|NULL|null|NaN)\n?\z')""")
def null_like(spark, sf):
    lang = F.col("lang")
    c = (F.when(lang == "es", F.lit(None)).when(lang == "de", "NULL\n")
         .when(lang == "fr", "  ").otherwise(F.col("text")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), c.alias("c"))
    return docs.where(~text.is_null_like(F.col("c")))


@query("charset_whitelist", with_tables(CAPTIONS) + r"""
SELECT row_index, regexp_full_match(
    caption, '[\p{Ll}\p{Lu}\p{Nd}\p{Po}\p{Pd}\p{Zs}]*') AS plain FROM cap""")
def charset_whitelist(spark, sf):
    return captions(spark, sf).select(
        "row_index", text.is_plain_charset(F.col("caption")).alias("plain"))


@query("part_range", with_tables(INDEX) + """
SELECT img_name, part_id FROM (
  SELECT img_name, (dense_rank() OVER (ORDER BY part) - 1)::BIGINT AS part_id FROM idx)
WHERE part_id BETWEEN 3 AND 8""")
def part_range(spark, sf):
    numbered = numbering.group_number(index(spark, sf).select("part", "img_name"), "part", "part_id")
    return split.part_range(numbered, 3, 8).select("img_name", "part_id")


@query("image_path", with_tables(INDEX) + """
SELECT doc_id, '/data/images/' || part || '/' || img_name AS path,
       '/data/images/' || doc_id || '.png' AS png FROM idx""")
def image_path(spark, sf):
    return index(spark, sf).select(
        "doc_id",
        paths.image_path("/data/images", F.col("part"), F.col("img_name")).alias("path"),
        paths.png_path("/data/images", F.col("doc_id")).alias("png"))


@query("parse_ids", """
SELECT doc_id, doc_id::VARCHAR AS file_id, doc_id::VARCHAR AS part_number,
       'set_' || source || '_' || doc_id AS stem, source AS image,
       '/out/centroids/centroids_' || doc_id || '.npy' AS moved
FROM documents""")
def parse_ids(spark, sf):
    number = F.col("doc_id").cast("string")
    name = F.concat(F.lit("set_"), F.col("source"), F.lit("_"), number, F.lit(".parquet.gz"))
    return table(spark, sf, "documents").select(
        "doc_id",
        paths.file_id(F.concat(F.lit("metadata_"), number, F.lit(".parquet"))).alias("file_id"),
        paths.part_number(name).alias("part_number"),
        paths.stem(name).alias("stem"),
        paths.image_of_key(paths.long_key(F.col("source"), F.col("doc_id"))).alias("image"),
        paths.moved_path(
            F.concat(F.lit("/in/text_emb/text_emb_"), number, F.lit(".npy")),
            "/in", "/out", "text_emb", "centroids").alias("moved"))


@query("flatten_struct", """
SELECT o_orderkey AS id, o_orderstatus AS state_status, o_orderpriority AS state_rank_priority,
       o_totalprice AS state_rank_price FROM orders""")
def flatten(spark, sf):
    nested = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_orderpriority").alias("priority"),
                     F.col("o_totalprice").alias("price")).alias("rank")).alias("state"))
    return flatten_struct(nested, sep="_")


@query("clean_caption", """
SELECT conv_id, turn, rtrim(replace(string_split(
    '<start_of_text>' || text || ' ., <end_of_text>junk<end_of_text>', '<end_of_text>')[1],
    '<start_of_text>', ''), ' .,') AS cleaned
FROM conversations""")
def clean_caption(spark, sf):
    raw = F.concat(F.lit("<start_of_text>"), F.col("text"),
                   F.lit(" ., <end_of_text>junk<end_of_text>"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.clean_caption(raw).alias("cleaned"))


_FILLED = """pr AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'user' THEN 'there is ' ELSE 'this is ' END || text AS t
  FROM conversations)"""


@query("strip_filler", with_tables(_FILLED) + rf"""
SELECT conv_id, turn,
       regexp_replace(replace(replace(t, 'there is', ''), 'this is', ''),
                      '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g') AS anywhere,
       regexp_replace(regexp_replace(regexp_replace(t, '^{SQL_BLANK}*there is', ''),
                                     '^{SQL_BLANK}*this is', ''),
                      '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g') AS anchored
FROM pr""")
def strip_filler(spark, sf):
    filler = F.when(F.col("model") == "user", "there is ").otherwise("this is ")
    t = F.concat(filler, F.col("text"))
    return prompts(spark, sf).select(
        F.col("image_id").alias("conv_id"), F.col("seq").alias("turn"),
        text.strip_filler(t).alias("anywhere"),
        text.strip_filler(t, anchored=True).alias("anchored"))


@query("tag_suffix", """
SELECT p_partkey, ', ' || p_name || ', ' || p_brand || ', ' || p_type || ', ' || p_size
       || ', ' || p_name || ', fine details, masterpiece' AS suffix FROM part""")
def tag_suffix(spark, sf):
    flavors = F.array("p_type", F.col("p_size").cast("string"), "p_name")
    return table(spark, sf, "part").select(
        "p_partkey", text.tag_suffix(F.col("p_name"), F.col("p_brand"), flavors).alias("suffix"))
