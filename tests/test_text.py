import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths, text
from corpusloom.functions.structs import flatten_struct

SAMPLES = [
    None, "", "   ", "NULL", "null", "NaN", "NULL\n", " NULL", "NULL\n\n", "nullx", "abc",
    "exactly fifteen", "exactly sixteen!", "short", "à é ü — Привет", "under_score", "cost $5",
    "a b c", "   padded \n", "tab\tinside", "five words are in here", "one two three four",
    "😀😀😀 emoji past the fifteenth", "line\nbreak", "x" * 40,
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, c string")


def run(frame, column):
    return [r[0] for r in frame.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_head_and_tail_count_code_points(frame):
    assert run(frame, text.caption_head(F.col("c"))) == [s and s[:15] for s in SAMPLES]
    assert run(frame, text.caption_tail(F.col("c"))) == [s and s[-15:] for s in SAMPLES]


def test_strip_is_unicode_strip(frame):
    assert run(frame, text.strip_blank(F.col("c"))) == [
        None if s is None else s.strip() for s in SAMPLES]


def test_strip_knows_every_blank_character(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    df = spark.createDataFrame([(i, f"{b}a{b}") for i, b in enumerate(blanks)], "i int, c string")
    assert set(run(df, text.strip_blank(F.col("c")))) == {"a"}


def test_min_words(frame):
    assert run(frame, text.has_min_words(F.coalesce("c", F.lit("")))) == [
        len((s or "").split()) >= 5 for s in SAMPLES]


def test_null_like(frame):
    def expected(s):
        if s is None:
            return True
        body = s[:-1] if s.endswith("\n") else s
        return s.strip() == "" or body in ("NULL", "null", "NaN")

    assert run(frame, text.is_null_like(F.col("c"))) == [expected(s) for s in SAMPLES]


def test_charset(frame):
    allowed = {"Ll", "Lu", "Nd", "Po", "Pd", "Zs"}
    assert run(frame, text.is_plain_charset(F.col("c"))) == [
        None if s is None else all(unicodedata.category(x) in allowed for x in s)
        for s in SAMPLES]


def test_clean_caption(spark):
    df = spark.createDataFrame([
        (0, "<start_of_text>a dog ., <end_of_text>rest<end_of_text>"), (1, "plain"), (2, "dots..."),
    ], "i int, c string")
    assert run(df, text.clean_caption(F.col("c"))) == ["a dog", "plain", "dots"]


def test_filler_goes_everywhere_or_at_the_start(spark):
    df = spark.createDataFrame([
        (0, "there is a cat and this is a dog"), (1, "this island"), (2, "  this is it ")],
        "i int, c string")
    assert run(df, text.strip_filler(F.col("c"))) == ["a cat and  a dog", "land", "it"]
    assert run(df, text.strip_filler(F.col("c"), anchored=True)) == [
        "a cat and this is a dog", "land", "it"]


def test_suffix(spark):
    row = spark.range(1).select(text.tag_suffix(
        F.lit("oil"), F.lit("cubism"), F.array(F.lit("x"), F.lit("y"), F.lit("z"))))
    assert row.first()[0] == ", oil, cubism, x, y, z, fine details, masterpiece"


def test_paths(spark):
    row = spark.range(1).select(
        paths.file_id(F.lit("metadata_0042.parquet")),
        paths.part_number(F.lit("dir/index_0042.tar.gz")),
        paths.stem(F.lit("a1b2.png")),
        paths.image_of_key(F.lit("a1b2_17")),
        paths.image_path("/root/", F.lit("part-1"), F.lit("x.webp")),
        paths.png_path("/dir", F.lit("q")),
        paths.moved_path(F.lit("/a/text_emb/text_emb_1.npy"), "/a", "/b", "text_emb", "centroids"),
    ).first()
    assert list(row) == ["0042", "0042", "a1b2", "a1b2", "/root/part-1/x.webp", "/dir/q.png",
                         "/b/centroids/centroids_1.npy"]


def test_flatten_struct(spark):
    df = spark.sql("SELECT 1 AS a, struct(2 AS b, struct(3 AS c, 'x' AS `d.e`) AS n) AS m")
    flat = flatten_struct(df)
    assert flat.columns == ["a", "m.b", "m.n.c", "m.n.d.e"]
    assert list(flat.first()) == [1, 2, 3, "x"]
