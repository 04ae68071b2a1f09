import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import storage
from corpusloom.operators import numbering


@pytest.fixture(scope="module")
def lopsided(spark):
    """Shard 'hot' holds most rows; positions are dense inside each shard."""
    df = spark.range(6000).repartition(7).select(
        F.when(F.col("id") < 5000, "hot").when(F.col("id") < 5900, "b").otherwise("z").alias("shard"),
        F.col("id").alias("row_index"))
    first = F.min("row_index")
    starts = df.groupBy("shard").agg(first.alias("s"))
    return df.join(starts, "shard").select("shard", (F.col("row_index") - F.col("s")).alias("row_index"))


def test_numbers_follow_the_order(lopsided):
    got = numbering.number_rows(lopsided, ["shard", "row_index"], "n").toPandas()
    got = got.sort_values(["shard", "row_index"])
    assert got["n"].tolist() == list(range(6000))


def test_numbers_within_a_group(lopsided):
    got = numbering.number_rows(lopsided, ["shard", "row_index"], "n", within=["shard"]).toPandas()
    assert (got["n"] == got["row_index"]).all()
    with pytest.raises(ValueError):
        numbering.number_rows(lopsided, ["row_index"], "n", within=["shard"])


def test_hot_group_is_spread(spark, lopsided, tmp_path):
    """Rows are dealt by ranges of the whole order, so a hot shard lies in several files."""
    before = set(storage._written)
    numbering.number_rows(lopsided, ["shard", "row_index"], "n", within=["shard"])
    (written, *_) = [p for p in storage._written if p not in before]
    sizes = spark.read.parquet(written).groupBy(F.shiftright("_place", 33)).count()
    assert sizes.count() > 4 and sizes.agg(F.max("count")).first()[0] < 6000 / 2


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    assert sorted(map(tuple, numbering.number_rows(df, ["k"], "n").collect())) == [("a", 0), ("b", 1)]
    assert numbering.number_rows(df.where("false"), ["k"], "n").count() == 0


def test_group_number_keeps_null_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    got = numbering.group_number(df, "k").collect()
    assert sorted(str(tuple(r)) for r in got) == [
        "('a', 0)", "('b', 1)", "('b', 1)", "(None, None)"]


@pytest.mark.parametrize("size", [1, 7, 999, 6000, 7000])
def test_rechunk_is_an_even_split(spark, size):
    df = spark.range(1003)
    got = numbering.rechunk(df, size, ["id"]).toPandas().sort_values("id")
    parts = np.array_split(np.arange(1003), -(-1003 // size))
    assert got["chunk"].tolist() == [i for i, p in enumerate(parts, 1) for _ in p]


def test_rechunk_names_and_errors(spark):
    names = numbering.rechunk(spark.range(5), 2, ["id"], prefix="emb").toPandas().sort_values("id")
    assert names["chunk"].tolist() == ["emb_001", "emb_001", "emb_002", "emb_002", "emb_003"]
    many = numbering.rechunk(spark.range(1500), 1, ["id"], prefix="e").agg(F.max(F.length("chunk")))
    assert many.first()[0] == len("e_1500")
    for size in (0, -1):
        with pytest.raises(ValueError):
            numbering.rechunk(spark.range(5), size, ["id"])


def test_chunk_fixed_remainder(lopsided):
    got = numbering.chunk_fixed(lopsided, 1000).groupBy("shard", "chunk").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {
        **{("hot", i): 1000 for i in range(5)}, ("b", 0): 900, ("z", 0): 100}


def test_offsets_and_concat(spark, lopsided):
    got = {r[0]: (r[1], r[2]) for r in numbering.shard_offsets(lopsided).collect()}
    assert got == {"b": (900, 0), "hot": (5000, 900), "z": (100, 5900)}
    a = spark.createDataFrame([("s1", 0, [1.0, 2.0]), ("s1", 1, [3.0, 4.0])],
                              "shard string, row_index bigint, embedding array<float>")
    b = spark.createDataFrame([("s0", 0, [5.0, 6.0])],
                              "shard string, row_index bigint, embedding array<double>")
    joined = numbering.concat_shards([a, b])
    assert joined.schema["embedding"].dataType == a.schema["embedding"].dataType
    assert {(r["shard"], r["row_index"]): r["global_index"] for r in joined.collect()} == {
        ("s0", 0): 0, ("s1", 0): 1, ("s1", 1): 2}
    bad = spark.createDataFrame([("s2", 0, [5.0])], a.schema)
    with pytest.raises(Exception, match="width 1"):
        numbering.concat_shards([a, bad]).collect()


def test_file_batches_and_slices(spark):
    df = spark.createDataFrame([(f"f{i:02d}", j) for i in range(10) for j in range(3)],
                               "shard string, row_index bigint")
    batches = numbering.file_batch(df).select("shard", "batch").distinct().collect()
    assert {r[0]: r[1] for r in batches} == {f"f{i:02d}": i // 4 for i in range(10)}
    names = numbering.file_slice(df, 8, None).select("shard").distinct().collect()
    assert sorted(r[0] for r in names) == ["f08", "f09"]
