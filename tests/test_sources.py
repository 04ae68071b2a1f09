import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators.numbering import chunk_fixed
from corpusloom.sources import matrix, tables

RNG = np.random.default_rng(4)


def collected(df):
    pdf = df.toPandas().sort_values(["shard", "row_index"])
    return pdf["shard"].tolist(), pdf["row_index"].tolist(), np.stack(pdf["embedding"])


def test_npy_shards_in_row_ranges(spark, tmp_path):
    a, b = RNG.normal(size=(1000, 6)).astype("float16"), RNG.normal(size=(7, 6)).astype("float32")
    np.save(tmp_path / "s1.npy", a)
    np.save(tmp_path / "s0.npy", b)
    df = matrix.read_vectors(spark, str(tmp_path), rowsPerPartition="300")
    assert df.rdd.getNumPartitions() == 5
    assert df.schema == schemas.VECTORS
    shard, row, x = collected(df)
    assert shard == ["s0"] * 7 + ["s1"] * 1000
    assert row == [*range(7), *range(1000)]
    assert (x == np.concatenate([b, a.astype("float32")])).all()
    assert matrix.read_vectors(spark, str(tmp_path / "s1.npy")).count() == 1000


def test_recursive_folders_and_patterns(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    np.save(tmp_path / "in" / "deep" / "x.npy", np.zeros((2, 3)))
    np.save(tmp_path / "in" / "y.npy", np.zeros((3, 3)))
    assert matrix.read_vectors(spark, str(tmp_path / "in")).count() == 3
    deep = matrix.read_vectors(spark, str(tmp_path / "in"), recursive="true")
    assert {r[0] for r in deep.select("shard").distinct().collect()} == {"deep/x", "y"}
    with pytest.raises(Exception, match="no "):
        matrix.read_vectors(spark, str(tmp_path / "in"), glob="z*.npy").count()


def test_raw_files(spark, tmp_path):
    x = RNG.integers(-500, 500, size=(50, 4)).astype("i2")
    x.tofile(tmp_path / "codes.bin")
    df = matrix.read_vectors(spark, str(tmp_path / "codes.bin"), "raw", "i2", 4, **{"as": "smallint"})
    assert df.schema["embedding"].dataType == schemas.CODES["codes"].dataType
    assert (collected(df)[2] == x).all()
    with pytest.raises(Exception, match="whole number"):
        matrix.read_vectors(spark, str(tmp_path / "codes.bin"), "raw", "i2", 7).count()
    with pytest.raises(ValueError):
        matrix.read_vectors(spark, str(tmp_path / "codes.bin"), "raw")


def test_shards_must_agree_and_be_plain(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 3)))
    np.save(tmp_path / "b.npy", np.zeros((2, 4)))
    with pytest.raises(Exception, match="wide"):
        matrix.read_vectors(spark, str(tmp_path)).count()
    folder = tmp_path / "o"
    folder.mkdir()
    np.save(folder / "o.npy", np.array([{"x": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        matrix.read_vectors(spark, str(folder)).count()


def test_npy_round_trip(spark, tmp_path):
    x = RNG.normal(size=(1003, 5)).astype("float32")
    np.save(tmp_path / "x.npy", x)
    df = matrix.read_vectors(spark, str(tmp_path / "x.npy"), rowsPerPartition="100")
    out = tmp_path / "out"
    matrix.write_vectors(df, str(out), order_by="row_index", files=4)
    parts = sorted(out.glob("*.npy"))
    assert 1 < len(parts) <= 4 and len(list(out.iterdir())) == len(parts) + 1  # and the manifest
    assert (np.concatenate([np.load(p) for p in parts]) == x).all()
    matrix.write_vectors(df, str(out), files=1, dtype="float16")
    (only,) = out.glob("*.npy")
    assert np.load(only).dtype == np.float16 and np.load(only).shape == (1003, 5)


def test_append_keeps_earlier_files(spark, tmp_path):
    out = str(tmp_path / "m")
    for x in (1.0, 2.0):
        one = spark.createDataFrame([([x],)], "embedding array<float>").coalesce(1)
        matrix.register(spark)
        one.write.format("matrix").option("dtype", "float32").mode("append").save(out)
    assert [r["embedding"] for r in matrix.read_vectors(spark, out).orderBy("shard").collect()] == [[1.0], [2.0]]


def test_part_metadata_to_index(spark, tmp_path):
    for part, images in {"part-000002": ["b.webp", "a.webp"], "part-000001": ["c.webp"],
                         "part-000003": []}.items():
        folder = tmp_path / part
        folder.mkdir()
        (folder / f"{part}.json").write_text(json.dumps(
            {n: {"p": f'say "{n}"\nü', "st": 50, "se": 1} for n in images}, indent=1))
    index = tables.build_image_index(tables.read_parts(spark, str(tmp_path)))
    assert index.columns == schemas.IMAGE_INDEX.names
    rows = [tuple(r) for r in index.orderBy("image_number").collect()]
    assert rows == [
        ("part-000001", "c.webp", 'say "c.webp"\nü', 50, 0, 0),
        ("part-000002", "a.webp", 'say "a.webp"\nü', 50, 1, 1),
        ("part-000002", "b.webp", 'say "b.webp"\nü', 50, 1, 2)]
    tables.write_csv(index, str(tmp_path / "csv"))
    again = tables.read_index(spark, str(tmp_path / "csv"))
    assert again.schema == schemas.IMAGE_INDEX
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    (tmp_path / "part-000003" / "part-000003.json").write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_parts(spark, str(tmp_path)).collect()


def test_query_list(spark, tmp_path):
    (tmp_path / "prompts.csv").write_text(
        'imgId,prompt\n2a,"a plain, quoted one"\n3b,"with ""doubled"" quotes, and more"\n4c,\n')
    rows = tables.read_queries(spark, str(tmp_path / "prompts.csv")).collect()
    assert [tuple(r) for r in rows] == [
        ("2a", "a plain, quoted one"), ("3b", 'with "doubled" quotes, and more'), ("4c", None)]


def test_neighbour_lists_as_text(spark, tmp_path):
    df = spark.createDataFrame([(0, [5, 3], [0.5, 0.25])],
                               "query_id bigint, doc_ids array<bigint>, distances array<double>")
    tables.write_csv(df, str(tmp_path / "out"))
    row = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').first()
    assert tuple(row) == ("0", "[5,3]", "[0.5,0.25]")


def test_captions_read_named_columns_only(spark, tmp_path):
    for n in ("metadata_1.parquet", "metadata_0.parquet"):
        spark.range(3).select(F.col("id").alias("row_index"), F.lit(n).alias("caption"),
                              F.lit(1).alias("other")).toPandas().to_parquet(tmp_path / n)
    (tmp_path / "notes.txt").write_text("x")
    df = tables.read_captions(spark, str(tmp_path))
    assert df.columns == ["shard", "row_index", "caption"]
    assert all(r["shard"] == r["caption"] for r in df.collect()) and df.count() == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_index:bigint,caption:string>" in plan


def test_positions_come_from_the_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    read = tables.read_positions(spark, path, ["id"], chunk=100)
    rows = read.collect()
    assert len(rows) == 1000 and all(r["position"] == r["id"] for r in rows)
    assert all(r["chunk"] == r["row_index"] // 100 for r in rows)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    files = {r["shard"] for r in rows}
    assert len(files) > 1
    # Without a position over all files there isn't even a join.
    alone = tables.read_positions(spark, path, ["id"], chunk=100, over_all=False)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and alone.columns == ["id", "shard", "row_index", "chunk"]
    with pytest.raises(ValueError):
        tables.read_positions(spark, path, ["id"], chunk=0)


def test_chunk_and_batch_folders(spark, tmp_path):
    df = spark.range(25).select(F.lit("s0").alias("shard"), F.col("id").alias("row_index"))
    tables.write_chunks(chunk_fixed(df, 10), str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c" / "shard=s0").iterdir()) == [
        "chunk=0", "chunk=1", "chunk=2"]
    assert len(list((tmp_path / "c" / "shard=s0" / "chunk=0").glob("*.parquet"))) == 1
    tables.write_batches(df.withColumn("batch", F.lit(1)), str(tmp_path / "b"), max_records=10)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 25


def test_keywords(spark, tmp_path):
    spark.createDataFrame([("medium", 1, "oil", [0.5])], schemas.KEYWORDS).write.parquet(
        str(tmp_path / "k"))
    assert tables.read_keywords(spark, str(tmp_path / "k")).first()["label"] == "oil"


def test_filters_choose_files_and_ranges(spark, tmp_path):
    x = RNG.normal(size=(1000, 6)).astype("float32")
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", x + 1)
    (tmp_path / "broken.npy").write_bytes(b"not a matrix")
    df = matrix.read_vectors(spark, str(tmp_path), rowsPerPartition="100")
    with pytest.raises(Exception, match="(?i)magic"):
        df.count()
    # Files of other shards aren't opened, and no task reads rows outside the range.
    some = df.where("shard IN ('a', 'b') AND row_index >= 250 AND row_index < 420")
    assert some.rdd.getNumPartitions() == 4
    shard, row, found = collected(some)
    assert shard == ["a"] * 170 + ["b"] * 170 and row == [*range(250, 420)] * 2
    assert (found == np.concatenate([x[250:420], x[250:420] + 1])).all()
    assert df.where("shard = 'b' AND row_index = 7").rdd.getNumPartitions() == 1
    assert [r[1] for r in df.where("shard = 'b' AND row_index > 997 AND row_index <= 998").collect()] == [998]
    assert df.where("shard = 'a' AND row_index > 2000").count() == 0
    assert df.where("shard = 'none'").count() == 0
    assert df.where("shard = 'a' AND (row_index < 2 OR row_index = 9)").count() == 3
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark to test


def test_columns_without_vectors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((5, 3)))
    df = matrix.read_vectors(spark, f"file:{tmp_path}", columns="row_index,shard")
    assert df.columns == ["row_index", "shard"]
    assert sorted(tuple(r) for r in df.collect()) == [(i, "a") for i in range(5)]


def test_column_major_files(spark, tmp_path):
    x = RNG.normal(size=(20, 3))
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    assert np.allclose(collected(matrix.read_vectors(spark, str(tmp_path), rowsPerPartition="7"))[2], x)


def test_manifest_in_place_of_counting(spark, tmp_path):
    out = tmp_path / "m"
    df = spark.range(100).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    matrix.write_vectors(df, str(out), order_by="id", files=3)
    files = matrix.manifest(spark, str(out))
    listed = matrix.read_manifest(str(out))
    assert [f.name for f in listed] == sorted(f.name for f in out.glob("part_*"))
    rows = files.orderBy("shard").collect()
    assert sum(r["rows"] for r in rows) == 100
    assert [r["offset"] for r in rows] == [sum(r["rows"] for r in rows[:i]) for i in range(len(rows))]
    placed = matrix.with_position(matrix.read_vectors(spark, str(out)), files)
    assert all(r["position"] == r["embedding"][0] for r in placed.collect()) and placed.count() == 100
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    # An append keeps the manifest true.
    df.limit(5).write.format("matrix").mode("append").save(str(out))
    assert matrix.manifest(spark, str(out)).agg(F.sum("rows")).first()[0] == 105
    # Files that the manifest doesn't know, or that changed, are an error.
    np.save(out / "more.npy", np.zeros((2, 2), "float32"))
    with pytest.raises(Exception, match="manifest"):
        matrix.read_vectors(spark, str(out)).count()
    (out / "more.npy").unlink()
    assert matrix.read_vectors(spark, str(out)).count() == 105
    first = out / listed[0].name
    first.write_bytes(first.read_bytes()[:-8])
    with pytest.raises(Exception, match="manifest"):
        matrix.read_vectors(spark, str(out)).count()


def test_folders_of_others_get_no_manifest(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 1), "float32"))
    matrix.register(spark)
    one = spark.createDataFrame([([1.0],)], "embedding array<float>").coalesce(1)
    one.write.format("matrix").mode("append").save(str(tmp_path))
    assert matrix.read_manifest(str(tmp_path)) is None
    assert matrix.read_vectors(spark, str(tmp_path)).count() == 3


def test_file_positions_takes_more_files_for_more_text(spark, tmp_path, monkeypatch):
    """A task sorts and writes a bounded share of the text, whatever the table's size is."""
    import catalog.sources as sources
    rows = [(i * 7919 % 4001, "x" * (i % 60)) for i in range(4001)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{tmp_path}/written"
    monkeypatch.setattr(sources, "new_path", lambda spark: folder)
    monkeypatch.setattr(sources, "FILE_BYTES", 10_000)
    found = sources.file_positions(spark, str(tmp_path)).collect()
    sizes = [r[0] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).agg(
        F.sum(F.length("text"))).select(F.col("sum(length(text))")).collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 10_000
    assert sorted((r["doc_id"], r["position"], r["n"]) for r in found) == [
        (d, d, len(t)) for d, t in sorted(rows)]
