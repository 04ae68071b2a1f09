import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, split, take

CAPS = "shard string, row_index bigint, caption string"


def by_pandas(rows, scope):
    df = pd.DataFrame(rows, columns=["shard", "row_index", "caption"]).sort_values(
        ["shard", "row_index"])
    df["head"], df["tail"] = df["caption"].str[:15], df["caption"].str[-15:]
    shards = sorted(df["shard"].unique())
    df["batch"] = df["shard"].map(lambda s: shards.index(s) // 4 if scope == "batch" else 0)
    kept = [g.drop_duplicates("head").drop_duplicates("tail") for _, g in df.groupby("batch")]
    out = pd.concat(kept)
    return set(zip(out["shard"], out["row_index"]))


@pytest.mark.parametrize("scope", ["global", "batch"])
def test_dedup_against_pandas(spark, scope):
    """A third of all rows share one head, another group one tail; some are null."""
    rows = []
    for i in range(600):
        text = [f"the very same start {i}", f"{i} and then the very same end", None,
                f"short{i % 7}", f"caption number {i % 50} of many, with text"][i % 5]
        rows.append((f"f{(i * 7) % 9}", i, "the same beginning for many" if i % 3 == 0 else text))
    df = spark.createDataFrame(rows, CAPS).repartition(5)
    got = dedup.dedup_head_tail(df, scope=scope)
    assert got.columns == df.columns
    assert {(r[0], r[1]) for r in got.collect()} == by_pandas(rows, scope)


def test_dedup_limits_each_key_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x")], CAPS)
    plan = dedup.dedup_head_tail(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "Partial" in plan


def test_dedup_rejects_unknown_scope(spark):
    with pytest.raises(ValueError):
        dedup.dedup_head_tail(spark.createDataFrame([], CAPS), scope="file")


def test_ordered_distinct(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "k string, pos int")
    assert [r[0] for r in dedup.ordered_distinct(df, "k", "pos").collect()] == ["b", "a", "c"]


@pytest.mark.parametrize("n", [1, 10, 500, 4999, 5000, 9000])
def test_sample_is_exact_and_ignores_partitioning(spark, n):
    df = spark.range(5000).withColumn("x", F.col("id") * 2)
    one = {r[0] for r in split.sample_n(df.coalesce(1), n, "id", 3).collect()}
    many = split.sample_n(df.repartition(13), n, "id", 3)
    assert many.columns == df.columns
    rows = many.collect()
    assert len(rows) == min(n, 5000) and {r[0] for r in rows} == one
    first = df.orderBy(split.hash_key("id", 3), "id").limit(n).collect()
    assert {r[0] for r in first} == one


def test_splits(spark):
    share = split.split_hash(spark.range(20000), "id", 0.1).where("is_test").count()
    assert 1800 < share < 2200
    marked = split.split_contiguous(spark.range(1001), 0.9, ["id"]).toPandas()
    assert marked.loc[marked["is_train"], "id"].max() == 899 and marked["is_train"].sum() == 900


def test_bootstrap_is_exact_and_ignores_partitioning(spark):
    df = spark.range(1000)
    one = sorted(map(tuple, split.bootstrap(df.coalesce(1), "id", seed=1).collect()))
    assert sorted(map(tuple, split.bootstrap(df.repartition(9), "id", seed=1).collect())) == one
    assert [r[1] for r in sorted(one, key=lambda r: r[1])] == list(range(1000))
    assert 580 < len({r[0] for r in one}) < 690
    assert split.bootstrap(df, "id", 2500).count() == 2500
    assert split.bootstrap(df.where("false"), "id").count() == 0


def test_ranges(spark):
    df = spark.range(10).withColumnRenamed("id", "part_id")
    assert split.part_range(df, 2, 4).count() == 3
    assert split.row_range(df, 2, 4, "part_id").count() == 2


def test_exclusion_modes(spark):
    long_one = "the first twenty chars of this one"
    train = spark.createDataFrame([
        (0, long_one + " A"), (1, long_one[:20]), (2, "short"), (3, "another prompt altogether"),
        (4, None)], "id int, prompt string")
    val = spark.createDataFrame([(9, long_one), (8, "short"), (7, None)], "id int, prompt string")
    prefix = {r[0] for r in split.exclude_prompts(train, val).collect()}
    literal = {r[0] for r in split.exclude_prompts(train, val, mode="literal").collect()}
    assert prefix == {3, 4} and literal == {0, 1, 3, 4}
    with pytest.raises(ValueError):
        split.exclude_prompts(train, val, mode="x")


def test_train_val_split(spark):
    index = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 4 > 0, 50).otherwise(30).alias("steps"),
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("group "), (F.col("id") % 400).cast("string"),
                                              F.lit(" of prompts, "), F.col("id").cast("string")))
        .alias("prompt"))
    sets = split.train_val_split(index, 50, 600, "id", seed=4)
    train, val = sets.train.toPandas(), sets.validation.toPandas()
    assert len(val) == 50 and len(train) == 600
    assert not set(train["id"]) & set(val["id"])
    assert not set(train["prompt"].str[:20]) & set(val["prompt"].str[:20])
    for part in (train, val):
        assert (part["steps"] == 50).all() and part["prompt"].notna().all()
    kept = split.train_val_split(index, 50, 10_000, "id", mode="literal", exclude_val=False, seed=4)
    assert kept.train.join(kept.validation, "id", "left_semi").count() == 50


VECS = "shard string, row_index bigint, embedding array<float>"


def test_take_keeps_repeats_and_checks_range(spark):
    vectors = spark.createDataFrame([("a", i, [float(i)]) for i in range(3)], VECS)
    meta = spark.createDataFrame([("a", 2, "x"), ("a", 2, "y"), ("a", 0, "z")], CAPS)
    got = take.take_vectors(meta, vectors, strict=True).collect()
    assert sorted((r["caption"], r["embedding"][0]) for r in got) == [("x", 2), ("y", 2), ("z", 0)]
    beyond = meta.union(spark.createDataFrame([("a", 9, "w")], CAPS))
    assert take.take_vectors(beyond, vectors, strict=False).count() == 3
    with pytest.raises(Exception, match="no vector at position a/9"):
        take.take_vectors(beyond, vectors).collect()


def test_neighbours_without_an_index_row(spark):
    found = spark.createDataFrame([(1, 0), (1, 7)], "query_id long, doc_id long")
    known = spark.createDataFrame([(0, "a")], "image_number long, part string")
    kept = take.neighbour_meta(found, known, strict=False).collect()
    assert sorted((r.doc_id, r.part) for r in kept) == [(0, "a"), (7, None)]
    with pytest.raises(Exception, match="no index row for 7"):
        take.neighbour_meta(found, known).collect()


def test_pairs_report_missing_partners(spark):
    a = spark.createDataFrame([("s", 0, [1.0]), ("s", 1, [2.0])], VECS)
    b = spark.createDataFrame([("s", 1, [3.0]), ("s", 2, [4.0]), ("s", 3, [5.0])], VECS)
    paired = take.pair_vectors(a, b, ("st", "vit"))
    assert paired.count() == 4
    assert list(take.unpaired_counts(paired, ("st", "vit")).first()) == [2, 1]


def test_neighbours_wide_and_long(spark):
    long_form = spark.createDataFrame(
        [(1, 1, 7, 0.5), (1, 2, 3, 0.25), (2, 1, 9, 0.1)],
        "query_id bigint, rank int, doc_id bigint, score float")
    wide = take.widen_neighbours(long_form)
    rows = {r[0]: (r[1], r[2]) for r in wide.collect()}
    assert rows[1] == ([7, 3], [0.5, 0.25])
    back = take.explode_neighbours(wide).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, long_form.collect()))
