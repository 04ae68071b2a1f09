"""Physical plans: what is read, what is shuffled, where the one-task steps are."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from catalog.inputs import captions, index, table
from corpusloom.operators import dedup, numbering, split

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    plan = plan_of(split.row_range(table(spark, SF, "documents").select("doc_id", "lang"), 5, 9, "doc_id"))
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThan(doc_id,9)" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_head_and_tail_read_one_column(spark):
    plan = plan_of(captions(spark, SF).select(F.left("caption", F.lit(15)).alias("h")))
    assert "ReadSchema: struct<text:string>" in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", [
    "scan_captions", "head_tail", "filter_steps", "filter_not_null", "strip_ws", "min_words",
    "null_like", "charset_whitelist", "image_path", "parse_ids", "flatten_struct",
    "clean_caption", "strip_filler", "tag_suffix", "split_hash", "json_part_explode",
    "encode_mlp", "vec_affine", "vec_normalize", "assign_nearest",
    "pq_encode", "union_models"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan


def test_one_task_steps_see_counts_only(spark):
    """Every gathering into one partition is fed by an aggregate, never by rows of a table."""
    events = table(spark, SF, "events").select("event_id")
    docs = captions(spark, SF)
    for df in (numbering.number_rows(events, ["event_id"]),
               numbering.rechunk(events, 100, ["event_id"]),
               numbering.chunk_fixed(events.select(F.lit(1).alias("shard"), F.col("event_id").alias(
                   "row_index")), 100),
               split.split_contiguous(events, 0.9, ["event_id"])):
        plan = plan_of(df)
        for at in re.finditer("Exchange SinglePartition", plan):
            after = plan[at.end():].split("\n")[1]
            assert "HashAggregate" in after, after
    assert "SinglePartition" not in plan_of(dedup.dedup_head_tail(docs))


def test_exclusion_shuffles_beginnings_not_prompts(spark):
    kept = split.exclude_prompts(index(spark, SF), index(spark, SF).where("steps = 25"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(kept.select("doc_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "_start" in line
    assert not re.search(r"Exchange[^\n]*\n[^\n]*Project \[[^\]]*prompt#", plan)


def test_weighted_mean_is_combined_before_the_shuffle(spark):
    plan = plan_of(entry_module.queries()["weighted_mean"](spark, SF))
    assert "partial_sum" in plan
    pooled = plan_of(entry_module.queries()["mean_pool"](spark, SF))
    assert re.search(r"ObjectHashAggregate\(keys=\[label[^\n]*partial_", pooled)


@pytest.mark.parametrize("name", ["knn_ivf", "knn_ivf_fitted", "search_images"])
def test_pruned_searches_read_probed_cells_only(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF))
    assert re.search(r"PartitionFilters: \[[^\n]*dynamicpruning", plan)
