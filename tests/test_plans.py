"""What the physical plans must and must not contain."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tallywright.operators import plan_fulfilment
from tallywright.workload import operators, reports

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {**operators.QUERIES, **reports.QUERIES}

FORBIDDEN = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "Window",
    "ObjectHashAggregate",
    "SortAggregate",
    "collect_list",
    "Scan ExistingRDD",
)


def explain(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def plan_of(spark, name) -> str:
    return explain(QUERIES[name](spark, SF_DIR))


def read_columns(plan: str) -> list[str]:
    return [
        ",".join(sorted(re.findall(r"(\w+):", schema))) for schema in re.findall(r"ReadSchema: struct<(.*)>", plan)
    ]


@pytest.mark.parametrize("name", QUERIES)
def test_plan_stays_distributed(spark, name):
    plan = plan_of(spark, name)
    # Lists of bins, at most 67 per key and measure, made of rows that are summed per bin.
    bins = ("ObjectHashAggregate", "SortAggregate", "collect_list") if name.endswith("_doubles") else ()
    assert not [operator for operator in FORBIDDEN if operator in plan and operator not in bins]
    assert not bins or re.search(r"collect_list.*?Exchange hashpartitioning\([^)]*\bbin#.*?HashAggregate", plan, re.S)
    # The one task of a single-partition shuffle may only merge the partial
    # results of an aggregation without keys: one row per task.
    lines = plan.splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if "SinglePartition" in line:
            assert re.search(r"HashAggregate\(keys=\[\]", below)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_grouping_combines_before_its_shuffle(spark, name):
    """Below every hash shuffle lies a partial aggregate, or a finished one that is to be joined.

    Phrases are looked up by runs of characters, of which a filter leaves the few that begin one.
    """
    if name == "keyword_count_indexed":
        assert "BroadcastHashJoin" in plan_of(spark, name)
        return
    lines = [line for line in plan_of(spark, name).splitlines() if " AS spread#" not in line]
    for line, below in zip(lines, lines[1:], strict=False):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in below


SORTED_OUTPUT = [name for name in QUERIES if name.startswith(("top_", "report_top", "report_most"))]


@pytest.mark.parametrize("name", SORTED_OUTPUT)
def test_top_k_does_not_sort_everything(spark, name):
    plan = plan_of(spark, name)
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("numeric_summary", ["o_totalprice"]),
        ("freq_many_keys", ["l_partkey"]),
        ("keyword_count_text", ["text"]),
        ("category_share_text", ["source,text"] * 2),
        ("slot_frequency_all", ["l_linenumber,l_linestatus,l_returnflag,l_suppkey"]),
        ("top_rows", ["c_acctbal,c_custkey"]),
        ("monthly_volume", ["o_orderdate,o_orderkey"]),
        ("treatment_comparison", ["doc_id,n_chars", "doc_id,quality"]),
        ("repeat_cohorts", ["o_custkey,o_orderdate"]),
        ("report_analyst_vacancy_count", ["p_name"]),
        (
            "report_plan_completion",
            ["o_custkey,o_orderdate,o_orderstatus,o_totalprice", "o_custkey,o_orderdate,o_orderpriority"],
        ),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert read_columns(plan_of(spark, name)) == columns


@pytest.mark.parametrize(
    ("name", "filters"),
    [
        (
            "monthly_volume",
            ["GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)", "LessThan(o_orderdate,1998-01-01T00:00)"],
        ),
        ("monthly_volume_ts", ["GreaterThanOrEqual(ts,2024-01-05T00:00)", "LessThan(ts,2024-01-21T00:00)"]),
        ("keyword_count", ["Or(StringContains(p_name,ring),StringContains(p_name,bolt))"]),
        ("segment_profile", ["Or(StringContains(p_name,ring),StringContains(p_name,bolt))"]),
        ("first_match_segment_lines", ["EqualTo(l_linestatus,F)"]),
        ("treatment_comparison", ["IsNotNull(doc_id)"]),
        ("plan_fulfilment", ["IsNotNull(user_id)"]),
    ],
)
def test_filters_reach_the_scan(spark, conf, name, filters):
    conf(maxMetadataStringLength="1000")
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(spark, name)))
    assert all(text in pushed for text in filters)


@pytest.mark.parametrize("name", ["category_share", "category_share_many_keys", "report_analyst_grade_share"])
def test_shares_scan_their_input_once(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    df.collect()
    final = explain(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_one_shuffle_per_side_of_the_comparison(spark):
    """The join takes over the partitioning of the two aggregations."""
    plan = plan_of(spark, "treatment_comparison_fanout")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" in plan


def test_both_sides_of_the_fulfilment_are_dealt_to_the_join(spark):
    """Plan and fact are combined, then dealt by the keys; the result adds one."""
    plan = plan_of(spark, "plan_fulfilment")
    assert plan.count("Exchange hashpartitioning(") == 5


@pytest.mark.parametrize("nulls", [False, True])
def test_hot_key_of_the_plan_is_split(spark, conf, tmp_path, nulls):
    """A third of the plan under one key, with many values of `by`, is joined in several tasks; NULLs are spread."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None if nulls else -1).cast("bigint")).otherwise(F.col("id") % 5000)
    for name, many in (("plan", 120_000), ("fact", 40_000)):
        spark.range(many).select(key.alias("k"), F.concat(F.lit("some longer label "), "id").alias("by")).write.parquet(
            str(tmp_path / name)
        )
    conf(
        shuffle__partitions="20",
        adaptive__advisoryPartitionSizeInBytes="32k",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
        adaptive__autoBroadcastJoinThreshold="-1",
    )
    plan, fact = (spark.read.parquet(str(tmp_path / name)) for name in ("plan", "fact"))
    df = plan_fulfilment(plan, fact, ["k"], "by")
    found = df.collect()
    final = explain(df).split("Initial Plan")[0]
    assert ("SortMergeJoin(skew=true)" in final) != nulls
    assert len(found) == 120_000
    hot = [row for row in found if int(row["by"].split()[-1]) % 3 == 0]
    assert {row["completed"] for row in hot} == ({0} if nulls else {13_334})


def test_small_right_side_is_broadcast_once_measured(spark):
    df = QUERIES["plan_fulfilment"](spark, SF_DIR)
    assert "SortMergeJoin" in explain(df)
    df.collect()
    assert "BroadcastHashJoin" in explain(df).split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["plan_fulfilment_lines", "treatment_comparison_hot_key"])
def test_right_side_beyond_the_limit_is_sorted_and_merged(spark, conf, name):
    conf(adaptive__autoBroadcastJoinThreshold="1b")
    df = QUERIES[name](spark, SF_DIR)
    df.collect()
    final = explain(df).split("Initial Plan")[0]
    assert "SortMergeJoin" in final
    assert "Broadcast" not in final
