"""What the plans must look like: pushed filters, pruned columns, limits before shuffles, no cross joins of tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from klangsieb.operators import merge, metrics, select, spans
from klangsieb.operators.ordered import holding
from klangsieb.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    p = plan(QUERIES["pricing_summary"](spark, data))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in p
    assert "l_partkey" not in p and "l_tax" not in p
    p = plan(QUERIES["p4_found"](spark, data))
    assert "ReadSchema: struct<line_id:bigint,file_kind:string,line:string>" in p


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    p = plan(select.best_per_group(df, ["g"], [F.col("id")], 5))
    assert p.count("WindowGroupLimit") >= 2
    assert p.index("WindowGroupLimit") < p.rindex("Exchange hashpartitioning") < p.rindex("WindowGroupLimit")


def test_holding_rows_are_folded_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "x")], "k string, o int, v string")
    p = plan(holding(df, "k", latest="o", keep=["v"]))
    assert "partial_max" in p and "Window" not in p


def test_numbers_of_holding_rows_are_folded_by_hash(spark, data):
    p = QUERIES["global_summary"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in p and "partial_max_by" in p
    assert re.findall(r"ReadSchema: struct<(.*?)>", p) == ["idx:string,dur_proc_s:double,written_at:timestamp"]
    p = plan(QUERIES["seed_arithmetic_pool"](spark, data))
    assert "SortAggregate" not in p and "speaker" not in p and "text" not in p.replace("Context", "")


def test_overlaps_are_equi_joins(spark):
    s = spark.createDataFrame([("k", 0.0, 1.0)], "k string, start double, end double")
    p = plan(merge.overlaps(s, s, "k", 0.1, 10.0))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["roundrobin_budget_select", "stratified_split_90_5_5", "weighted_sample", "gaps_islands_runs", "bounded_gap_merge", "prefix_offsets", "hash_mod_pick_ref"])
def test_no_table_is_ordered_by_one_task(spark, data, name):
    p = plan(QUERIES[name](spark, data))
    lone = [w for w in re.findall(r"Window \[.*", p) if re.search(r"\], \[(?!.*_part|.*_stretch|.*user_id|.*_k)[^\]]*\]$", w) and "SinglePartition" in w]
    assert not lone
    assert "CartesianProduct" not in p


def test_word_rates_keep_to_arrow(spark):
    df = spark.createDataFrame([(["a"], ["b"])], "a array<string>, b array<string>")
    p = plan(df.select(metrics.word_edits("a", "b")))
    assert "ArrowEvalPython" in p and "BatchEvalPython" not in p


def test_merged_spans_are_streamed(spark):
    s = spark.createDataFrame([("k", 0.0, 1.0)], "k string, start double, end double")
    p = plan(spans.merge_near(s, "k", "start", "end", 1.0, 5.0))
    assert "MapInArrow" in p and "collect_list" not in p
