"""Physical plans: what must not appear at scale, and what must be pushed down."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from grainwise.bindings.catalog import QUERIES as CATALOG
from grainwise.bindings.tables import Star
from grainwise.operators.rank import exact_quantiles, global_rank
from grainwise.plans import orders as od

QUERIES = CATALOG
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas")


@pytest.fixture
def large(spark):
    """Plan as for tables too big to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products_and_no_python(large, name):
    text = plan(QUERIES[name](large, SMOKE_DIR))
    assert [word for word in UNWANTED if word in text] == []


def test_scan_is_pruned(spark):
    text = plan(QUERIES["monthly_trend"](spark, SMOKE_DIR))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    line = next(r for r in read if "l_orderkey" in r)
    assert line == "l_orderkey:bigint,l_extendedprice:double"


def test_filter_is_pushed_down(spark):
    for name in ("score_vs_delivery_sql", "corr_delivery_score", "signal_delivery_vs_score", "delivery_distribution"):
        text = plan(QUERIES[name](spark, SMOKE_DIR))
        assert "EqualTo(o_orderstatus,F)" in text and "Outer" not in text


def test_payments_meet_a_hash_aggregate(large):
    for name in ("payment_grain", "dominant_payment"):
        nearest = [line for line in plan(QUERIES[name](large, SMOKE_DIR)).splitlines() if "Aggregate" in line][-1]
        assert "HashAggregate" in nearest and "ObjectHash" not in nearest


def test_children_are_combined_before_the_shuffle(large):
    text = plan(Star(large, SMOKE_DIR).order_children().select("order_id", "order_product_revenue"))
    assert text.index("Exchange hashpartitioning(order_id") < text.index("partial_sum")


def test_orders_meet_their_children_with_one_exchange_each(large):
    text = plan(Star(large, SMOKE_DIR).order_grain().select("order_id", "order_value"))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("SortMergeJoin") == 1


def test_one_literal_scan_for_naive_totals(large):
    text = plan(QUERIES["fanout_naive"](large, SMOKE_DIR))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_rank_never_gathers_the_rows(large):
    df = large.range(1000).select((F.col("id") % 7).alias("v"), "id")
    text = plan(global_rank(df, ["v", "id"], "r", "n"))
    # the only single-partition exchange orders the per-partition counts
    before = text.split("Exchange SinglePartition")
    assert len(before) == 2 and "HashAggregate(keys=[_groupingexpression" in before[1].splitlines()[1]


def test_quantile_steps_share_one_exchange(spark):
    df = Star(spark, SMOKE_DIR).lines().select(F.col("price_cents").alias("v"))
    got = exact_quantiles(df, F.col("v"), {"m": 0.5})
    got.collect()
    final = plan(got).split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2 and final.count("FileScan") == 1


def test_hot_product_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        items = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("product_id"),
            F.md5(F.col("id").cast("string")).alias("payload"),
        )
        categories = spark.range(500).select(F.col("id").alias("product_id"), F.lit("c").alias("category_en"))
        joined = od.items_with_category(items, categories)
        assert len(joined.collect()) == 60000
        assert "skew=true" in plan(joined)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_bucketed_order_grain_needs_no_exchange_on_the_order(large):
    text = plan(QUERIES["order_grain_bucketed"](large, SMOKE_DIR))
    assert "Exchange" not in text and "SortMergeJoin" in text


def test_samples_are_drawn_without_a_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job may run")
    try:
        QUERIES["sample_reviews"](spark, SMOKE_DIR)
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()
