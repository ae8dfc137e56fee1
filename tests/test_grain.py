"""Grain repair and fan-out accounting."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.operators.grain import (
    cogroup_counts,
    dedupe_dimension,
    dominant_attribute,
    fan_out_by_key,
    fan_out_contribution,
    fan_out_totals,
)

KEYS = st.sampled_from(["a", "b", "c", None])
ROWS = st.lists(st.tuples(KEYS, st.integers(-500, 500)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(KEYS, max_size=5), ROWS, ROWS)
def test_algebraic_equals_literal_join(spark, parents, items, payments):
    p = spark.createDataFrame([(k,) for k in parents], "k string")
    i = spark.createDataFrame(items, "k string, price bigint")
    y = spark.createDataFrame(payments, "k string, paid bigint")
    per_key = fan_out_by_key(p, i, y, "k", "price", "paid")
    totals = fan_out_totals(per_key, "k").first()
    literal = [
        (k, price, paid) for k in parents for ik, price in items for yk, paid in payments if k is not None and k == ik == yk
    ]
    assert int(totals.naive_rows) == len(literal)
    assert int(round(float(totals.naive_revenue or 0) * 100)) == sum(x[1] for x in literal)
    assert int(round(float(totals.naive_cash or 0) * 100)) == sum(x[2] for x in literal)
    assert totals.naive_orders == len({x[0] for x in literal})
    by_key = {r.k: int(r.naive_rows) for r in fan_out_contribution(per_key, "k").collect()}
    assert by_key == {k: sum(1 for x in literal if x[0] == k) for k in {x[0] for x in literal}}


def test_hot_keys_do_not_overflow(spark):
    parents = spark.createDataFrame([("hot",)], "k string")
    per_key = parents.select(
        "k",
        F.lit(1).cast("bigint").alias("n_parents"),
        F.lit(300_000_000_000).alias("n_items"),
        F.lit(300_000_000_000).alias("n_payments"),
        F.lit("123456789012.34").cast("decimal(23,2)").alias("revenue"),
        F.lit("1.00").cast("decimal(23,2)").alias("cash"),
    )
    totals = fan_out_totals(per_key, "k").first()
    assert int(totals.naive_rows) == 300_000_000_000**2


def test_cogroup_keeps_keys_of_every_source(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("z", 9)], "k string, w int")
    got = cogroup_counts("k", {"a": (a, {"v": F.col("v")}), "b": (b, {"w": F.col("w")})})
    assert sorted(map(tuple, got.collect())) == [("x", 2, 0, 3, None), ("y", 1, 0, 3, None), ("z", 0, 1, None, 9)]


def test_dominant_attribute_tie_goes_to_the_later_row(spark):
    df = spark.createDataFrame([("o", "x", 5, 1), ("o", "y", 5, 2), ("o", "z", 1, 3)], "k string, t string, v int, s int")
    assert dominant_attribute(df, "k", "t", F.col("v"), F.col("s"), "t").first().t == "y"


def test_dominant_attribute_orders_negative_amounts(spark):
    df = spark.createDataFrame([("o", "x", -5, 9), ("o", "y", -4, 1)], "k string, t string, v int, s int")
    assert dominant_attribute(df, "k", "t", F.col("v"), F.col("s"), "t").first().t == "y"


def test_dedupe_without_modal_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double")
    assert tuple(dedupe_dimension(df, "k", {"x": F.col("x")}, {}).first()) == ("a", 2.0)


def test_dedupe_ignores_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, "s"), (1, None, None, "s"), (1, 3.0, "c", None), (2, None, None, None)],
        "k int, x double, city string, state string",
    )
    got = dedupe_dimension(df, "k", {"x": F.col("x")}, {"city": "city", "state": "state"})
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, "c", "s"), (2, None, None, None)]


@pytest.mark.parametrize("hot", [1, 5000])
def test_dedupe_with_one_hot_key(spark, hot):
    df = spark.range(hot).select(F.lit(0).alias("k"), F.col("id").cast("double").alias("x"), F.lit("m").alias("c"))
    assert tuple(dedupe_dimension(df, "k", {"x": F.col("x")}, {"c": "c"}).first()) == (0, (hot - 1) / 2, "m")
