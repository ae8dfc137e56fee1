"""Distinct, people and quantile sketches against exact counts, small and large."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from grainwise.bindings.catalog import QUERIES
from grainwise.bindings.oracle import ORACLE
from grainwise.operators import sketches
from tests.compare import difference, oracle_connection


def test_distinct_is_exact_below_the_bound_and_near_beyond(spark):
    df = spark.range(300_000).select((F.col("id") % 60_000).alias("few"), "id", F.when(F.col("id") < 0, "x").alias("none"))
    got = df.agg(*[F.theta_sketch_estimate(sketches.distinct_sketch(F.col(c))).alias(c) for c in df.columns]).first()
    assert got.few == 60_000 and got.none == 0 and abs(got.id / 300_000 - 1) < 0.02


def people(spark, rows, bits=sketches.DISTINCT_BITS):
    df = spark.createDataFrame(rows, "m string, person bigint").repartition(4)
    return [tuple(r) for r in sketches.people_over_time(sketches.people_by_group(df, "m", "person", bits), "m", bits).orderBy("m").collect()]


def test_people_over_time(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4), ("d", 1), ("d", 4), ("d", None)]
    assert people(spark, rows) == [
        ("a", 3, 2, 2, 1, 0), ("b", 2, 2, 3, 2, 1), ("c", 1, 1, 4, 2, 0), ("d", 3, 2, 4, 3, 1)
    ]


def test_people_of_full_sketches_stay_near(spark):
    """Small sketches are full here; unions, intersections and repeats stay within a few standard errors."""
    rng = np.random.default_rng(4)
    rows = [(m, int(p)) for m in "abcd" for p in rng.integers(0, 30_000, 20_000)]
    exact, near = people(spark, rows), people(spark, rows, 12)
    for a, b in zip(exact, near):
        assert a[:2] == b[:2] and all(abs(y / x - 1) < 0.12 for x, y in zip(a[2:], b[2:]) if x)
    seen = set()
    for m, *_, (got) in [(r[0], r[3]) for r in exact]:
        seen |= {p for n, p in rows if n == m}
        assert got == len(seen)


def test_merged_quantiles_have_bounded_rank_error(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"y": rng.integers(0, 3, 60_000), "m": rng.integers(0, 12, 60_000), "v": rng.lognormal(10, 2, 60_000).astype(int)})
    pdf.loc[::3, "v"] = 777
    df = spark.createDataFrame(pdf)
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    state = sketches.quantile_sketches(df, F.col("v"), ["y", "m"])
    for groups in (["y"], []):
        merged = sketches.merged_quantiles(state, probs, groups)
        assert merged.agg(F.sum("n")).first()[0] == 60_000
        errors = sketches.rank_errors(df, F.col("v"), merged, probs, groups) if groups else None
        if errors is not None:
            assert all(r[f"{q}_error"] <= 2 * sketches.RANK_ERROR for r in errors.collect() for q in probs)
    assert state.where("false").count() == 0


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "m string, person bigint, v bigint")
    assert sketches.people_over_time(sketches.people_by_group(empty, "m", "person"), "m").collect() == []
    assert sketches.merged_quantiles(sketches.quantile_sketches(empty, F.col("v"), ["m"]), {"p": 0.5}, ["m"]).collect() == []


def test_exact_people(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4), ("d", 1), ("d", 4), ("d", None)]
    parts = [spark.createDataFrame(some, "m string, person bigint") for some in (rows[:4], rows[4:])]
    state = sketches.people_rows(parts[0], "m", "person").union(sketches.people_rows(parts[1], "m", "person"))
    assert [tuple(r) for r in sketches.people_exactly(state, "m").orderBy("m").collect()] == people(spark, rows)
    assert sketches.people_exactly(state.where("false"), "m").collect() == []


def test_people_by_month_beyond_the_sketch(spark, tmp_path):
    """More persons a month than a sketch holds exactly: still what the SQL gives."""
    duckdb.sql(
        "SELECT range AS o_orderkey, (range % 130000) * 7919 AS o_custkey, 'F' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, "
        "TIMESTAMP '2020-01-05' + INTERVAL 1 DAY * (range // 100000 * 40) AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(300000)"
    ).write_parquet(str(tmp_path / "orders.parquet"))
    con = oracle_connection(str(tmp_path))
    got = QUERIES["people_by_month_merged"](spark, str(tmp_path))
    assert difference(got, con, ORACLE["people_by_month_merged"]) is None
