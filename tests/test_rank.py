"""Ranks, order statistics and bins against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainwise.operators.rank import (
    bin_cuts,
    binned,
    count_values,
    exact_quantiles,
    global_rank,
    order_statistics,
    prefix_sums,
    quantile_bin,
    quantiles,
    tied_sums,
)


def frame(spark, pdf, parts=4):
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_global_rank_is_independent_of_partitioning(spark, parts):
    rng = random.Random(7)
    # a third of all rows share one value
    values = [0 if i % 3 == 0 else rng.randint(-5, 50) for i in range(3000)]
    pdf = pd.DataFrame({"id": [f"p{i:05d}" for i in range(3000)], "v": values})
    got = global_rank(frame(spark, pdf, parts), ["v", "id"], "rank", "n").toPandas().set_index("id")
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    assert set(got.n) == {3000}
    assert [got["rank"][i] for i in want.id] == list(range(1, 3001))


def test_global_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, v int")
    assert global_rank(empty, ["v", "id"], "rank", "n").count() == 0


def test_quantile_bin_equals_interpolated_edges(spark):
    for n in [2, 3, 5, 7, 10, 11, 12, 59, 150, 1500]:
        ranks = spark.range(1, n + 1).select(quantile_bin(F.col("id"), F.lit(n).cast("bigint")).alias("b"))
        want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert [r.b for r in ranks.collect()] == list(want), n
    assert spark.range(1, 2).select(quantile_bin(F.col("id"), F.lit(1)).alias("b")).first().b == 1


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**62), 2**62) | st.integers(-3, 3) | st.none(), min_size=1, max_size=60))
def test_order_statistics_property(spark, values):
    known = sorted(v for v in values if v is not None)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = order_statistics(count_values(df, F.col("v")), lambda n: {"first": F.lit(1), "mid": (n + 1) / 2, "last": n}).first()
    if not known:
        assert got["first"] is None
        return
    n = len(known)
    assert (got["n"], got["first"], got["mid"], got["last"]) == (n, known[0], known[int((n + 1) / 2) - 1], known[-1])


def test_grouped_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-10**12, 10**13, 4000)
    v[::3] = 86_400_000_000
    pdf = pd.DataFrame({"g": rng.integers(1, 6, 4000), "v": v})
    for bounded in (True, False):
        got = exact_quantiles(
            frame(spark, pdf), F.col("v"), {"med": 0.5, "p90": 0.9}, ["g"], groups_bounded=bounded
        ).toPandas().set_index("g").sort_index()
        want = pdf.groupby("g").v.quantile([0.5, 0.9]).unstack()
        assert np.allclose(got.med, want[0.5], rtol=1e-12) and np.allclose(got.p90, want[0.9], rtol=1e-12)


def test_quantile_of_four(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    assert exact_quantiles(df, F.col("v"), {"q": 0.9}).first().q == pytest.approx(3.7)


def test_totals_include_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, 5), (3, 7), (None, 100)], "v int, w int")
    counts = count_values(df, F.col("v"), totals={"w": F.col("w")})
    assert counts.agg(F.sum("w")).first()[0] == 112
    assert quantiles(counts, {"m": 0.5}).first().m == 2.0


@pytest.mark.parametrize("values", [[5], [1, 1], list(range(12)), [0] * 13, [1, 2, 2, 2, 2, 2, 3], [7, 7, 1, 1, 1, 9, 9, 9, 9, 9, 9]])
def test_binned_equals_bins_of_ranks(spark, values):
    df = spark.createDataFrame([(v, f"id{i:02d}") for i, v in enumerate(values)], "v bigint, id string").repartition(4)
    ranked = global_rank(df, ["v", "id"], "r", "n").select("id", quantile_bin(F.col("r"), F.col("n")).alias("bin"))
    got = binned(df, F.col("v"), "id", "bin").select("id", "bin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranked.collect()))


def test_bins_of_two_measures_share_one_count(spark):
    rng = random.Random(11)
    rows = [(f"id{i:04d}", rng.choice([0, 0, 0, rng.randint(1, 9)]), rng.randint(0, 10**9)) for i in range(997)]
    df = spark.createDataFrame(rows, "id string, a bigint, b bigint").repartition(5)
    cuts = bin_cuts(df, {"a": F.col("a"), "b": F.col("b")}, "id")
    assert len(cuts["a"]) == len(cuts["b"]) == 4
    assert any(c.last for c in cuts["a"]) and not any(c.last for c in cuts["b"])
    for m in "ab":
        ranked = global_rank(df, [m, "id"], "r", "n").select("id", quantile_bin(F.col("r"), F.col("n")).alias("bin"))
        assert sorted(map(tuple, binned(df, F.col(m), "id", "bin").select("id", "bin").collect())) == sorted(map(tuple, ranked.collect()))


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums_by_row_and_by_value(spark, parts):
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, 2000)
    v[::3] = 7
    pdf = pd.DataFrame({"id": [f"p{i:05d}" for i in range(2000)], "v": v})
    placed = prefix_sums(frame(spark, pdf, parts), [F.desc("v"), F.asc("id")], {"s": "v"})
    got = placed.toPandas().sort_values("_at")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert list(got.id) == list(want.id) and list(got["_at"]) == list(range(1, 2001))
    assert list(got.s) == list(want.v.cumsum()) and set(got.s_total) == {int(v.sum())}
    tied = tied_sums(placed, "v", "s").toPandas().set_index("v")
    last = want.assign(s=want.v.cumsum()).groupby("v").s.agg(["last", "size"])
    assert all(tied.s[k] == last["last"][k] and tied.n[k] == last["size"][k] for k in last.index)


def test_prefix_sums_meet_in_one_task_only_as_totals(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("v"), "id")
    text = prefix_sums(df, [F.desc("v"), F.asc("id")], {"s": "v"})._jdf.queryExecution().executedPlan().toString()
    before = text.split("Exchange SinglePartition")
    assert len(before) == 2 and "HashAggregate(keys=[_groupingexpression" in before[1].splitlines()[1]


def test_prefix_sums_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, v bigint")
    assert prefix_sums(empty, [F.desc("v"), F.asc("id")], {"s": "v"}).collect() == []
