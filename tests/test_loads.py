"""Checked writes in one scan; integrity counts that equal a full recount after every load."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grainwise.operators import loads
from grainwise.sources.io import land_bucketed
from tests.test_plans import large, plan  # noqa: F401


def rules():
    return {"positive": F.col("v") > 0, "named": F.col("name") != ""}


def test_checked_write(spark, tmp_path):
    rows = [(1, "a"), (0, "a"), (-1, ""), (2, ""), (None, "a"), (3, None)]
    df = spark.createDataFrame(rows, "v int, name string")
    kept, found = loads.checked_write(df, rules(), str(tmp_path / "out"))
    assert found == {"rows": 6, "accepted": 1, "positive": 3, "named": 2}
    assert [tuple(r) for r in kept.where("outcome = 'accepted'").collect()] == [(1, "a", "accepted")]
    assert kept.where("outcome = 'positive'").count() == 3
    assert "PartitionFilters: [isnotnull(outcome" in plan(kept.where("outcome = 'accepted'"))


def test_too_many_refused_rows_are_kept_for_a_look(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "a")], "v int, name string")
    with pytest.raises(ValueError, match="refused"):
        loads.checked_write(df, rules(), str(tmp_path / "out"), most_refused=0.4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_checked_write_of_nothing(spark, tmp_path):
    kept, found = loads.checked_write(spark.createDataFrame([], "v int, name string"), rules(), str(tmp_path / "out"))
    assert kept.collect() == [] and found == {"rows": 0, "accepted": 0, "positive": 0, "named": 0}


def test_carried_counts_equal_a_recount(spark, tmp_path):
    rng = random.Random(3)
    key = lambda: rng.choice([None, *range(40)])
    parents, children, orphans, childless = [], [], 0, 0
    for load in range(1, 5):
        new_parents = [(key(),) for _ in range(rng.randint(0, 12))]
        new_children = [(key(),) for _ in range(rng.randint(0, 30))]
        parents += new_parents
        children += new_children
        row = loads.integrity_load(
            spark.createDataFrame(new_parents, "p bigint"), "p", spark.createDataFrame(new_children, "c bigint"), "c", str(tmp_path / "state"), load
        ).first()
        orphans, childless = orphans + row.orphans_change, childless + row.childless_change
        have, used = {p for p, in parents if p is not None}, {c for c, in children if c is not None}
        assert orphans == sum(c not in have for c, in children)
        assert childless == sum(p not in used for p, in parents)
        assert row.touched == len({k for k, in new_parents + new_children})


def test_a_repeated_load_counts_once(spark, tmp_path):
    frame = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k bigint")
    for _ in range(2):
        row = loads.integrity_load(frame(1, 2), "k", frame(2, 3), "k", str(tmp_path / "state"), 1).first()
        assert (row.orphans_change, row.childless_change) == (1, 1)


def test_buckets_spare_the_exchange(large, tmp_path):  # noqa: F811
    orders = large.range(500).select(F.col("id").alias("a"), F.lit("x").alias("o"))
    items = large.range(2000).select((F.col("id") % 500).alias("b"), "id")
    landed = land_bucketed({"orders": (orders, "a"), "items": (items, "b")}, str(tmp_path / "tables"), 4)
    per_order = landed["items"].groupBy(F.col("b").alias("a")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
    joined = landed["orders"].join(per_order, "a", "left")
    assert "Exchange" not in plan(joined)
    assert {(r.n, r.d) for r in joined.collect()} == {(4, 4)}
