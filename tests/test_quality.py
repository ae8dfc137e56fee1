"""Profiles, integrity and expectations, null handling included."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions.classify import bucket_conditions, frequency_bucket, rfm_segment, star_sentiment
from grainwise.functions.money import cents, exact_total, minor_units, wide_total
from grainwise.functions.temporal import elapsed_days, elapsed_micros, parse_timestamp, plus_days, whole_days, year_month
from grainwise.operators import quality


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_key_coverage_counts_nulls_as_unmatched(spark):
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    child = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "c string")
    got = quality.key_coverage(parent, "p", child, "c", "orphans", "childless")
    assert rows(got) == [(2, 2)]


def test_children_profile_max_is_null_without_families(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(quality.children_profile({"c": (df, "k")})) == [("c", 0, None)]


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert rows(quality.null_profile({"t": df})) == [("t", "a", 3, 1, 33.33), ("t", "b", 3, 2, 66.67)]
    empty = spark.createDataFrame([], "a int")
    assert rows(quality.null_profile({"e": empty})) == [("e", "a", 0, 0, None)]


def test_unmapped_values(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "c string")
    lookup = spark.createDataFrame([("x",), (None,)], "l string")
    assert rows(quality.unmapped_values(df, "c", lookup, "l")) == [("y",)]


def test_value_mix_and_repeat_rate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, f int")
    assert rows(quality.value_mix(df, "k", "n")) == [("a", 2, 66.67), ("b", 1, 33.33)]
    assert rows(quality.repeat_rate(df, "f")) == [(3, 1, 33.33)]


def test_data_dictionary_marks_derived_tables(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    got = quality.data_dictionary({"raw": df, "made": df}, {("raw", "a"): "first", ("made", "a"): "first"}, ["made"])
    assert rows(got)[0] == ("made", "a", "int", "first", "yes", 1, 0.0, 1, True, "1")
    assert rows(got)[3] == ("raw", "b", "string", "—", "no", 1, 100.0, 0, True, None)


def test_data_dictionary_counts_beyond_the_sketch(spark):
    """Types, nulls and odd names included; the sketches alone are off here."""
    df = spark.sql(
        "SELECT id % 90001 AS a, if(id % 2 = 0, id / 8, null) AS b, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS `d.e`, "
        "array(cast(id AS float)) AS f, id % 3 AS g FROM range(180000)"
    )
    got = quality.data_dictionary({"t": df, "few": df.limit(5)}, {}, [])
    counts = {(r.tbl, r.field): (r.n_distinct, r.distinct_exact) for r in got.collect()}
    assert counts == {
        ("t", "a"): (90_001, False), ("t", "b"): (90_000, False), ("t", "d.e"): (180_000, False), ("t", "f"): (180_000, False),
        ("t", "g"): (3, True), ("few", "a"): (5, True), ("few", "b"): (3, True), ("few", "d.e"): (5, True), ("few", "f"): (5, True), ("few", "g"): (3, True),
    }


def test_field_profile_reads_a_table_once(spark, tmp_path):
    df = spark.sql("SELECT id % 7 AS a, array(id) AS b, if(id % 2 = 0, id / 3, null) AS c, timestamp_ntz'2020-01-01 00:00:00' AS `d.e` FROM range(100)")
    df.write.parquet(str(tmp_path / "t"))
    got = quality.field_profile({"t": spark.read.parquet(str(tmp_path / "t"))})
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert [(r.field, r.missing_pct, r.n_distinct, r.distinct_exact) for r in got.collect()] == [
        ("a", 0.0, 7, True), ("b", 0.0, 100, True), ("c", 50.0, 50, True), ("d.e", 0.0, 1, True)
    ]
    assert {r.field: r.example for r in got.collect()}["b"] == "array of 1"


def test_time_functions(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2018-01-01 23:00:00' AS a, timestamp_ntz'2018-01-03 01:00:00' AS b, "
        "'2018-13-45' AS bad, '2018-01-02 03:04:05' AS good"
    )
    got = df.select(
        whole_days(F.col("a"), F.col("b")),
        whole_days(F.col("b"), F.col("a")),
        elapsed_days(F.col("a"), F.col("b")),
        parse_timestamp(F.col("bad")),
        parse_timestamp(F.col("good")).cast("string"),
    ).first()
    assert tuple(got) == (1, -2, 26 / 24, None, "2018-01-02 03:04:05")


def test_time_functions_ignore_the_session_zone(spark):
    # this zone skips the hour after midnight of 1995-10-15
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = spark.sql("SELECT timestamp_ntz'1995-10-14 23:00:00' AS a, timestamp_ntz'1995-10-15 00:00:00' AS b")
        got = df.select(
            elapsed_micros(F.col("a"), F.col("b")),
            plus_days(F.col("a"), F.lit(1)).cast("string"),
            year_month(F.col("b")),
            parse_timestamp(F.lit("1995-10-15 00:00:00")).cast("string"),
        ).first()
        assert tuple(got) == (3_600_000_000, "1995-10-15 23:00:00", "1995-10", "1995-10-15 00:00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_money_totals_are_exact(spark):
    df = spark.createDataFrame([(1.15,), (-2.30,), (0.07,), (None,)], "x double")
    got = df.select(cents(F.col("x")).alias("c")).agg(exact_total(F.col("c")), wide_total(F.col("c"))).first()
    assert [float(v) for v in got] == [-1.08, -1.08]
    # the plain sum of these would exceed BIGINT
    large = spark.range(4).select(F.lit(2**62 + 3).alias("c"))
    assert int(large.agg(wide_total(F.col("c"), 0)).first()[0]) == 4 * (2**62 + 3)
    text = spark.sql("SELECT cast('12.34' AS decimal(12,2)) AS d")
    assert text.select(minor_units(F.col("d"))).first()[0] == 1234


def test_rules(spark):
    scored = spark.createDataFrame(
        [(2, 1, 1), (1, 4, 4), (1, 5, 3), (1, 2, 4), (1, 1, 1), (1, 3, 5)], "f int, r int, m int"
    )
    got = [r[0] for r in scored.select(rfm_segment(F.col("f"), F.col("r"), F.col("m"))).collect()]
    assert got == [
        "Repeat (Loyal/Champion)", "New high-value", "New / recent", "Dormant high-value", "Dormant", "Mid one-time",
    ]
    numbers = spark.range(1, 6).select(star_sentiment(F.col("id")), frequency_bucket(F.col("id")))
    assert [tuple(r) for r in numbers.collect()] == [
        ("negative", "1"), ("negative", "2"), ("neutral", "3+"), ("positive", "3+"), ("positive", "3+"),
    ]
    edges = spark.createDataFrame([(-0.1,), (0.0,), (4.99,), (5.0,), (1e9,)], "v double")
    first, last = bucket_conditions(F.col("v"), [0, 5])
    assert [tuple(r) for r in edges.select(first, last).collect()] == [
        (False, False), (True, False), (True, False), (False, True), (False, True),
    ]
