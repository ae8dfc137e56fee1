"""Agreement measures against known figures and textbook formulas."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from grainwise.functions.stats import correlation, wilson_bounds
from grainwise.functions.text import collapse_whitespace
from grainwise.operators import agreement as ag
from grainwise.plans import labels as lab

# counts of reference (rows) against system (columns) on 200 doubly labelled reviews
TOPIC = [[57, 15, 0, 1, 1], [1, 67, 0, 2, 0], [0, 2, 5, 0, 1], [1, 0, 0, 9, 1], [0, 2, 0, 0, 35]]
SENTIMENT = [[72, 0, 0], [7, 11, 3], [0, 2, 105]]


def pairs(spark, matrix, labels):
    cells = [(r, c, n) for r, row in zip(labels, matrix) for c, n in zip(labels, row) if n]
    df = spark.createDataFrame(cells, "reference string, system string, n int")
    return df.select("reference", "system", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


@pytest.mark.parametrize(
    "matrix, labels, want",
    [
        (TOPIC, lab.TOPICS, (200, 173, 0.865, 0.8107, 0.9055, 0.8074)),
        (SENTIMENT, lab.SENTIMENTS, (200, 188, 0.94, 0.8981, 0.9653, 0.8933)),
    ],
)
def test_published_agreement(spark, matrix, labels, want):
    got = ag.agreement(pairs(spark, matrix, labels), "reference", "system", labels).first()
    assert tuple(got) == pytest.approx(want, abs=5e-5)


def test_confusion_and_recall(spark):
    df = pairs(spark, TOPIC, lab.TOPICS)
    df = df.unionByName(spark.createDataFrame([("nonsense", "other", 1)], df.schema))
    matrix = ag.confusion_matrix(df, "reference", "system", lab.TOPICS).collect()
    assert [list(r)[1:] for r in matrix] == TOPIC
    recall = {r.label: (r.support, r.recall) for r in ag.class_recall(df, "reference", "system", [*lab.TOPICS, "none"]).collect()}
    assert recall["delivery_shipping"] == (74, pytest.approx(57 / 74, abs=1e-6))
    assert recall["none"] == (0, None)


def test_single_class_has_kappa_one(spark):
    df = spark.createDataFrame([("a", "a")] * 3, "r string, s string")
    assert ag.agreement(df, "r", "s", ["a", "b"]).first().kappa == 1.0


def test_labels_outside_the_set_lower_chance_agreement_only(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("zz", "zz"), ("a", None)], "r string, s string")
    got = ag.agreement(df, "r", "s", ["a", "b"]).first()
    po, pe = 3 / 4, (2 / 4) * (1 / 4) + (1 / 4) * (1 / 4)
    assert got.agreement == po and got.kappa == pytest.approx((po - pe) / (1 - pe), abs=1e-6)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (3, 7)], "k int, n int")
    got = [tuple(r) for r in df.select(*wilson_bounds(F.col("k"), F.col("n"))).collect()]
    assert got[0] == (0.0, 0.0) and got[1][0] == 0.0 and got[2][1] == 1.0
    p, n, z = 3 / 7, 7, 1.96
    mid = p + z * z / (2 * n)
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    assert got[3] == pytest.approx(((mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)))


def test_annotator_report_uses_gold_rows_only(spark):
    df = spark.createDataFrame(
        [
            ("other", "other", "positive", "positive", 5, 1),
            ("other", "price_value", "negative", "negative", 1, 1),
            ("other", None, "neutral", None, 5, 0),
        ],
        "topic string, gold_topic string, sentiment string, gold_sentiment string, review_score int, in_gold int",
    )
    got = lab.annotator_report(df, F.col("in_gold") == 1).first()
    assert (got.n, got.topic_agreement, got.sentiment_agreement, got.joint_agreement) == (2, 0.5, 1.0, 0.5)
    assert got.star_agreement == pytest.approx(2 / 3, abs=1e-6)
    assert got.confidence == "Low" and got.sentiment_kappa == 1.0


def test_verdict(spark):
    df = spark.createDataFrame([(0.8, 0.9, 0.83), (0.8, 0.9, 0.5), (0.5, 0.9, 0.9)], "a double, b double, c double")
    got = [r[0] for r in df.select(ag.verdict(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["High", "Medium", "Low"]


def test_external_validity_and_breakdowns(spark):
    df = spark.createDataFrame(
        [("price_value", "negative", 1, 2.0), ("price_value", "negative", 4, 4.0), ("other", "positive", 5, None)],
        "topic string, sentiment string, review_score int, delivery_days double",
    )
    got = {r.sentiment: (r.mean_score, r.n, r.agreement) for r in lab.external_validity(df).collect()}
    assert got == {"negative": (2.5, 2, 0.5), "positive": (5.0, 1, 1.0), "all": (3.3333, 3, 0.666667)}
    assert [tuple(r) for r in lab.topic_breakdown(df).collect()] == [("price_value", 2, 3.0, 2.5, 100.0)]
    tab = [tuple(r) for r in lab.sentiment_by_topic(df).collect()]
    assert tab[2] == ("price_value", 2, 0, 0) and tab[0] == ("delivery_shipping", 0, 0, 0) and len(tab) == 5
    dist = {r.label: r.n for r in ag.label_distribution(df, "sentiment", lab.SENTIMENTS).collect()}
    assert dist == {"negative": 2, "neutral": 0, "positive": 1}


def test_label_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "idx int")
    assert {r.metric: r.value for r in lab.label_checks(df).collect()} == {"label_rows": 3.0, "label_keys": 2.0}


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("size", [5, 1000])
def test_sample_is_reproducible(spark, parts, size):
    df = spark.range(300).select("id", F.when(F.col("id") % 10 == 0, "text").alias("t")).repartition(parts)
    order = lambda ids: sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    everything = {r.idx: r.id for r in ag.reproducible_sample(df, "id", size, 42).collect()}
    assert everything == dict(enumerate(order(range(300))[:size]))
    with_text = {r.idx: r.id for r in ag.reproducible_sample(df, "id", size, 42, F.col("t").isNotNull()).collect()}
    assert with_text == dict(enumerate(order(range(0, 300, 10))[:size]))


def test_whitespace(spark):
    raw = "  a\t\n b 　c \x1c d​e\r\n"
    df = spark.createDataFrame([(raw,), ("   ",), (None,)], "t string")
    got = [r[0] for r in df.select(collapse_whitespace(F.col("t"))).collect()]
    assert got == ["a b c d​e", "", None]


def test_correlation_of_moments(spark):
    got = spark.range(1).select(correlation(F.lit(4.0), F.lit(9.0), F.lit(3.0)).alias("a"), correlation(F.lit(0.0), F.lit(9.0), F.lit(0.0)).alias("b"))
    assert tuple(got.first()) == (0.5, None)
