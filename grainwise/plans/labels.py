"""Label validation products over a classified sample."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.functions.classify import star_sentiment
from grainwise.functions.stats import count_true, ratio, wilson_bounds
from grainwise.functions.text import collapse_whitespace
from grainwise.operators import agreement as ag
from grainwise.sources.io import read_csv, write_csv, write_labelling_text
from grainwise.sources.schemas import LABELS

# The label sets of the classified reviews.
TOPICS = ["delivery_shipping", "product_quality", "price_value", "customer_service", "other"]
SENTIMENTS = ["negative", "neutral", "positive"]


def draw_sample(
    texts: DataFrame, row_id: str, text: str, size: int, gold: int, seeds: tuple[int, int] = (42, 43)
) -> DataFrame:
    """Seeded sample of rows that have text, a flagged nested sample, normalised text."""
    sample = ag.reproducible_sample(texts, row_id, size, seeds[0], F.col(text).isNotNull())
    flagged = ag.nested_sample(sample, gold, seeds[1], "in_gold")
    return flagged.withColumn("text", collapse_whitespace(F.col(text)))


def classified(sample: DataFrame, labels: DataFrame, gold: DataFrame, key: str = "idx") -> DataFrame:
    """Sample with bulk and gold labels; the raw text is dropped before publication.

    The sample's keys reduce both label tables before the joins; whether they are
    broadcast is left to their measured size.
    """
    wanted = sample.select(key)
    first = labels.join(wanted, key, "left_semi")
    second = gold.join(wanted, key, "left_semi").select(
        key, F.col("topic").alias("gold_topic"), F.col("sentiment").alias("gold_sentiment")
    )
    return sample.drop("text").join(first, key, "left").join(second, key, "left")


def label_checks(labels: DataFrame, key: str = "idx") -> DataFrame:
    """Row count and key uniqueness of a delivered label file, as measured metrics."""
    return labels.agg(
        F.count("*").cast("double").alias("label_rows"),
        F.count_distinct(key).cast("double").alias("label_keys"),
    ).unpivot([], ["label_rows", "label_keys"], "metric", "value")


def ingest_labels(spark: SparkSession, path: str, expected_rows: int) -> DataFrame:
    """Read a label CSV and refuse it unless it has the expected number of unique keys."""
    labels = read_csv(spark, path, LABELS)
    found = {r.metric: int(r.value) for r in label_checks(labels).collect()}  # two figures
    if found != {"label_rows": expected_rows, "label_keys": expected_rows}:
        raise ValueError(f"expected {expected_rows} unique labels, found {found}")
    return labels


def build_labels(sample: DataFrame, bulk: DataFrame, gold: DataFrame, target: str) -> dict[str, DataFrame]:
    """Write the classified sample without its text, and the label reports."""
    write_labelling_text(sample, os.path.join(target, "to_label"))
    path = os.path.join(target, "review_classification")
    write_csv(classified(sample, bulk, gold), path, single_file=True)
    schema = sample.drop("text").schema
    for name in ("topic", "sentiment", "gold_topic", "gold_sentiment"):
        schema = schema.add(name, "string")
    df = read_csv(sample.sparkSession, path, schema)
    reports = {
        "topic_breakdown": topic_breakdown(df).orderBy(F.desc("n"), "topic"),
        "sentiment_by_topic": sentiment_by_topic(df),
        "annotator_report": annotator_report(df, F.col("in_gold") == 1),
        "external_validity": external_validity(df),
        "topic_recall": ag.class_recall(df.filter("in_gold = 1"), "gold_topic", "topic", TOPICS),
        "sentiment_recall": ag.class_recall(df.filter("in_gold = 1"), "gold_sentiment", "sentiment", SENTIMENTS),
    }
    for name, report in reports.items():
        write_csv(report, os.path.join(target, name), single_file=True)
    return reports


def external_validity(df: DataFrame, sentiments: Sequence[str] = SENTIMENTS) -> DataFrame:
    """Predicted sentiment against the star-derived one, per predicted class and overall."""
    hit = F.coalesce(F.col("sentiment") == star_sentiment(F.col("review_score")), F.lit(False))
    counted = df.groupBy("sentiment").agg(
        count_true(hit).alias("_hits"),
        F.count("*").alias("_rows"),
        F.count("review_score").alias("n"),
        F.sum("review_score").alias("_score"),
    )
    by_class = F.col("sentiment").isin(list(sentiments))
    every = counted.agg(
        *[F.sum(c).alias(c) for c in ("_hits", "_rows", "n", "_score")]
    ).select(F.lit("all").alias("sentiment"), "_hits", "_rows", "n", "_score")
    low, high = wilson_bounds(F.col("_hits"), F.col("_rows"))
    return counted.filter(by_class).unionByName(every).select(
        "sentiment",
        F.round(ratio(F.col("_score"), F.col("n")), 4).alias("mean_score"),
        "n",
        F.round(ratio(F.col("_hits"), F.col("_rows")), 6).alias("agreement"),
        F.round(low, 6).alias("ci_low"),
        F.round(high, 6).alias("ci_high"),
    )


def annotator_report(
    df: DataFrame, in_gold: Column, topics: Sequence[str] = TOPICS, sentiments: Sequence[str] = SENTIMENTS
) -> DataFrame:
    """Agreement and kappa of both label sets, joint agreement and confidence verdict.

    Labels are compared on the gold rows, sentiment and stars on all rows.
    """
    pairs = [("topic", "gold_topic"), ("sentiment", "gold_sentiment")]
    stars = F.coalesce(F.col("sentiment") == star_sentiment(F.col("review_score")), F.lit(False))
    marked = df.withColumn("_stars", stars).withColumn("_gold", F.coalesce(in_gold, F.lit(False)))
    # outside the gold rows every compared label is null, so the sums skip those rows
    for name in ("topic", "sentiment", "gold_topic", "gold_sentiment"):
        marked = marked.withColumn(name, F.when(F.col("_gold"), F.col(name)))
    sums = marked.agg(
        count_true(F.col("_gold")).alias("n"),
        count_true(ag.all_match(pairs)).alias("_joint"),
        ratio(count_true(F.col("_stars")), F.count("*")).alias("_star_rate"),
        *ag.agreement_sums(F.col("gold_topic"), F.col("topic"), topics, "_t"),
        *ag.agreement_sums(F.col("gold_sentiment"), F.col("sentiment"), sentiments, "_s"),
    )
    topic = ag.agreement_scores(topics, "_t", F.col("n"))
    sentiment = ag.agreement_scores(sentiments, "_s", F.col("n"))
    return sums.select(
        "n",
        *[v.alias(f"topic_{k}") for k, v in topic.items()],
        *[v.alias(f"sentiment_{k}") for k, v in sentiment.items()],
        F.round(ratio(F.col("_joint"), F.col("n")), 6).alias("joint_agreement"),
        F.round("_star_rate", 6).alias("star_agreement"),
        ag.verdict(topic["kappa"], sentiment["kappa"], F.col("_star_rate")).alias("confidence"),
    )


def topic_breakdown(df: DataFrame, topics: Sequence[str] = TOPICS) -> DataFrame:
    return ag.negatives_by_topic(df, "topic", "sentiment", "delivery_days", "review_score", topics)


def sentiment_by_topic(
    df: DataFrame, topics: Sequence[str] = TOPICS, sentiments: Sequence[str] = SENTIMENTS
) -> DataFrame:
    return ag.crosstab(df, "topic", "sentiment", topics, sentiments)


def review_sample(
    reviews: DataFrame, orders_clean: DataFrame, size: int = 1000, gold: int = 200
) -> DataFrame:
    """Commented reviews with their delivery time, drawn reproducibly for labelling.

    A review may cover several orders, so the pair of ids identifies the row.
    """
    keyed = reviews.withColumn("_row", F.concat_ws("|", "review_id", "order_id"))
    drawn = draw_sample(keyed, "_row", "review_comment_message", size, gold)
    # the sample has at most ``size`` rows, which bounds the broadcast
    wanted = F.broadcast(drawn.select("order_id").distinct())
    days = orders_clean.join(wanted, "order_id", "left_semi").select("order_id", "delivery_days")
    return drawn.join(days, "order_id", "left").select(
        "idx", "review_id", "order_id", "review_score", "delivery_days", "in_gold", "text"
    )
