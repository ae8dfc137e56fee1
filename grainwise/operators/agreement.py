"""Label validation: agreement, kappa, confusion, intervals, reproducible samples.

Label sets are fixed and short, so every matrix is a set of conditional counts in
one aggregate row that is unfolded afterwards. Labels never travel to the driver
and empty classes keep their row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.functions.stats import count_true, percent, ratio, wilson_bounds
from grainwise.functions.text import sample_hash
from grainwise.operators.frames import long_form


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def agreement_sums(ref: Column, sys: Column, labels: Sequence[str], prefix: str) -> list[Column]:
    """Aggregates that agreement and kappa need; several label pairs can share one pass."""
    return [
        count_true(_same(ref, sys)).alias(f"{prefix}hits"),
        *[count_true(ref == lab).alias(f"{prefix}r{i}") for i, lab in enumerate(labels)],
        *[count_true(sys == lab).alias(f"{prefix}s{i}") for i, lab in enumerate(labels)],
    ]


def agreement_scores(labels: Sequence[str], prefix: str, n: Column, digits: int = 6) -> dict[str, Column]:
    """Observed agreement, its interval and Cohen's kappa from :func:`agreement_sums`.

    Rows with labels outside the set count towards observed but not towards chance
    agreement. When chance agreement is 1, kappa is 1.
    """
    hits = F.col(f"{prefix}hits")
    observed, chance = ratio(hits, n), F.lit(0.0)
    for i, _ in enumerate(labels):
        chance = chance + ratio(F.col(f"{prefix}r{i}"), n) * ratio(F.col(f"{prefix}s{i}"), n)
    kappa = F.when(chance == 1, 1.0).otherwise(F.try_divide(observed - chance, 1 - chance))
    low, high = wilson_bounds(hits, n)
    values = {"agreement": observed, "ci_low": low, "ci_high": high, "kappa": kappa}
    return {name: F.round(v, digits) for name, v in values.items()}


def agreement(df: DataFrame, reference: str, system: str, labels: Sequence[str]) -> DataFrame:
    """Rows, matches, observed agreement with its interval, and kappa, in one row."""
    sums = df.agg(
        F.count("*").alias("n"), *agreement_sums(F.col(reference), F.col(system), labels, "_")
    )
    scores = agreement_scores(labels, "_", F.col("n"))
    return sums.select("n", F.col("_hits").alias("hits"), *[v.alias(k) for k, v in scores.items()])


def all_match(pairs: Sequence[tuple[str, str]]) -> Column:
    """True when every pair of labels is equal."""
    return reduce(lambda a, b: a & b, [_same(F.col(a), F.col(b)) for a, b in pairs])


def verdict(topic_kappa: Column, sentiment_kappa: Column, external: Column) -> Column:
    """Confidence rule over the two kappas and the external agreement."""
    return (
        F.when((topic_kappa >= 0.7) & (sentiment_kappa >= 0.7) & (external >= 0.8), "High")
        .when((topic_kappa >= 0.55) & (sentiment_kappa >= 0.6), "Medium")
        .otherwise("Low")
    )


def _matrix(df: DataFrame, rows: str, cols: str, row_labels: Sequence[str], col_labels: Sequence[str]) -> DataFrame:
    """Conditional counts of every label pair, one output row per row label."""
    cell = lambda i, j: f"_c{i}_{j}"
    counted = df.agg(
        *[
            count_true((F.col(rows) == r) & (F.col(cols) == c)).alias(cell(i, j))
            for i, r in enumerate(row_labels)
            for j, c in enumerate(col_labels)
        ]
    )
    cells = {
        r: F.struct(*[F.col(cell(i, j)).alias(c) for j, c in enumerate(col_labels)])
        for i, r in enumerate(row_labels)
    }
    return long_form(counted, cells, rows, "_cells").select(rows, "_cells.*")


def confusion_matrix(df: DataFrame, reference: str, system: str, labels: Sequence[str]) -> DataFrame:
    """Reference labels down, system labels across; labels outside the set are ignored."""
    return _matrix(df, reference, system, labels, labels)


def crosstab(df: DataFrame, rows: str, cols: str, row_labels: Sequence[str], col_labels: Sequence[str]) -> DataFrame:
    """Counts with a fixed row and column order; absent combinations are 0."""
    return _matrix(df, rows, cols, row_labels, col_labels)


def class_recall(df: DataFrame, reference: str, system: str, labels: Sequence[str]) -> DataFrame:
    """Support and recall per reference label; no support gives null."""
    matrix = confusion_matrix(df, reference, system, labels)
    support = sum((F.col(f"`{lab}`") for lab in labels), F.lit(0).cast("bigint"))
    hit = F.coalesce(*[F.when(F.col(reference) == lab, F.col(f"`{lab}`")) for lab in labels])
    return matrix.select(
        F.col(reference).alias("label"), support.alias("support"), F.round(ratio(hit, support), 6).alias("recall")
    )


def label_distribution(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Counts in the order of a fixed label list, 0 for absent labels."""
    counted = df.agg(*[count_true(F.col(column) == lab).alias(f"_l{i}") for i, lab in enumerate(labels)])
    return long_form(counted, {lab: F.col(f"_l{i}") for i, lab in enumerate(labels)}, "label", "n")


def proportions(df: DataFrame, group: str, hit: Column, z: float = 1.96) -> DataFrame:
    """Hits, trials and the score interval of their ratio per group."""
    counted = df.groupBy(group).agg(count_true(hit).alias("hits"), F.count("*").alias("n"))
    low, high = wilson_bounds(F.col("hits"), F.col("n"), z)
    return counted.select(
        group,
        "hits",
        "n",
        F.round(ratio(F.col("hits"), F.col("n")), 6).alias("rate"),
        F.round(low, 6).alias("ci_low"),
        F.round(high, 6).alias("ci_high"),
    )


def negatives_by_topic(
    df: DataFrame, topic: str, sentiment: str, days: str, score: str, topics: Sequence[str]
) -> DataFrame:
    """What negative rows are about: count, mean delay, mean score, share of negatives."""
    negative = df.filter((F.col(sentiment) == "negative") & F.col(topic).isin(list(topics)))
    grouped = negative.groupBy(topic).agg(
        F.count("*").alias("n"),
        F.round(F.avg(days), 2).alias("avg_delivery_days"),
        F.round(F.avg(score), 2).alias("avg_review_score"),
    )
    total = F.sum("n").over(Window.partitionBy())
    return grouped.withColumn("pct_of_negatives", percent(F.col("n"), total, 1))


def subgroup_against_base(df: DataFrame, subgroup: Column, measures: Mapping[str, str]) -> DataFrame:
    """Means of a subgroup next to the means of all rows, in one pass."""
    aggs = []
    for name, column in measures.items():
        aggs.append(F.round(F.avg(F.when(subgroup, F.col(column))), 4).alias(f"{name}_subgroup"))
        aggs.append(F.round(F.avg(column), 4).alias(f"{name}_base"))
    return df.agg(*aggs)


#: First-level groups of the sampled ids: what one task orders at most is ``size`` times this.
SAMPLE_GROUPS = 256


def reproducible_sample(
    df: DataFrame, row_id: str, size: int, seed: int, eligible: Column | None = None
) -> DataFrame:
    """Exactly ``size`` eligible rows (or all) in the order of a seeded hash, with a dense ``idx``.

    ``row_id`` is unique. The least hashes are found from ids alone, in two levels: each
    of ``SAMPLE_GROUPS`` groups of tasks keeps its ``size`` least (already cut to as many
    inside each task), and the groups' least are ordered once more. The chosen ids, at most
    ``size`` rows, then pick the wide rows in one more scan. Nothing runs while the plan
    is built.
    """
    chosen = df if eligible is None else df.filter(eligible)
    ids = chosen.select(F.col(row_id).alias("_id"), sample_hash(seed, F.col(row_id)).alias("_digest"))
    group = Window.partitionBy("_group").orderBy("_digest", "_id")
    least = (
        ids.withColumn("_group", F.spark_partition_id() % SAMPLE_GROUPS)
        .withColumn("_place", F.row_number().over(group))
        .filter(F.col("_place") <= size)
        .orderBy("_digest", "_id")
        .limit(size)
        .select("_id", (F.row_number().over(Window.orderBy("_digest", "_id")) - 1).alias("idx"))
    )
    return chosen.join(least, F.col(row_id).eqNullSafe(F.col("_id"))).drop("_id")


def nested_sample(sample: DataFrame, size: int, seed: int, flag: str) -> DataFrame:
    """Mark a second seeded draw inside a sample; works on the sampled rows only."""
    order = Window.orderBy(sample_hash(seed, F.col("idx")), "idx")
    return sample.withColumn(flag, (F.row_number().over(order) <= size).cast("int"))
