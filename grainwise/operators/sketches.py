"""Mergeable state: distinct counts, people over months, quantiles of bounded rank error.

A sketch is a binary column of fixed size. It is built in one aggregate, stored beside its
group (a month, say), and merged for any span of groups without reading the rows again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A distinct sketch keeps 2**DISTINCT_BITS hashes: exact up to so many values, beyond that
#: within 0.4 % (one standard error), 0.5 MB at most.
DISTINCT_BITS = 16
#: A quantile sketch of this size has a rank error below RANK_ERROR with 99 % confidence.
QUANTILE_SIZE = 4096
RANK_ERROR = 2.296 / QUANTILE_SIZE**0.9723


def distinct_sketch(value: Column, bits: int = DISTINCT_BITS) -> Column:
    """Sketch of the distinct non-null values of a column of any type."""
    return F.theta_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), bits)


# --- people ----------------------------------------------------------------------------


def people_by_group(df: DataFrame, group: str, person: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """(group, rows, people, repeaters): sketches of the persons of a group and of those with several rows in it."""
    per_person = df.groupBy(group, person).agg(F.count("*").alias("_n"))
    repeated = F.when(F.col("_n") > 1, F.col(person))
    return per_person.groupBy(group).agg(
        F.sum("_n").alias("rows"),
        distinct_sketch(F.col(person), bits).alias("people"),
        distinct_sketch(repeated, bits).alias("repeaters"),
    )


def people_over_time(state: DataFrame, group: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """Persons, new total, repeat persons to date and overlap with the group before.

    A person repeats once it has two rows in a group, or a row in a group after its first.
    The windows run over one row a group.
    """
    order = Window.orderBy(group)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.theta_union_agg("people", bits).over(before)
    came_back = F.theta_intersection(F.col("people"), F.col("_seen"))  # null in the first group
    size = lambda sketch: F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("bigint"))
    marked = state.withColumn("_seen", seen).withColumn("_last", F.lag("people").over(order))
    marked = marked.withColumn("_repeat", F.coalesce(F.theta_union(F.col("repeaters"), came_back, bits), F.col("repeaters")))
    return marked.select(
        group,
        "rows",
        size(F.col("people")).alias("people"),
        size(F.theta_union_agg("people", bits).over(upto)).alias("people_to_date"),
        size(F.theta_union_agg("_repeat", bits).over(upto)).alias("repeat_to_date"),
        size(F.when(F.col("_last").isNotNull(), F.theta_intersection(F.col("people"), F.col("_last")))).alias("also_in_group_before"),
    )


def people_rows(df: DataFrame, group: str, person: str) -> DataFrame:
    """(group, person, n): exact state. States of several loads may be united; equal keys add up."""
    return df.groupBy(group, F.col(person).alias("person")).agg(F.count("*").alias("n"))


def people_exactly(state: DataFrame, group: str) -> DataFrame:
    """What :func:`people_over_time` gives, without an error however many persons there are.

    One window over the few groups of a person; running sums and the order of groups run
    over one row a group.
    """
    rows = state.groupBy(group, "person").agg(F.sum("n").alias("n"))
    places = rows.select(group).distinct().withColumn("_place", F.row_number().over(Window.orderBy(group)))
    placed = rows.join(places.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    mine = Window.partitionBy("person").orderBy("_place")
    upto = F.sum("n").over(mine.rowsBetween(Window.unboundedPreceding, 0))
    marked = placed.select(
        group, "_place", "n", F.col("person").isNotNull().alias("_known"), F.lag("_place").over(mine).alias("_last"), upto.alias("_upto"),
    )
    person = lambda condition: F.count_if(F.col("_known") & condition)
    again = (F.col("_upto") > 1) & (F.col("_upto") - F.col("n") <= 1)
    counted = marked.groupBy("_place", group).agg(
        F.sum("n").alias("rows"), person(F.lit(True)).alias("people"), person(F.col("_last").isNull()).alias("_new"),
        person(again).alias("_again"), person(F.coalesce(F.col("_last") == F.col("_place") - 1, F.lit(False))).alias("also_in_group_before"),
    )
    to_date = lambda c: F.sum(c).over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return counted.select(
        group, "rows", "people", to_date("_new").alias("people_to_date"), to_date("_again").alias("repeat_to_date"), "also_in_group_before"
    )


# --- quantiles --------------------------------------------------------------------------


def quantile_sketches(df: DataFrame, value: Column, groups: Sequence[str], size: int = QUANTILE_SIZE) -> DataFrame:
    """(groups, sketch) of an integer column; rows without a value do not count."""
    known = df.select(*groups, value.cast("bigint").alias("_v")).where("_v is not null")
    return known.groupBy(*groups).agg(F.kll_sketch_agg_bigint("_v", size).alias("sketch"))


def merged_quantiles(state: DataFrame, probs: Mapping[str, float], groups: Sequence[str] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """(groups, n, one value for each of ``probs``) of all sketches of a group of groups."""
    merged = state.groupBy(*groups).agg(F.kll_merge_agg_bigint("sketch", size).alias("sketch"))
    return merged.select(
        *groups,
        F.kll_sketch_get_n_bigint("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name) for name, p in probs.items()],
    )


def rank_errors(df: DataFrame, value: Column, estimates: DataFrame, probs: Mapping[str, float], groups: Sequence[str]) -> DataFrame:
    """How far the rank of each estimate lies from the wanted one, from all rows in one pass.

    An estimate holds the ranks of all rows that equal it, so the distance to that interval counts.
    ``estimates`` has one row a group.
    """
    names = {g: f"_g{i}" for i, g in enumerate(groups)}
    right = estimates.select(*[F.col(g).alias(n) for g, n in names.items()], *probs)
    on = [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()]
    placed = df.select(*groups, value.cast("bigint").alias("_v")).where("_v is not null").join(right, on)
    counted = placed.groupBy(*groups).agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col("_v") < F.col(q)).alias(f"_below_{q}") for q in probs],
        *[F.count_if(F.col("_v") <= F.col(q)).alias(f"_upto_{q}") for q in probs],
    )
    error = lambda q, p: F.greatest(
        F.lit(0.0), F.col(f"_below_{q}") / F.col("_n") - p, p - F.col(f"_upto_{q}") / F.col("_n")
    )
    return counted.select(*groups, *[error(q, p).alias(f"{q}_error") for q, p in probs.items()])
