"""Profiles, integrity counts, duplication, invalid values and expectation registers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.stats import count_true, percent, ratio
from grainwise.operators.frames import inline_table, long_form, side_by_side, union_all
from grainwise.operators.grain import cogroup_counts
from grainwise.operators.sketches import DISTINCT_BITS, distinct_sketch


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Shape of every table. Counting needs no column, so only footers are read."""
    return union_all(
        [
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("tbl"), "rows", F.lit(len(df.columns)).cast("bigint").alias("cols")
            )
            for name, df in tables.items()
        ]
    )


def null_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Missing values per column: one pass and one aggregate row per table."""
    profiles = []
    for name, df in tables.items():
        counted = df.selectExpr("count(*) AS rows", *[f"count(`{c}`) AS `_{c}`" for c in df.columns])
        cells = ", ".join(f"'{c}', `_{c}`" for c in df.columns)
        profiles.append(
            counted.selectExpr(f"'{name}' AS tbl", "rows", f"stack({len(df.columns)}, {cells}) AS (field, present)")
        )
    missing = F.col("rows") - F.col("present")
    return union_all(profiles).select(
        "tbl", "field", "rows", missing.alias("missing"), percent(missing, F.col("rows")).alias("missing_pct")
    )


def duplication(df: DataFrame, key: str) -> DataFrame:
    """Rows per distinct key."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys")).withColumn(
        "rows_per_key", F.round(ratio(F.col("rows"), F.col("distinct_keys")), 1)
    )


def children_profile(children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parents with more than one child row, and the largest family (null when none)."""
    found = []
    for name, (df, key) in children.items():
        per_key = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
        found.append(
            per_key.agg(
                count_true(F.col("n") > 1).alias("multi_parents"),
                F.max(F.when(F.col("n") > 1, F.col("n"))).alias("max_children"),
            ).select(F.lit(name).alias("child"), "multi_parents", "max_children")
        )
    return union_all(found)


def key_coverage(
    parent: DataFrame, parent_key: str, child: DataFrame, child_key: str, orphans: str, childless: str
) -> DataFrame:
    """Child rows without a parent and parent rows without a child, in one shuffle.

    Both sides are reduced to key counts first, so the exchange carries one row per
    key and task instead of every child row. A null key never matches.
    """
    per_key = cogroup_counts(
        "_k",
        {
            "parent": (parent.select(F.col(parent_key).alias("_k")), {}),
            "child": (child.select(F.col(child_key).alias("_k")), {}),
        },
    )
    unmatched = F.col("_k").isNull()
    zero = F.lit(0).cast("bigint")
    return per_key.agg(
        F.coalesce(F.sum(F.when(unmatched | (F.col("n_parent") == 0), F.col("n_child"))), zero).alias(orphans),
        F.coalesce(F.sum(F.when(unmatched | (F.col("n_child") == 0), F.col("n_parent"))), zero).alias(childless),
    )


def unmapped_values(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str) -> DataFrame:
    """Distinct non-null values that the lookup lacks."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return values.join(lookup, values[column] == lookup[lookup_column], "left_anti")


def two_key_counts(df: DataFrame, fine: str, fine_name: str, coarse: str, coarse_name: str) -> DataFrame:
    """Distinct values of two columns in one row, one shuffle each of combined keys.

    Two distinct counts in one aggregate would send every row twice.
    """
    pairs = df.groupBy(fine, coarse).agg(F.lit(1).alias("_")).select(fine, coarse)
    return side_by_side(
        pairs.groupBy(fine).agg(F.lit(1)).agg(F.count(fine).alias(fine_name)),
        pairs.groupBy(coarse).agg(F.lit(1)).agg(F.count(coarse).alias(coarse_name)),
    )


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Several filtered counts in one pass, as one row."""
    return df.agg(*[count_true(c).alias(name) for name, c in conditions.items()])


def value_mix(df: DataFrame, column: str, count: str = "rows") -> DataFrame:
    """Frequency of each value with its share in percent."""
    counted = df.groupBy(column).agg(F.count("*").alias(count))
    total = df.agg(F.count("*")).scalar()
    return counted.withColumn("pct", percent(F.col(count), total))


def repeat_rate(per_person: DataFrame, frequency: str, repeat_min: int = 2) -> DataFrame:
    """People, repeat people and their rate, from a person-grain table."""
    repeat = count_true(F.col(frequency) >= repeat_min)
    return per_person.agg(F.count("*").alias("customers"), repeat.alias("repeat_customers")).withColumn(
        "repeat_rate_pct", percent(F.col("repeat_customers"), F.col("customers"))
    )


class Expectation(NamedTuple):
    """One measured value of a check; a check passes when all its values do."""

    check: str
    metric: str
    expected: float
    tolerance: float = 0.0


def expectation_register(measured: DataFrame, expected: Sequence[Expectation]) -> DataFrame:
    """Expected against measured: exact, or nearer than a tolerance.

    ``measured`` has columns ``metric`` and ``value``. An expectation without a
    measurement fails.
    """
    register = inline_table(
        measured.sparkSession,
        {
            "check": [e.check for e in expected],
            "metric": [e.metric for e in expected],
            "expected": [float(e.expected) for e in expected],
            "tolerance": [float(e.tolerance) for e in expected],
        },
    )
    off = F.abs(F.col("actual") - F.col("expected"))
    within = F.when(F.col("tolerance") > 0, off < F.col("tolerance")).otherwise(off == 0)
    return (
        register.join(
            measured.select("metric", F.col("value").cast("double").alias("actual")), "metric", "left"
        )
        .withColumn("ok", F.coalesce(within, F.lit(False)))
        .select("check", "metric", "expected", "actual", "tolerance", "ok")
    )


def register_tally(register: DataFrame) -> DataFrame:
    """Passed and total checks."""
    per_check = register.groupBy("check").agg(F.bool_and("ok").alias("ok"))
    return per_check.agg(count_true(F.col("ok")).alias("passed"), F.count("*").alias("checks"))


#: What is done about each kind of finding.
TREATMENTS = {
    "fan-out": "sum children per parent before a join",
    "duplicate": "reduce to one row per key",
    "identity": "count persons instead of ids",
    "missing": "leave null, never impute",
    "unmapped": "give the value a label",
    "invalid": "flag the row",
    "childless": "keep the parent without child measures",
    "disagreement": "publish agreement and kappa",
    "orphan": "count, attach to nothing",
}
#: Least share of affected rows of each severity.
SEVERITIES = (("High", 0.2), ("Medium", 0.02))


class Rule(NamedTuple):
    """A known kind of problem: where it is looked for and which measured columns size it.

    ``figures`` are reported; ``affected`` out of ``total`` sets severity and impact.
    """

    id: str
    kind: str
    table: str
    figures: tuple[str, ...]
    affected: str
    total: str


def issue_register(measured: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule, worded from its kind and its measured figures; ``measured`` is one wide row."""

    def describe(rule: Rule) -> Column:
        value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
        figures = F.concat_ws(", ", *[F.concat(F.lit(c.replace("_", " ") + " "), value(c)) for c in rule.figures])
        share = F.coalesce(ratio(F.col(rule.affected), F.col(rule.total)), F.lit(0.0))
        severity = F.when(share <= 0, "Info")
        for name, least in SEVERITIES:
            severity = severity.when(share >= least, name)
        return F.struct(
            F.lit(f"{rule.table} {rule.kind}").alias("area"),
            figures.alias("issue"),
            severity.otherwise("Low").alias("severity"),
            F.lit(TREATMENTS[rule.kind]).alias("treatment"),
            F.concat(F.format_number(100 * share, 2), F.lit(f" % of {rule.total.replace('_', ' ')}")).alias("impact"),
            F.when(share > 0, "Open").otherwise("Clear").alias("status"),
        )

    rows = long_form(measured, {r.id: describe(r) for r in rules}, "id", "row")
    return rows.select("id", "row.*")


def value_text(df: DataFrame, field: str) -> Column:
    """A value as text that reads the same everywhere: decimals to six places, arrays by their size."""
    kind, value = df.schema[field].dataType.simpleString(), F.col(f"`{field}`")
    if kind.startswith("array"):
        return F.when(value.isNotNull(), F.concat(F.lit("array of "), F.size(value).cast("string")))
    if kind.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if kind in ("float", "double"):
        value = F.expr(f"try_cast(`{field}` AS decimal(38,6))")
    return value.cast("string")


def field_profile(tables: Mapping[str, DataFrame], example_chars: int = 60) -> DataFrame:
    """Rows, missing share, distinct values and an example of every field: one scan and one aggregate row a table.

    Distinct values come from mergeable sketches; ``distinct_exact`` says whether their
    number is certain. The example is the value of the least MD5, so it does not depend on
    the order of rows.
    """
    profiles = []
    for name, df in tables.items():
        cells, measures = [], [F.count("*").alias("rows")]
        for i, f in enumerate(df.columns):
            text = value_text(df, f)
            measures += [
                F.count(F.col(f"`{f}`")).alias(f"_p{i}"),
                distinct_sketch(F.col(f"`{f}`")).alias(f"_d{i}"),
                F.min_by(F.substring(text, 1, example_chars), F.md5(text)).alias(f"_e{i}"),
            ]
            cells.append(
                F.struct(
                    F.lit(f).alias("field"), F.col(f"_p{i}").alias("present"),
                    F.theta_sketch_estimate(f"_d{i}").alias("n_distinct"), F.col(f"_e{i}").alias("example"),
                )
            )
        profiles.append(df.agg(*measures).select(F.lit(name).alias("tbl"), "rows", F.inline(F.array(*cells))))
    missing = F.col("rows") - F.col("present")
    return union_all(profiles).select(
        "tbl", "field", "rows", percent(missing, F.col("rows")).alias("missing_pct"), "n_distinct",
        (F.col("n_distinct") < 2**DISTINCT_BITS).alias("distinct_exact"), "example",
    )


def data_dictionary(
    tables: Mapping[str, DataFrame], descriptions: Mapping[tuple[str, str], str], derived: Sequence[str] = ()
) -> DataFrame:
    """Table, field, type, description and origin, with what :func:`field_profile` measures.

    Fields with more distinct values than a sketch holds are counted exactly by further scans of
    those fields alone; ``distinct_exact`` still says whether the mergeable sketch would do.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, f.name, f.dataType.simpleString(), descriptions.get((name, f.name), "—"), "yes" if name in derived else "no")
        for name, df in tables.items()
        for f in df.schema.fields
    ]
    columns = ["tbl", "field", "dtype", "description", "derived"]
    fields = inline_table(spark, dict(zip(columns, (list(c) for c in zip(*rows)))))
    profile = field_profile(tables)
    found = profile.collect()  # one row a field
    wide = {name: [r.field for r in found if r.tbl == name and not r.distinct_exact] for name in tables}
    counted = [distinct_counts(tables[n], some).select(F.lit(n).alias("tbl"), "*") for n, some in wide.items() if some]
    profile = spark.createDataFrame(found, profile.schema)
    if counted:
        exact = F.coalesce("counted", "n_distinct")
        profile = profile.join(union_all(counted), ["tbl", "field"], "left").withColumn("n_distinct", exact).drop("counted")
    return fields.join(profile, ["tbl", "field"], "left")


def distinct_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, counted): exact numbers of distinct non-null values.

    Fields of one type are stacked to narrow rows, so they take one scan of their columns and
    one shuffle of their distinct values together.
    """
    kinds: dict[str, list[str]] = {}
    for f in fields:
        kinds.setdefault(df.schema[f].dataType.simpleString(), []).append(f)
    stacked = [
        df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in alike])))
        for alike in kinds.values()
    ]
    return union_all([s.where("value IS NOT NULL").distinct().groupBy("field").agg(F.count("*").alias("counted")) for s in stacked])
