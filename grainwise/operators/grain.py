"""Grain repair: bring child rows to their parent's grain before any join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.money import in_units
from grainwise.functions.stats import count_true, money, percent, ratio
from grainwise.operators.frames import long_form, union_all


def to_parent_grain(child: DataFrame, key: str, measures: Mapping[str, Column]) -> DataFrame:
    """One row per parent key.

    The partial aggregate runs before the shuffle, so a parent that owns a large
    part of the child table still reaches the exchange as one row per task.
    """
    return child.groupBy(key).agg(*[m.alias(name) for name, m in measures.items()])


def attach(parent: DataFrame, child_at_grain: DataFrame, key: str) -> DataFrame:
    """Left join of a child already at the parent's grain: never changes the row count."""
    return parent.join(child_at_grain, key, "left")


LARGEST = "_largest"


def by_attribute(
    child: DataFrame, key: str, attribute: str, units: Column, sequence: Column, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per key and attribute with its largest (units, sequence) as one decimal.

    The decimal has a fixed place in the aggregation buffer, so the raw rows meet a
    hash aggregate; a struct or string buffer would have them sorted first.
    ``sequence`` is not negative.
    """
    packed = units.cast("decimal(19,0)") * F.lit(Decimal(10**18)) + sequence.cast("decimal(18,0)")
    return child.groupBy(key, attribute).agg(
        F.max(packed.cast("decimal(38,0)")).alias(LARGEST), *[m.alias(n) for n, m in (measures or {}).items()]
    )


def dominant_attribute(child: DataFrame, key: str, attribute: str, units: Column, sequence: Column, name: str) -> DataFrame:
    """Attribute of the row with the largest (units, sequence); only (key, attribute) rows are sorted."""
    return by_attribute(child, key, attribute, units, sequence).groupBy(key).agg(F.max_by(attribute, LARGEST).alias(name))


def dedupe_dimension(
    rows: DataFrame, key: str, means: Mapping[str, Column], modes: Mapping[str, str]
) -> DataFrame:
    """One row per key: mean of the numeric columns, most frequent value of the others.

    A tied mode goes to the greater value. Every input row is turned into one cell
    per modal column before the partial aggregate; the first cell also carries the
    sums for the means. That gives one scan and two shuffles of pre-aggregated
    rows for any number of columns, where a join per column would rescan the table.
    """
    if not modes:
        return rows.groupBy(key).agg(*[F.avg(m).alias(n) for n, m in means.items()])
    sums = {f"_{n}_sum": m for n, m in means.items()}
    first = next(iter(modes))
    cells = F.array(
        *[
            F.struct(
                F.lit(out).alias("_attr"),
                F.col(src).cast("string").alias("_val"),
                *[(m if out == first else F.lit(None)).alias(s) for s, m in sums.items()],
            )
            for out, src in modes.items()
        ]
    )
    counted = (
        rows.select(key, F.inline(cells))
        .groupBy(key, "_attr", "_val")
        .agg(
            F.count("*").alias("_n"),
            *[F.sum(s).alias(s) for s in sums],
            *[F.count(s).alias(f"{s}_n") for s in sums],
        )
    )
    candidate = {
        out: F.when((F.col("_attr") == out) & F.col("_val").isNotNull(), F.struct("_n", "_val"))
        for out in modes
    }
    return counted.groupBy(key).agg(
        *[
            ratio(F.sum(f"_{n}_sum"), F.sum(f"_{n}_sum_n")).alias(n)
            for n in means
        ],
        *[F.max(c)["_val"].alias(out) for out, c in candidate.items()],
    )


def cogroup_counts(
    key: str, sources: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], largest: Sequence[str] = ()
) -> DataFrame:
    """Aggregates of several tables side by side, one row per key seen in any of them.

    The tables are unioned on the key and summed, so there is a single shuffle of
    partially aggregated rows and no join: a key with a third of all rows costs one
    row per task, and one to-many combinations are never produced. For each source
    the result has ``n_<source>`` (0 when absent) and one column per measure, the sum
    or, if named in ``largest``, the largest value.
    """
    parts = []
    for name, (df, measures) in sources.items():
        parts.append(
            df.select(
                F.col(key),
                F.lit(1).cast("bigint").alias(f"n_{name}"),
                *[m.alias(out) for out, m in measures.items()],
            )
        )
    measures = [out for _, ms in sources.values() for out in ms]
    return (
        union_all(parts)
        .groupBy(key)
        .agg(
            *[F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name in sources],
            *[(F.max if m in largest else F.sum)(m).alias(m) for m in measures],
        )
    )


def fan_out_by_key(
    parents: DataFrame, items: DataFrame, payments: DataFrame, key: str, price_units: str, paid_units: str
) -> DataFrame:
    """What ``parents x items x payments`` would produce per key, without producing it.

    Joining on the key repeats each price once per payment row and each payment
    once per item row, so the totals follow from the per-key counts and sums.
    """
    per_key = cogroup_counts(
        key,
        {
            "parents": (parents, {}),
            "items": (items, {"revenue": F.col(price_units)}),
            "payments": (payments, {"cash": F.col(paid_units)}),
        },
    )
    return per_key.withColumns({c: in_units(F.col(c)) for c in ("revenue", "cash")})


def _naive() -> dict[str, Column]:
    """Naive rows and totals of one key. A hot key times a hot key exceeds BIGINT, so
    the products are decimals."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    n_p, n_i, n_y = wide("n_parents"), wide("n_items"), wide("n_payments")
    return {
        "naive_rows": (n_p * n_i * n_y).cast("decimal(38,0)"),
        "naive_revenue": F.col("revenue") * (n_p * n_y).cast("decimal(38,0)"),
        "naive_cash": F.col("cash") * (n_p * n_i).cast("decimal(38,0)"),
    }


def fan_out_contribution(per_key: DataFrame, key: str) -> DataFrame:
    """Naive rows and totals of every key the naive join would keep."""
    naive = _naive()
    matched = (F.col("n_parents") > 0) & (F.col("n_items") > 0) & (F.col("n_payments") > 0)
    return per_key.filter(matched & F.col(key).isNotNull()).select(
        key,
        "n_items",
        "n_payments",
        naive["naive_rows"].alias("naive_rows"),
        money(naive["naive_revenue"]).alias("naive_revenue"),
        money(naive["naive_cash"]).alias("naive_cash"),
    )


def fan_out_totals(per_key: DataFrame, key: str) -> DataFrame:
    """Naive and grain-correct totals in one aggregate row."""
    naive = _naive()
    matched = (
        (F.col("n_parents") > 0)
        & (F.col("n_items") > 0)
        & (F.col("n_payments") > 0)
        & F.col(key).isNotNull()
    )
    with_items = (F.col("n_parents") > 0) & (F.col("n_items") > 0) & F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum(F.when(matched, naive["naive_rows"])), F.lit(0)).cast("decimal(38,0)").alias("naive_rows"),
        F.sum(F.when(matched, naive["naive_revenue"])).alias("naive_revenue"),
        F.sum(F.when(matched, naive["naive_cash"])).alias("naive_cash"),
        count_true(matched).alias("naive_orders"),
        F.coalesce(F.sum(F.when(with_items, F.col("n_parents"))), F.lit(0)).alias("ready_rows"),
        F.sum(F.when(with_items, F.col("n_parents").cast("decimal(20,0)") * F.col("revenue"))).alias("ready_revenue"),
        F.sum("revenue").alias("all_revenue"),
        F.sum("cash").alias("ready_cash"),
        count_true(with_items).alias("ready_orders"),
    )


def fan_out_naive(totals: DataFrame) -> DataFrame:
    """The misleading totals as the naive join would report them."""
    return totals.select(
        "naive_rows",
        money(F.col("naive_revenue")).alias("naive_revenue"),
        money(F.col("naive_cash")).alias("naive_cash"),
        "naive_orders",
        F.round(ratio(F.col("naive_revenue"), F.col("naive_orders")), 2).alias("naive_aov"),
    )


def fan_out_sql_report(totals: DataFrame) -> DataFrame:
    """Raw versus decision-ready in one row, over all item and payment rows."""
    return totals.select(
        money(F.col("naive_revenue")).alias("naive_product_revenue"),
        money(F.col("all_revenue")).alias("decision_ready_gmv"),
        percent(F.col("naive_revenue") - F.col("all_revenue"), F.col("all_revenue")).alias(
            "revenue_inflation_pct"
        ),
        money(F.col("naive_cash")).alias("naive_cash"),
        money(F.col("ready_cash")).alias("decision_ready_cash"),
    )


# Metric names of the published reconciliation table.
RECONCILIATION_METRICS = {
    "rows": "Join rows used for revenue",
    "revenue": "Product revenue (sum price, BRL)",
    "cash": "Cash collected (sum payment_value, BRL)",
    "aov": "AOV (BRL per order)",
}


def _factors() -> dict[str, Column]:
    """What multiplied each figure, as measured: the naive total over the ready one."""

    def times(naive: str, ready: str, what: str) -> Column:
        factor = F.round(ratio(F.col(naive), F.col(ready)), 4).cast("decimal(20,4)").cast("string")
        return F.concat(F.coalesce(factor, F.lit("no")), F.lit(f" {what}"))

    revenue = times("naive_revenue", "ready_revenue", "payment rows a unit of revenue")
    return {
        "rows": times("naive_rows", "ready_rows", "joined rows a parent"),
        "revenue": revenue,
        "cash": times("naive_cash", "ready_cash", "item rows a unit of cash"),
        "aov": F.concat_ws(", ", revenue, times("naive_orders", "ready_orders", "of the parents")),
    }


def reconciliation(totals: DataFrame) -> DataFrame:
    """Naive against decision-ready, one row per metric, with the inflation in percent and the measured factor behind it."""
    pairs = {
        "rows": (F.col("naive_rows").cast("double"), F.col("ready_rows").cast("double")),
        "revenue": (money(F.col("naive_revenue")), money(F.col("ready_revenue"))),
        "cash": (money(F.col("naive_cash")), money(F.col("ready_cash"))),
        "aov": (
            F.round(ratio(F.col("naive_revenue"), F.col("naive_orders")), 2),
            F.round(ratio(F.col("ready_revenue"), F.col("ready_orders")), 2),
        ),
    }
    why = _factors()
    cells = {
        RECONCILIATION_METRICS[m]: F.struct(
            a.alias("naive_raw"), b.alias("decision_ready"), why[m].alias("why")
        )
        for m, (a, b) in pairs.items()
    }
    return (
        long_form(totals, cells, "metric", "pair")
        .select("metric", "pair.naive_raw", "pair.decision_ready", "pair.why")
        .withColumn(
            "inflation_pct",
            percent(F.col("naive_raw") - F.col("decision_ready"), F.col("decision_ready")),
        )
    )
