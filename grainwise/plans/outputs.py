"""Decision aggregates over the order grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.functions.classify import bucket_conditions, frequency_bucket
from grainwise.functions.stats import (
    correlation,
    count_true,
    money,
    percent,
    ratio,
)
from grainwise.functions.temporal import MICROS_PER_DAY, elapsed_micros
from grainwise.operators.frames import long_form, side_by_side, union_all
from grainwise.operators.rank import count_values, prefix_sums, quantiles, share_of_total, tied_sums
from grainwise.plans.orders import DELIVERED, PURCHASED
from grainwise.session import cut_lineage

# Row labels of the published KPI and distribution tables.
KPI_LABELS = {
    "gmv": "GMV (product revenue, BRL)",
    "net": "Net product revenue, delivered (BRL)",
    "freight": "Freight (BRL)",
    "orders": "Total orders",
    "delivered": "Delivered orders",
    "pct_delivered": "% delivered",
    "aov": "AOV net (BRL/delivered order)",
    "on_time": "On-time delivery rate (%)",
    "median": "Median delivery days",
    "p90": "P90 delivery days",
    "customers": "Unique customers (customer_unique_id)",
    "repeat": "Repeat-customer rate (%)",
    "text": "% reviews with text",
}
DELIVERY_EDGES = (0, 5, 10, 15, 20, 25, 30, 40, 60)


def delivery_micros() -> Column:
    return elapsed_micros(F.col(PURCHASED), F.col(DELIVERED))


def in_days(micros: Column) -> Column:
    return micros / F.lit(float(MICROS_PER_DAY))


def delivery_known(order_grain: DataFrame) -> DataFrame:
    return order_grain.filter(F.col(DELIVERED).isNotNull())


# --- trend ----------------------------------------------------------------


def monthly_trend(order_grain: DataFrame) -> DataFrame:
    """Orders, delivered orders and revenue per purchase month, orders with items."""
    return (
        order_grain.filter("has_items")
        .groupBy("purchase_ym")
        .agg(
            F.count("*").alias("orders"),
            count_true(F.col("delivered")).alias("delivered_orders"),
            money(F.sum("order_product_revenue")).alias("gmv"),
        )
    )


def first_largest(label: str, measure: str) -> Column:
    """Label with the largest measure; the smallest label wins a tie."""
    return F.min_by(label, F.struct((-F.col(measure)).alias("m"), F.col(label)))


def trend_peak(trend: DataFrame, min_orders: int = 50) -> DataFrame:
    """Month span and peak month; months below the support threshold cannot peak."""
    supported = F.col("orders") >= min_orders
    order = F.struct((-F.col("orders")).alias("m"), F.col("purchase_ym"))
    return trend.agg(
        F.min("purchase_ym").alias("first_month"),
        F.max("purchase_ym").alias("last_month"),
        F.count("*").alias("months"),
        count_true(supported).alias("supported_months"),
        F.min_by("purchase_ym", F.when(supported, order)).alias("peak_month"),
        F.max(F.when(supported, F.col("orders"))).alias("peak_orders"),
        first_largest("purchase_ym", "delivered_orders").alias("peak_delivered_month"),
        F.max("delivered_orders").alias("peak_delivered_orders"),
    )


# --- delivery ---------------------------------------------------------------


def _flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; for sums."""
    return F.when(condition, 1).otherwise(0).cast("bigint")


def delivery_stats(order_grain: DataFrame) -> DataFrame:
    """Median and P90 delivery time with the on-time rate, orders with a delivery date."""
    totals = {"_known": F.lit(1).cast("bigint"), "_punctual": _flag(~F.col("is_late"))}
    counts = count_values(delivery_known(order_grain), delivery_micros(), totals=totals)
    times = quantiles(counts, {"median_days": 0.5, "p90_days": 0.9})
    times = times.select(*[F.round(in_days(F.col(c)), 2).alias(c) for c in times.columns])
    punctual = counts.agg(
        percent(F.sum("_punctual"), F.sum("_known")).alias("on_time_rate_pct"),
        F.coalesce(F.sum("_known"), F.lit(0)).alias("delivered_with_dates"),
    )
    return side_by_side(times, punctual)


def delivery_distribution(
    order_grain: DataFrame, edges: Sequence[float] = DELIVERY_EDGES
) -> DataFrame:
    """Orders per delivery-time interval; empty intervals stay, negative times drop out."""
    labels = [f"{a:g}-{b:g}" for a, b in zip(edges, edges[1:])] + [f"{edges[-1]:g}+"]
    conditions = bucket_conditions(F.col("delivery_days"), edges)
    counted = order_grain.agg(*[count_true(c).alias(f"_b{i}") for i, c in enumerate(conditions)])
    total = sum((F.col(f"_b{i}") for i in range(len(labels))), F.lit(0))
    cells = {
        lab: F.struct(F.col(f"_b{i}").alias("orders"), F.round(percent(F.col(f"_b{i}"), total, None), 6).alias("pct"))
        for i, lab in enumerate(labels)
    }
    return long_form(counted, cells, "bucket", "cell").select("bucket", "cell.*")


def score_vs_delivery(order_grain: DataFrame) -> DataFrame:
    """Delivery by rounded score: half-even rounding, median, late rate among known."""
    scored = delivery_known(order_grain).filter(F.col("review_score").isNotNull())
    scored = scored.withColumn("score", F.bround("review_score", 0).cast("int"))
    late = F.col("is_late").cast("bigint")
    totals = {"_rows": F.lit(1).cast("bigint"), "_late": late, "_dated": _flag(late.isNotNull())}
    counts = count_values(scored, delivery_micros(), ["score"], totals)
    elapsed = F.sum(F.col("_v").cast("decimal(20,0)") * F.col("_n"))
    means = counts.groupBy("score").agg(
        F.round(in_days(ratio(elapsed, F.sum("_n"))), 2).alias("mean_delivery_days"),
        percent(F.sum("_late"), F.sum("_dated")).alias("late_rate"),
        F.sum("_rows").alias("n"),
    )
    # scores are whole numbers from 1 to 5, so the grouped quantiles stay a handful
    medians = quantiles(counts, {"_median": 0.5}, ["score"], groups_bounded=True)
    return means.join(medians, "score", "left").select(
        "score",
        "mean_delivery_days",
        F.round(in_days(F.col("_median")), 2).alias("median_delivery_days"),
        "late_rate",
        "n",
    )


def score_vs_delivery_sql(order_grain: DataFrame) -> DataFrame:
    """Same relation with half-up rounding; an unknown lateness counts as not late."""
    scored = order_grain.filter(F.col("delivery_days").isNotNull() & F.col("review_score").isNotNull())
    late = F.coalesce(F.col("is_late"), F.lit(False))
    return scored.groupBy(F.round("review_score", 0).alias("score")).agg(
        F.round(F.avg("delivery_days"), 2).alias("avg_delivery_days"),
        F.round(100.0 * F.avg(late.cast("int")), 2).alias("late_rate_pct"),
        F.count("*").alias("n"),
    )


def corr_delivery_score(order_grain: DataFrame) -> DataFrame:
    """Pearson r of delivery time and mean score over orders."""
    both = F.col("delivery_days").isNotNull() & F.col("review_score").isNotNull()
    return order_grain.filter(both).agg(
        F.round(F.corr("delivery_days", "review_score"), 4).alias("r"), F.count("*").alias("n")
    )


def corr_at_child_grain(parents: DataFrame, x: str, children: str, total: str, spread: str) -> DataFrame:
    """Pearson r of a parent value against a child value, counted once per child row.

    ``children``, ``total`` and ``spread`` are the per-parent count, sum and sum of squared
    deviations from the parent's own mean of the child value, so child rows need not be
    joined back to parents. Parents are first folded by their number of children with the
    engine's centred moments (mean, second moment, co-moment, which merge pairwise); those
    few rows are then combined around the mean of all. No power sum is formed, so a large
    common offset costs no digits.
    """
    n, x = F.col(children).cast("double"), F.col(x).cast("double")
    y = F.col(total).cast("double") / n
    weight = F.col("_w") * F.col("_parents")
    moments = (
        parents.filter(x.isNotNull() & (F.col(children) > 0))
        .groupBy(F.col(children).cast("double").alias("_w"))
        .agg(
            F.count("*").cast("double").alias("_parents"), F.avg(x).alias("_ax"), F.avg(y).alias("_ay"),
            F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_vxy"), F.sum(spread).alias("_inside"),
            F.min(x).alias("_lx"), F.max(x).alias("_hx"),
        )
    )
    every = Window.partitionBy()  # one row for each number of children
    whole = F.sum(weight).over(every)
    dx = F.col("_ax") - F.sum(weight * F.col("_ax")).over(every) / whole
    dy = F.col("_ay") - F.sum(weight * F.col("_ay")).over(every) / whole
    combined = moments.select(
        weight.alias("_n"), "_lx", "_hx",
        (weight * (F.col("_vx") + dx * dx)).alias("_mxx"),
        (F.col("_inside") + weight * (F.col("_vy") + dy * dy)).alias("_myy"),
        (weight * (F.col("_vxy") + dx * dy)).alias("_mxy"),
    )
    r = correlation(F.sum("_mxx"), F.sum("_myy"), F.sum("_mxy"))
    # rounding may leave a constant value a variance, so constancy is read off its range
    varied = F.min("_lx") < F.max("_hx")
    return combined.agg(F.round(F.when(varied, r), 4).alias("r"), F.sum("_n").cast("bigint").alias("n"))


def score_by_status(per_parent: DataFrame, status: str, delivered_status: str, total: str, count: str) -> DataFrame:
    """Mean score of all, delivered and other reviews, from per-order sums.

    Reviews whose order is unknown belong to the others.
    """
    delivered = F.col(status).eqNullSafe(delivered_status)
    mean = lambda cond: F.round(
        ratio(F.sum(F.when(cond, F.col(total))), F.sum(F.when(cond, F.col(count)))), 4
    )
    return per_parent.agg(
        mean(F.lit(True)).alias("mean_all"),
        mean(delivered).alias("mean_delivered"),
        mean(~delivered).alias("mean_not_delivered"),
    )


# --- concentration ------------------------------------------------------------


def revenue_by_category(items: DataFrame, categories: DataFrame, revenue: Column, how: str) -> DataFrame:
    """Revenue per category. ``revenue`` is an aggregate; it is taken per product first,
    so the lookup join sees one row per product."""
    per_product = items.groupBy("product_id").agg(revenue.alias("_revenue"))
    joined = per_product.join(categories.select("product_id", "category_en"), "product_id", how)
    return joined.groupBy(F.coalesce("category_en", F.lit("unknown")).alias("category_en")).agg(
        F.sum("_revenue").alias("revenue")
    )


def _placed(revenue: DataFrame) -> DataFrame:
    """Categories by falling revenue with position, running revenue and total, for any number of them."""
    return prefix_sums(revenue, [F.desc("revenue"), F.asc("category_en")], {"_cum": "revenue"})


def category_pareto(revenue: DataFrame) -> DataFrame:
    """All categories: share of the rounded revenue, running share by row, rank."""
    placed = _placed(revenue.withColumn("revenue", F.round("revenue", 2)))
    return placed.select(
        "category_en",
        F.col("revenue").cast("double").alias("revenue"),
        F.round(percent(F.col("revenue"), F.col("_cum_total"), None), 6).alias("pct"),
        F.round(percent(F.col("_cum"), F.col("_cum_total"), None), 6).alias("cum_pct"),
        F.col("_at").cast("int").alias("rank"),
    )


def _tied_share(placed: DataFrame) -> DataFrame:
    """Running share where equal revenues share one value (RANGE frame), one row for each revenue."""
    tied = tied_sums(placed, "revenue", "_cum")
    return tied.select("revenue", "n", percent(F.col("_cum"), F.col("_cum_total"), None).alias("_share"))


def category_pareto_top(revenue: DataFrame, k: int = 15) -> DataFrame:
    """Leading categories with shares of the unrounded revenue."""
    placed = _placed(revenue)
    tied = _tied_share(placed).withColumnsRenamed({"revenue": "_value", "_share": "_tied"}).drop("n")
    return (
        placed.where(F.col("_at") <= k)
        .join(tied, F.col("revenue").eqNullSafe(F.col("_value")))
        .select(
            "category_en",
            money(F.col("revenue")).alias("revenue"),
            F.round(percent(F.col("revenue"), F.col("_cum_total"), None), 2).alias("pct"),
            F.round("_tied", 2).alias("cum_pct"),
            F.col("_at").cast("int").alias("rank"),
        )
        .orderBy("rank")
    )


def pareto_threshold(revenue: DataFrame, pct: float = 80.0) -> DataFrame:
    """Number of leading categories needed to reach a share of revenue."""
    within = F.sum(F.when(F.col("_share") <= pct, F.col("n")))
    return _tied_share(_placed(revenue)).agg(
        (F.coalesce(within, F.lit(0)) + 1).alias("categories_for_80pct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_categories"),
    )


def _revenue_per_customer(order_grain: DataFrame) -> DataFrame:
    return (
        order_grain.filter("has_items")
        .groupBy("customer_id")
        .agg(F.sum("order_product_revenue").alias("_rev"), F.count("*").alias("_orders"))
    )


def revenue_by_state(order_grain: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue, orders and people per state with the share of revenue.

    Orders are summed per customer before the customer table is joined, and people
    are counted from (state, person) groups, so no step depends on one hot key.
    """
    return _by_state(_revenue_per_customer(order_grain), customers)


def _by_state(per_customer: DataFrame, customers: DataFrame) -> DataFrame:
    where = customers.select("customer_id", "customer_unique_id", "customer_state")
    per_person = (
        per_customer.join(where, "customer_id")
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state", "customer_unique_id")
        .agg(F.sum("_rev").alias("_rev"), F.sum("_orders").alias("_orders"))
    )
    per_state = per_person.groupBy("customer_state").agg(
        F.round(F.sum("_rev"), 2).alias("gmv"),
        F.sum("_orders").alias("orders"),
        F.count("customer_unique_id").alias("customers"),
    )
    return per_state.select(
        "customer_state",
        F.col("gmv").cast("double").alias("gmv"),
        "orders",
        "customers",
        share_of_total(F.col("gmv")).alias("pct_gmv"),
    )


def report_figures(order_grain: DataFrame, customers: DataFrame, revenue: DataFrame, labels: DataFrame) -> DataFrame:
    """Leading states, peak month, 80 percent categories and the number of negative labels.

    The order grain is evaluated once: states and months both come from its sums by
    customer and month.
    """
    base = cut_lineage(
        order_grain.filter("has_items")
        .groupBy("customer_id", "purchase_ym")
        .agg(F.sum("order_product_revenue").alias("_rev"), F.count("*").alias("_orders"))
    )
    per_customer = base.groupBy("customer_id").agg(F.sum("_rev").alias("_rev"), F.sum("_orders").alias("_orders"))
    trend = base.groupBy("purchase_ym").agg(F.sum("_orders").alias("orders"))
    negatives = labels.agg(count_true(F.col("sentiment") == "negative").alias("negative_reviews"))
    return side_by_side(concentration(_by_state(per_customer, customers), trend, revenue), negatives)


def concentration(states: DataFrame, trend: DataFrame, revenue: DataFrame, top: int = 3) -> DataFrame:
    """Share of the leading states, the peak month and the 80 percent category count."""
    leaders = states.orderBy(F.desc("gmv"), "customer_state").limit(top)
    return side_by_side(
        leaders.agg(
            F.round(F.sum("pct_gmv"), 2).alias("top_states_pct"),
            first_largest("customer_state", "gmv").alias("top_state"),
        ),
        trend.agg(first_largest("purchase_ym", "orders").alias("peak_month"), F.max("orders").alias("peak_orders")),
        pareto_threshold(revenue),
    )


# --- people ---------------------------------------------------------------------


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """Customers, mean value, frequency and recency per segment."""
    grouped = rfm.groupBy("segment").agg(
        F.count("*").alias("customers"),
        F.round(F.avg(F.col("monetary").cast("double")), 2).alias("avg_monetary"),
        F.round(F.avg("frequency"), 3).alias("avg_frequency"),
        F.round(F.avg("recency_days"), 1).alias("avg_recency"),
    )
    return grouped.withColumn("pct_customers", share_of_total(F.col("customers")))


def repeat_summary(per_person: DataFrame) -> DataFrame:
    """Customers and revenue of people with one, two and more orders."""
    grouped = per_person.groupBy(frequency_bucket(F.col("frequency")).alias("freq_bucket")).agg(
        F.count("*").alias("customers"), F.sum("monetary").alias("_revenue")
    )
    return grouped.select(
        "freq_bucket",
        "customers",
        money(F.col("_revenue")).alias("revenue"),
        share_of_total(F.col("customers")).alias("pct_customers"),
        share_of_total(F.col("_revenue")).alias("pct_revenue"),
    )


def payment_mix(payments: DataFrame, total: Column) -> DataFrame:
    """Rows, share, mean installments and value per payment type."""
    grouped = payments.groupBy("payment_type").agg(
        F.count("*").alias("payment_rows"),
        F.round(F.avg("payment_installments"), 2).alias("avg_installments"),
        money(total).alias("total_value"),
    )
    return grouped.withColumn("pct_rows", share_of_total(F.col("payment_rows")))


# --- headline -----------------------------------------------------------------------


def _headline(order_grain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counted delivery times and, from the same pass, the order-level headline row."""
    revenue, delivered = F.col("order_product_revenue"), F.col("delivered")
    known = F.col(DELIVERED).isNotNull()
    totals = {
        "_gmv": F.when(F.col("has_items"), revenue),
        "_net": F.when(delivered, revenue),
        "_freight": F.when(F.col("has_items"), F.col("order_freight")),
        "_orders": F.lit(1).cast("bigint"),
        "_delivered": _flag(delivered),
        "_known": _flag(known),
        "_punctual": _flag(known & ~F.col("is_late")),
    }
    counts = count_values(order_grain, delivery_micros(), totals=totals)
    sums = counts.agg(*[F.sum(c).alias(c) for c in totals])
    row = sums.select(
        money(F.col("_gmv")).alias("gmv"),
        money(F.col("_net")).alias("net"),
        money(F.col("_freight")).alias("freight"),
        F.coalesce("_orders", F.lit(0)).alias("orders"),
        F.coalesce("_delivered", F.lit(0)).alias("delivered"),
        percent(F.col("_delivered"), F.col("_orders")).alias("pct_delivered"),
        F.round(ratio(F.col("_net"), F.col("_delivered")), 2).alias("aov"),
        percent(F.col("_punctual"), F.col("_known")).alias("on_time"),
    )
    return counts, row


def kpi_summary(order_grain: DataFrame, per_person: DataFrame, reviews_text: DataFrame, repeat_min: int = 2) -> DataFrame:
    """Thirteen headline figures in long form.

    ``per_person`` needs a ``frequency`` column; ``reviews_text`` a boolean ``has_text``.
    """
    counts, head = _headline(order_grain)
    times = quantiles(counts, {"median": 0.5, "p90": 0.9})
    persons = per_person.agg(
        F.count("*").alias("customers"),
        percent(count_true(F.col("frequency") >= repeat_min), F.count("*")).alias("repeat"),
    )
    text = reviews_text.agg(percent(count_true(F.col("has_text")), F.count("*")).alias("text"))
    as_rows = lambda frame, make: long_form(
        frame, {KPI_LABELS[c]: make(F.col(c)).cast("double") for c in frame.columns}, "kpi", "value"
    )
    same = lambda c: c
    return union_all(
        [
            as_rows(head, same),
            as_rows(times, lambda c: F.round(in_days(c), 2)),
            as_rows(persons, same),
            as_rows(text, same),
        ]
    )


def dashboard_kpi(order_grain: DataFrame, sold: DataFrame, customers: DataFrame) -> DataFrame:
    """Ten headline figures in one row.

    ``sold`` is one row with ``gmv`` and ``freight`` over all item rows.
    """
    sold = sold.select(money(F.col("gmv")).alias("gmv"), money(F.col("freight")).alias("freight"))
    counts, head = _headline(order_grain)
    head = head.select(
        F.col("net").alias("net_revenue_delivered"),
        F.col("orders").alias("total_orders"),
        F.col("delivered").alias("delivered_orders"),
        "pct_delivered",
        F.col("aov").alias("aov_net"),
        F.col("on_time").alias("on_time_rate"),
    )
    median = quantiles(counts, {"m": 0.5}).select(F.round(in_days(F.col("m")), 2).alias("median_delivery_days"))
    persons = customers.agg(F.count_distinct("customer_unique_id").alias("unique_customers"))
    return side_by_side(sold, head, median, persons)


def value_against_paid(per_key: DataFrame, value: str, paid: str) -> DataFrame:
    """Pearson r of the order value and the amount paid, keys that have both."""
    both = F.col(value).isNotNull() & F.col(paid).isNotNull()
    return per_key.filter(both).agg(
        F.round(F.corr(F.col(value).cast("double"), F.col(paid).cast("double")), 4).alias("r_value_vs_payment"),
        F.count("*").alias("n_orders"),
    )


def text_coverage(reviews: DataFrame, message: str, title: str) -> DataFrame:
    """How many reviews carry a message and a title."""
    return reviews.agg(
        F.count("*").alias("reviews"),
        count_true(F.col(message).isNull()).alias("missing_message"),
        count_true(F.col(title).isNull()).alias("missing_title"),
        F.count(message).alias("with_text"),
        percent(F.count(message), F.count("*")).alias("pct_with_text"),
    )


