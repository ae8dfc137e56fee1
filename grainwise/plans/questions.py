"""The labelled profile, business and dashboard questions over the marketplace tables.

Each entry is a function of the tables, so nothing runs until its result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.money import minor_units
from grainwise.operators import quality
from grainwise.operators.frames import side_by_side
from grainwise.operators.grain import attach, cogroup_counts, fan_out_sql_report
from grainwise.operators.rank import top_k
from grainwise.plans import orders as od
from grainwise.plans import outputs as out
from grainwise.plans.marketplace import fan_out

Tables = Mapping[str, DataFrame]
QUESTIONS: dict[str, Callable[[Tables], DataFrame]] = {}


def question(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUESTIONS[fn.__name__] = fn
    return fn


# --- profile -----------------------------------------------------------------


@question
def row_counts(t: Tables) -> DataFrame:
    return quality.row_counts(t).select("tbl", "rows").orderBy("tbl")


@question
def missing_timestamps(t: Tables) -> DataFrame:
    return quality.conditional_counts(
        t["orders"],
        {
            "missing_approved": F.col("order_approved_at").isNull(),
            "missing_carrier": F.col("order_delivered_carrier_date").isNull(),
            "missing_delivered": F.col("order_delivered_customer_date").isNull(),
        },
    )


@question
def text_coverage(t: Tables) -> DataFrame:
    return out.text_coverage(t["order_reviews"], "review_comment_message", "review_comment_title")


@question
def missing_category(t: Tables) -> DataFrame:
    return t["products"].agg(
        F.count_if(F.col("product_category_name").isNull()).alias("products_missing_category"),
        F.count("*").alias("total_products"),
    )


@question
def unmapped_categories(t: Tables) -> DataFrame:
    name = "product_category_name"
    return quality.unmapped_values(t["products"], name, t["category_translation"], name).orderBy(name)


@question
def geo_duplication(t: Tables) -> DataFrame:
    counted = quality.duplication(t["geolocation"], "geolocation_zip_code_prefix")
    return counted.toDF("geo_rows", "unique_prefixes", "rows_per_prefix")


@question
def multi_item_orders(t: Tables) -> DataFrame:
    found = quality.children_profile({"items": (t["order_items"], "order_id")}).drop("child")
    return found.toDF("multi_item_orders", "max_items")


@question
def multi_payment_orders(t: Tables) -> DataFrame:
    found = quality.children_profile({"payments": (t["order_payments"], "order_id")}).drop("child")
    return found.toDF("multi_payment_orders", "max_payments")


@question
def identity_collapse(t: Tables) -> DataFrame:
    return t["customers"].agg(
        F.count_distinct("customer_id").alias("customer_ids"),
        F.count_distinct("customer_unique_id").alias("unique_customers"),
    )


@question
def repeat_rate(t: Tables) -> DataFrame:
    owners = t["customers"].select("customer_id", "customer_unique_id")
    per_id = t["orders"].groupBy("customer_id").agg(F.count("*").alias("n"))
    per_person = per_id.join(owners, "customer_id").groupBy("customer_unique_id").agg(F.sum("n").alias("orders"))
    return quality.repeat_rate(per_person, "orders")


@question
def invalid_payments(t: Tables) -> DataFrame:
    return quality.conditional_counts(
        t["order_payments"],
        {
            "nonpositive_value": F.col("payment_value") <= 0,
            "not_defined_type": F.col("payment_type") == "not_defined",
        },
    )


RELATIONS = [
    ("orders", "order_items", "order_id", "items_orphan_orders", "orders_without_items"),
    ("orders", "order_payments", "order_id", "payments_orphan_orders", "orders_without_payments"),
    ("orders", "order_reviews", "order_id", "reviews_orphan_orders", "orders_without_reviews"),
    ("products", "order_items", "product_id", "items_orphan_products", "products_without_items"),
]


def _coverage(t: Tables, relations: Sequence[tuple[str, ...]] = RELATIONS) -> DataFrame:
    return side_by_side(
        *[quality.key_coverage(t[p], key, t[c], key, orphans, childless) for p, c, key, orphans, childless in relations]
    )


@question
def referential_integrity(t: Tables) -> DataFrame:
    return _coverage(t).select(
        "items_orphan_orders", "payments_orphan_orders", "reviews_orphan_orders", "items_orphan_products"
    )


@question
def childless_orders(t: Tables) -> DataFrame:
    return _coverage(t, RELATIONS[:2]).select("orders_without_items", "orders_without_payments")


@question
def value_vs_payment(t: Tables) -> DataFrame:
    value = minor_units(F.col("price")) + minor_units(F.col("freight_value"))
    sources = {
        "items": (t["order_items"], {"value": value}),
        "payments": (t["order_payments"], {"paid": minor_units(F.col("payment_value"))}),
    }
    return out.value_against_paid(cogroup_counts("order_id", sources), "value", "paid")


@question
def status_mix(t: Tables) -> DataFrame:
    return quality.value_mix(t["orders"], "order_status", "orders").orderBy(F.desc("orders"), "order_status")


# --- business ------------------------------------------------------------------


@question
def monthly_orders(t: Tables) -> DataFrame:
    return out.monthly_trend(od.order_grain(t)).orderBy("purchase_ym")


def _category_revenue(t: Tables) -> DataFrame:
    """Revenue of items whose product is known."""
    categories = od.products_clean(t["products"], t["category_translation"])
    return out.revenue_by_category(t["order_items"], categories, F.sum("price"), "inner")


@question
def category_pareto(t: Tables) -> DataFrame:
    return out.category_pareto_top(_category_revenue(t), 15)


@question
def categories_for_80pct(t: Tables) -> DataFrame:
    return out.pareto_threshold(_category_revenue(t))


@question
def delivery_stats(t: Tables) -> DataFrame:
    return out.delivery_stats(od.order_grain(t, ()))


@question
def score_vs_delivery(t: Tables) -> DataFrame:
    return out.score_vs_delivery_sql(od.order_grain(t, ("reviews",))).orderBy("score")


@question
def delivery_score_correlation(t: Tables) -> DataFrame:
    return out.corr_delivery_score(od.order_grain(t, ("reviews",)))


@question
def repeat_behaviour(t: Tables) -> DataFrame:
    owned = attach(od.order_grain(t), t["customers"], "customer_id")
    summary = out.repeat_summary(od.people(owned))
    return summary.select(
        F.col("freq_bucket").alias("orders_bucket"), "customers", "pct_customers", "pct_revenue"
    ).orderBy("orders_bucket")


def _states(t: Tables) -> DataFrame:
    states = out.revenue_by_state(od.order_grain(t), t["customers"])
    return states.select("customer_state", "gmv", "pct_gmv", "orders")


@question
def state_concentration(t: Tables) -> DataFrame:
    return top_k(_states(t), "gmv", "customer_state", 10)


@question
def payment_mix(t: Tables) -> DataFrame:
    mix = out.payment_mix(t["order_payments"], F.sum("payment_value"))
    return mix.orderBy(F.desc("total_value"), "payment_type")


@question
def raw_vs_ready(t: Tables) -> DataFrame:
    return fan_out_sql_report(fan_out(t))


# --- dashboard --------------------------------------------------------------------


@question
def dashboard_kpi(t: Tables) -> DataFrame:
    sold = t["order_items"].agg(F.sum("price").alias("gmv"), F.sum("freight_value").alias("freight"))
    return out.dashboard_kpi(od.order_grain(t), sold, t["customers"])


@question
def dashboard_monthly_trend(t: Tables) -> DataFrame:
    return monthly_orders(t)


@question
def dashboard_revenue_by_state(t: Tables) -> DataFrame:
    return top_k(_states(t), "gmv", "customer_state", 8)


@question
def dashboard_score_vs_delivery(t: Tables) -> DataFrame:
    return score_vs_delivery(t).drop("late_rate_pct")
