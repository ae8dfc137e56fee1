"""Order grain: children at order level, derived delivery fields, people."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.classify import category_label, rfm_segment
from grainwise.functions.money import exact_total, minor_units
from grainwise.functions.temporal import elapsed_days, whole_days, year_month
from grainwise.operators.grain import LARGEST, attach, by_attribute, dedupe_dimension, dominant_attribute, to_parent_grain
from grainwise.operators.rank import bin_cuts, bin_of
from grainwise.session import cut_lineage

# Labels of the two categories that the lookup lacks.
MANUAL_CATEGORIES = {
    "pc_gamer": "gaming_pc",
    "portateis_cozinha_e_preparadores_de_alimentos": "portable_kitchen_and_food_preparers",
}

PURCHASED, DELIVERED, PROMISED = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def item_measures(revenue: Column, freight: Column, item_id: Column, seller: Column) -> dict[str, Column]:
    """``revenue`` and ``freight`` are aggregates, see :func:`exact_total`."""
    return {
        "order_product_revenue": revenue,
        "order_freight": freight,
        "n_items": F.count(item_id),
        "n_sellers": F.count_distinct(seller),
    }


def review_measures(score: Column, has_text: Column) -> dict[str, Column]:
    return {
        "review_score": F.avg(score),
        "n_reviews": F.count("*"),
        "review_has_text": F.max(has_text.cast("int")),
    }


def item_grain(items: DataFrame, key: str = "order_id") -> DataFrame:
    measures = item_measures(
        exact_total(minor_units(F.col("price"))),
        exact_total(minor_units(F.col("freight_value"))),
        F.col("order_item_id"),
        F.col("seller_id"),
    )
    return to_parent_grain(items, key, measures)


def graded_payments(payments: DataFrame, key: str, units: Column, sequence: Column, installments: Column) -> DataFrame:
    """Payments per parent with the type of the largest one.

    Rows are first summed per parent and type, which is a hash aggregate; the type is
    then chosen among the few types of a parent.
    """
    per_type = by_attribute(
        payments, key, "payment_type", units, sequence,
        {"_units": F.sum(units), "_rows": F.count("*"), "_inst": F.max(installments)},
    )
    return per_type.groupBy(key).agg(
        exact_total(F.col("_units")).alias("order_payment_total"),
        F.sum("_rows").alias("n_payments"),
        F.max("_inst").alias("n_installments"),
        F.max_by("payment_type", LARGEST).alias("main_payment_type"),
    )


def payment_grain(payments: DataFrame, key: str = "order_id") -> DataFrame:
    return graded_payments(
        payments, key, minor_units(F.col("payment_value")), F.col("payment_sequential"), F.col("payment_installments")
    )


def main_payment_type(payments: DataFrame, key: str = "order_id") -> DataFrame:
    units = minor_units(F.col("payment_value"))
    return dominant_attribute(payments, key, "payment_type", units, F.col("payment_sequential"), "main_payment_type")


def review_grain(reviews: DataFrame, key: str = "order_id") -> DataFrame:
    measures = review_measures(F.col("review_score"), F.col("review_comment_message").isNotNull())
    return to_parent_grain(reviews, key, measures)


def derive_order_fields(joined: DataFrame, delivered_status: str) -> DataFrame:
    """Flags, zero-filled item measures, delivery times and calendar fields.

    Only item measures are zero-filled; payments and scores stay null when absent.
    ``is_late`` is null for undelivered orders and for orders without a promise.
    """
    cols = set(joined.columns)
    bought, arrived, promised = F.col(PURCHASED), F.col(DELIVERED), F.col(PROMISED)
    out = {}
    if "order_product_revenue" in cols:
        out["has_items"] = F.col("order_product_revenue").isNotNull()
    if "order_payment_total" in cols:
        out["has_payment"] = F.col("order_payment_total").isNotNull()
    for name in ("order_product_revenue", "order_freight", "n_items", "n_sellers"):
        if name in cols:
            out[name] = F.coalesce(F.col(name), F.lit(0).cast(joined.schema[name].dataType))
    if "order_product_revenue" in cols:
        out["order_value"] = out["order_product_revenue"] + out["order_freight"]
    out["delivered"] = F.coalesce(F.col("order_status") == delivered_status, F.lit(False))
    out["delivery_days"] = elapsed_days(bought, arrived)
    out["est_delivery_days"] = elapsed_days(bought, promised)
    out["is_late"] = arrived > promised
    out["purchase_ym"] = year_month(bought)
    out["purchase_date"] = bought.cast("date")
    if "review_has_text" in cols:
        out["review_has_text"] = F.coalesce(F.col("review_has_text"), F.lit(0))
    return joined.withColumns(out)


CHILDREN = {"items": ("order_items", item_grain), "payments": ("order_payments", payment_grain), "reviews": ("order_reviews", review_grain)}


def _with_children(t: Mapping[str, DataFrame], children: Sequence[str]) -> DataFrame:
    """The children arrive already partitioned by order, so their joins share one exchange of the orders table."""
    joined = t["orders"]
    for table, grain in (CHILDREN[c] for c in children):
        joined = attach(joined, grain(t[table]), "order_id")
    return joined


def order_grain(t: Mapping[str, DataFrame], children: Sequence[str] = ("items",)) -> DataFrame:
    """One row per order with the named children and derived fields, without its customer.

    A report names the children it reads; the others, and the customers, are not touched.
    """
    return derive_order_fields(_with_children(t, children), "delivered")


def orders_clean(t: Mapping[str, DataFrame]) -> DataFrame:
    """One row per order with item, payment and review aggregates, customer and derived fields.

    Customers come last, where a frequent customer key may be split by the skew-join rule.
    """
    return derive_order_fields(attach(_with_children(t, tuple(CHILDREN)), t["customers"], "customer_id"), "delivered")


def geo_clean(geolocation: DataFrame) -> DataFrame:
    """One row per zip prefix: mean coordinates, most frequent city and state."""
    return dedupe_dimension(
        geolocation.withColumnRenamed("geolocation_zip_code_prefix", "zip_prefix"),
        "zip_prefix",
        {"lat": F.col("geolocation_lat"), "lng": F.col("geolocation_lng")},
        {"city": "geolocation_city", "state": "geolocation_state"},
    )


def products_clean(
    products: DataFrame, translation: DataFrame, manual: Mapping[str, str] = MANUAL_CATEGORIES
) -> DataFrame:
    """Product to English category: manual label, lookup, or ``unknown``.

    A key that the lookup repeats takes its least label, so products stay one row each.
    """
    raw = F.col("product_category_name")
    lookup = translation.groupBy("product_category_name").agg(
        F.min("product_category_name_english").alias("product_category_name_english")
    )
    return products.join(lookup, "product_category_name", "left").select(
        "product_id",
        "product_category_name",
        category_label(raw, F.col("product_category_name_english"), manual).alias("category_en"),
    )


def items_with_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Item rows with their category; items of unknown products are kept."""
    joined = attach(items, categories.select("product_id", "category_en"), "product_id")
    return joined.withColumn("category_en", F.coalesce("category_en", F.lit("unknown")))


def people(order_grain: DataFrame) -> DataFrame:
    """Person grain: last purchase, orders and value. Input has one row per order."""
    known = order_grain.filter(F.col("customer_unique_id").isNotNull())
    return known.groupBy("customer_unique_id").agg(
        F.max(PURCHASED).alias("last_purchase"),
        F.count("*").alias("frequency"),
        F.sum("order_value").alias("monetary"),
    )


def customer_rfm(order_grain: DataFrame, reference: Column, repeat_min: int = 2) -> DataFrame:
    """Recency, frequency, monetary, quintile scores and segment per person.

    ``reference`` is the instant recency counts from (the last purchase of all).
    Scores are exact quintiles of the rank by value and person id; only persons tied at
    a cut between quintiles are ranked.
    """
    # persons are read several times, so the joins behind them are evaluated once
    base = cut_lineage(
        people(order_grain)
        .select(
            "customer_unique_id",
            whole_days(F.col("last_purchase"), reference).alias("recency_days"),
            "frequency",
            "monetary",
        )
    )
    person, recency = F.col("customer_unique_id"), F.col("recency_days")
    value = minor_units(F.col("monetary"), base.schema["monetary"].dataType.scale)
    cuts = bin_cuts(base, {"recency": recency, "value": value}, "customer_unique_id")
    scored = base.withColumns({"R_score": 6 - bin_of(recency, person, cuts["recency"]), "M_score": bin_of(value, person, cuts["value"])})
    frequency = F.col("frequency")
    return scored.select(
        "customer_unique_id",
        "recency_days",
        "frequency",
        "monetary",
        "R_score",
        "M_score",
        (frequency >= repeat_min).alias("is_repeat"),
        rfm_segment(frequency, F.col("R_score"), F.col("M_score"), repeat_min).alias("segment"),
    )


def last_purchase(orders: DataFrame) -> Column:
    """Latest purchase over all orders, as a scalar subquery."""
    return orders.agg(F.max(PURCHASED)).scalar()
