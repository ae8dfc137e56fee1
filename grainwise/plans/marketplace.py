"""End to end over the nine marketplace tables: cleaned tables, outputs, files."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.functions.money import exact_total, minor_units
from grainwise.operators.grain import fan_out_by_key, fan_out_totals, reconciliation
from grainwise.plans import orders as od
from grainwise.plans import outputs as out
from grainwise.sources.io import register_views, write_csv, write_table

Tables = Mapping[str, DataFrame]

# The order table is partitioned by month, which prunes date-bounded reads.
PARTITIONING = {"orders_clean": ("purchase_ym",)}


def cleaned_tables(t: Tables) -> dict[str, DataFrame]:
    """Tables at their proper grain, before the person table that needs the order grain."""
    products = od.products_clean(t["products"], t["category_translation"])
    return {
        "orders_clean": od.orders_clean(t),
        "geo_clean": od.geo_clean(t["geolocation"]),
        "products_clean": products,
        "order_items_clean": od.items_with_category(t["order_items"], products),
    }


def valid_payments(payments: DataFrame) -> DataFrame:
    """Payments with a positive value and a defined type."""
    return payments.filter((F.col("payment_value") > 0) & (F.col("payment_type") != "not_defined"))


def fan_out(t: Tables, *, exclude_invalid: bool = False) -> DataFrame:
    """Naive and correct totals of orders x items x payments.

    All payments count as cash unless ``exclude_invalid`` is set.
    """
    paid = valid_payments(t["order_payments"]) if exclude_invalid else t["order_payments"]
    items = t["order_items"].select("order_id", minor_units(F.col("price")).alias("price_cents"))
    payments = paid.select("order_id", minor_units(F.col("payment_value")).alias("payment_cents"))
    per_key = fan_out_by_key(
        t["orders"].select("order_id"), items, payments, "order_id", "price_cents", "payment_cents"
    )
    return fan_out_totals(per_key, "order_id")


def output_tables(t: Tables, orders_clean: DataFrame, customer_rfm: DataFrame, items_clean: DataFrame) -> dict[str, DataFrame]:
    """The nine aggregates, in their published order."""
    has_text = t["order_reviews"].select(F.col("review_comment_message").isNotNull().alias("has_text"))
    category_revenue = items_clean.groupBy("category_en").agg(
        exact_total(minor_units(F.col("price"))).alias("revenue")
    )
    return {
        "kpi_summary": out.kpi_summary(orders_clean, customer_rfm, has_text),
        "monthly_trend": out.monthly_trend(orders_clean).orderBy("purchase_ym"),
        "category_revenue_pareto": out.category_pareto(category_revenue).orderBy("rank"),
        "delivery_distribution": out.delivery_distribution(orders_clean),
        "score_vs_delivery": out.score_vs_delivery(orders_clean).orderBy("score"),
        "rfm_segments": out.rfm_segments(customer_rfm).orderBy(F.desc("customers"), "segment"),
        "repeat_summary": out.repeat_summary(customer_rfm).orderBy("freq_bucket"),
        "revenue_by_state": out.revenue_by_state(orders_clean, t["customers"]).orderBy(
            F.desc("gmv"), "customer_state"
        ),
        "reconciliation": reconciliation(fan_out(t)),
    }


def register_marketplace_views(t: Tables) -> None:
    """Short view names, the category map and the order grain for ``spark.sql``."""
    register_views(
        {
            "orders": t["orders"],
            "items": t["order_items"],
            "payments": t["order_payments"],
            "reviews": t["order_reviews"],
            "products": t["products"],
            "sellers": t["sellers"],
            "customers": t["customers"],
            "geo": t["geolocation"],
            "xlate": t["category_translation"],
            "product_category": od.products_clean(t["products"], t["category_translation"]),
            "order_grain": od.orders_clean(t),
        }
    )


def build(spark: SparkSession, tables: Tables, target: str) -> dict[str, DataFrame]:
    """Write cleaned tables as Parquet and outputs as CSV; return the outputs.

    Each cleaned table is written once and read back, so the joins behind it run
    once although every output depends on them.
    """
    clean_dir, out_dir = os.path.join(target, "cleaned"), os.path.join(target, "output")

    def materialise(name: str, df: DataFrame) -> DataFrame:
        path = os.path.join(clean_dir, name)
        write_table(df, path, PARTITIONING.get(name, ()))
        return spark.read.schema(df.schema).parquet(path)

    clean = {name: materialise(name, df) for name, df in cleaned_tables(tables).items()}
    orders_clean = clean["orders_clean"]
    rfm = materialise(
        "customer_rfm", od.customer_rfm(orders_clean, od.last_purchase(orders_clean))
    )
    outputs = output_tables(tables, orders_clean, rfm, clean["order_items_clean"])
    for name, df in outputs.items():
        write_csv(df, os.path.join(out_dir, name), single_file=True)
    return outputs
