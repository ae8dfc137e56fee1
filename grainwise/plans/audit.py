"""Raw audit of the marketplace tables: measured metrics, expectations, issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.money import in_units, minor_units
from grainwise.functions.stats import count_true, percent
from grainwise.operators import quality
from grainwise.operators.frames import long_form, side_by_side
from grainwise.operators.grain import cogroup_counts
from grainwise.operators.quality import Expectation, Rule
from grainwise.operators.rank import exact_quantiles
from grainwise.plans import outputs as out
from grainwise.plans.orders import DELIVERED, PURCHASED
from grainwise.session import cut_lineage

Tables = Mapping[str, DataFrame]

# Expected shape and figures of the published data set.
SHAPES = {
    "orders": (99441, 8),
    "order_items": (112650, 7),
    "order_payments": (103886, 5),
    "order_reviews": (99224, 7),
    "products": (32951, 9),
    "sellers": (3095, 4),
    "customers": (99441, 5),
    "geolocation": (1000163, 5),
    "category_translation": (71, 2),
}
ANY = float("inf")
EXPECTED = [
    *[Expectation(f"shape {t}", f"rows_{t}", rows) for t, (rows, _) in SHAPES.items()],
    *[Expectation(f"shape {t}", f"cols_{t}", cols) for t, (_, cols) in SHAPES.items()],
    Expectation("r(order_value, payment_value)", "r_value_vs_payment", 1.0, 0.01),
    Expectation("r(delivery_days, review_score)", "r_delivery_vs_score", -0.334, 0.03),
    Expectation("median delivery_days", "median_delivery_days", 10.2, 0.5),
    Expectation("mean review_score (delivered)", "mean_delivered", 4.16, 0.05),
    Expectation("GMV (sum items.price)", "gmv", 13_590_000, 200_000),
    Expectation("freight (sum freight_value)", "freight", 2_250_000, 100_000),
    Expectation("orders", "n_orders", 99441),
    Expectation("monthly span", "first_month", 201609, ANY),
    Expectation("monthly span", "last_month", 201808, ANY),
    Expectation("peak month", "peak_month", 201711),
    Expectation("orders w/ multiple items", "multi_items", 9803),
    Expectation("orders w/ multiple payments", "multi_payments", 2961),
    Expectation("geo rows", "geo_rows", 1000163),
    Expectation("geo unique prefixes", "geo_prefixes", 19015, 49),
    Expectation("customer_id count", "customer_ids", 99441),
    Expectation("customer_unique_id count", "unique_customers", 96096),
    Expectation("repeat rate", "repeat_rate_pct", 3.12, 0.2),
    Expectation("reviews missing message", "missing_message", 58247, ANY),
    Expectation("reviews with text", "with_text", 40977, 49),
    Expectation("missing delivered_customer", "missing_delivered", 2965),
    Expectation("missing carrier date", "missing_carrier", 1783),
    Expectation("missing approved_at", "missing_approved", 160),
    Expectation("products missing category", "missing_category", 610),
    Expectation("unmapped categories", "unmapped_categories", 2),
    Expectation("payments value<=0", "nonpositive_value", 9),
    Expectation("payments not_defined", "not_defined_type", 3),
    Expectation("orders w/o item row", "orders_without_items", 775),
    Expectation("orders w/o payment row", "orders_without_payments", 1),
    Expectation("delivered orders", "delivered_orders", 96478),
]

RULES = [
    Rule("DQ-01", "fan-out", "orders", ("multi_items", "max_items", "multi_payments", "max_payments"), "multi_items", "n_orders"),
    Rule("DQ-02", "duplicate", "geolocation", ("geo_rows", "geo_prefixes"), "geo_repeats", "geo_rows"),
    Rule("DQ-03", "identity", "customers", ("customer_ids", "unique_customers"), "extra_ids", "customer_ids"),
    Rule("DQ-04", "missing", "order_reviews", ("missing_message", "missing_title"), "missing_message", "rows_order_reviews"),
    Rule("DQ-05", "missing", "orders", ("missing_delivered", "missing_carrier", "missing_approved"), "missing_delivered", "rows_orders"),
    Rule("DQ-06", "missing", "products", ("missing_category",), "missing_category", "rows_products"),
    Rule("DQ-07", "unmapped", "products", ("unmapped_categories",), "unmapped_categories", "rows_category_translation"),
    Rule("DQ-08", "invalid", "order_payments", ("nonpositive_value", "not_defined_type"), "nonpositive_value", "rows_order_payments"),
    Rule("DQ-09", "childless", "orders", ("orders_without_items", "orders_without_payments"), "orders_without_items", "rows_orders"),
    Rule("DQ-10", "disagreement", "labels", ("labelled", "label_mismatches"), "label_mismatches", "labelled"),
    Rule(
        "RI-00", "orphan", "children",
        ("items_orphan_orders", "payments_orphan_orders", "reviews_orphan_orders", "items_orphan_products"), "orphans", "child_rows",
    ),
]


def _per_order(t: Tables) -> DataFrame:
    """One row per order key with what all order-level figures need.

    Orders, items, payments and reviews are each read once here; the result is
    checkpointed, as every figure below reads it.
    """
    orders, score = t["orders"], F.col("review_score").cast("bigint")
    delivered = F.col("order_status") == "delivered"
    bought = F.col(PURCHASED)
    amounts = {"gmv": minor_units(F.col("price")), "freight": minor_units(F.col("freight_value"))}
    count = lambda condition: F.coalesce(condition, F.lit(False)).cast("bigint")
    return cut_lineage(
        cogroup_counts(
            "order_id",
            {
                "orders": (
                    orders.select("order_id", *_flags(orders), out.delivery_micros().alias("micros"), (F.year(bought) * 100 + F.month(bought)).alias("_ym"), delivered.alias("_done")),
                    {**{c: F.col(c) for c in ORDER_FLAGS}, "micros": F.col("micros"), "ym": F.when(F.col("_done"), F.col("_ym"))},
                ),
                "items": (t["order_items"], {"value": amounts["gmv"] + amounts["freight"], **amounts}),
                "payments": (
                    t["order_payments"],
                    {
                        "paid": minor_units(F.col("payment_value")),
                        "nonpositive_value": count(F.col("payment_value") <= 0),
                        "not_defined_type": count(F.col("payment_type") == "not_defined"),
                    },
                ),
                "reviews": (
                    t["order_reviews"],
                    {
                        "scores": F.when(score.isNotNull(), 1).cast("bigint"), "total": score, "squares": score * score,
                        "missing_message": count(F.col("review_comment_message").isNull()),
                        "missing_title": count(F.col("review_comment_title").isNull()),
                    },
                ),
            },
            largest=("micros", "ym"),
        )
    )


def _reviews(per_order: DataFrame) -> list[DataFrame]:
    """Delivery-versus-score signal and scores by status, from per-order review sums."""
    scored = per_order.filter(F.col("scores") > 0).select(
        "scores", "total",
        # scores are whole numbers from 1 to 5, so these sums are exact
        (F.col("squares") - F.col("total") * F.col("total") / F.col("scores")).alias("spread"),
        out.in_days(F.col("micros")).alias("delivery_days"),
        F.when(F.col("delivered_orders") > 0, "delivered").alias("order_status"),
    )
    signal = out.corr_at_child_grain(scored, "delivery_days", "scores", "total", "spread")
    return [
        signal.select(F.col("r").alias("r_delivery_vs_score")),
        out.score_by_status(scored, "order_status", "delivered", "total", "scores"),
    ]


def _monthly_delivered(per_order: DataFrame) -> DataFrame:
    monthly = per_order.filter("ym IS NOT NULL").groupBy("ym").agg(F.sum("delivered_orders").alias("n"))
    return monthly.agg(
        F.min("ym").alias("first_month"), F.max("ym").alias("last_month"), out.first_largest("ym", "n").alias("peak_month"),
        F.max("n").alias("peak_orders"),
    )


def _repeat(t: Tables) -> DataFrame:
    owners = t["customers"].select("customer_id", "customer_unique_id")
    per_id = t["orders"].groupBy("customer_id").agg(F.count("*").alias("n"))
    per_person = per_id.join(owners, "customer_id").groupBy("customer_unique_id").agg(F.sum("n").alias("n"))
    return per_person.agg(percent(count_true(F.col("n") > 1), F.count("*")).alias("repeat_rate_pct"))


ORDER_FLAGS = ("delivered_orders", "missing_delivered", "missing_carrier", "missing_approved")


def _flags(orders: DataFrame) -> list:
    holds = (
        F.coalesce(F.col("order_status") == "delivered", F.lit(False)),
        F.col(DELIVERED).isNull(), F.col("order_delivered_carrier_date").isNull(), F.col("order_approved_at").isNull(),
    )
    return [h.cast("bigint").alias(name) for h, name in zip(holds, ORDER_FLAGS)]


def _order_figures() -> list:
    """Families, coverage and totals of orders and their children, from one row per order key."""
    known = F.col("order_id").isNotNull()
    has = lambda c: known & (F.col(f"n_{c}") > 0)
    zero = F.lit(0).cast("bigint")
    figures = [F.count_if(has("orders")).alias("n_orders")]
    for child, rows in (("items", "n_items"), ("payments", "n_payments"), ("reviews", "n_reviews")):
        figures += [
            F.coalesce(F.sum(F.when(~has("orders"), F.col(rows))), zero).alias(f"{child}_orphan_orders"),
            F.coalesce(F.sum(F.when(~has(child), F.col("n_orders"))), zero).alias(f"orders_without_{child}"),
        ]
        if child != "reviews":
            figures += [
                F.count_if(F.col(rows) > 1).alias(f"multi_{child}"), F.max(F.when(F.col(rows) > 1, F.col(rows))).alias(f"max_{child}")
            ]
    figures += [F.coalesce(F.sum(c), zero).alias(c) for c in ORDER_FLAGS]
    return figures + [in_units(F.sum(c)).alias(c) for c in ("gmv", "freight")]


def audit_metrics(t: Tables) -> DataFrame:
    """Every audited figure in one wide row."""
    per_order = _per_order(t)
    counted = {"orders": "n_orders", "order_items": "n_items", "order_payments": "n_payments", "order_reviews": "n_reviews"}
    rows = {name: per_order.agg(F.coalesce(F.sum(c), F.lit(0)).alias(f"rows_{name}")) for name, c in counted.items()}
    shapes = [
        rows.get(name, t[name].agg(F.count("*").alias(f"rows_{name}"))).withColumn(f"cols_{name}", F.lit(len(t[name].columns)))
        for name in SHAPES
    ]
    median = exact_quantiles(per_order, F.col("micros"), {"m": 0.5})
    products = quality.key_coverage(
        t["products"], "product_id", t["order_items"], "product_id", "items_orphan_products", "products_without_items"
    )
    unmapped = quality.unmapped_values(
        t["products"], "product_category_name", t["category_translation"], "product_category_name"
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    texts = per_order.agg(
        total("missing_message").alias("missing_message"), total("missing_title").alias("missing_title"),
        (total("n_reviews") - total("missing_message")).alias("with_text"),
        percent(total("n_reviews") - total("missing_message"), total("n_reviews")).alias("pct_with_text"),
        total("nonpositive_value").alias("nonpositive_value"), total("not_defined_type").alias("not_defined_type"),
    )
    return side_by_side(
        *shapes,
        per_order.agg(*_order_figures()),
        products,
        *_reviews(per_order),
        out.value_against_paid(per_order, "value", "paid").select("r_value_vs_payment"),
        median.select(F.round(out.in_days(F.col("m")), 2).alias("median_delivery_days")),
        _monthly_delivered(per_order),
        _repeat(t),
        quality.duplication(t["geolocation"], "geolocation_zip_code_prefix").select(
            F.col("rows").alias("geo_rows"), F.col("distinct_keys").alias("geo_prefixes")
        ),
        quality.two_key_counts(t["customers"], "customer_id", "customer_ids", "customer_unique_id", "unique_customers"),
        texts,
        t["products"].agg(count_true(F.col("product_category_name").isNull()).alias("missing_category")),
        unmapped.agg(F.count("*").alias("unmapped_categories")),
    )


def as_metrics(one_row: DataFrame) -> DataFrame:
    """A wide row in long form, as doubles."""
    return long_form(one_row, {c: F.col(c).cast("double") for c in one_row.columns})


def audit_register(t: Tables, expected: Sequence[Expectation] = EXPECTED) -> DataFrame:
    return quality.expectation_register(as_metrics(audit_metrics(t)), expected)


def issue_register(t: Tables, labels: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule. ``labels`` has a bulk and a gold topic; without it no label is compared."""
    compared = labels.filter("topic IS NOT NULL AND gold_topic IS NOT NULL") if labels is not None else None
    measured = audit_metrics(t)
    if compared is not None:
        measured = side_by_side(
            measured, compared.agg(F.count("*").alias("labelled"), count_true(F.col("topic") != F.col("gold_topic")).alias("label_mismatches"))
        )
    else:
        measured = measured.withColumns({"labelled": F.lit(0), "label_mismatches": F.lit(0)})
    orphans = ("items_orphan_orders", "payments_orphan_orders", "reviews_orphan_orders", "items_orphan_products")
    total = lambda *names: sum((F.col(n) for n in names), F.lit(0))
    measured = measured.withColumns(
        {
            "geo_repeats": F.col("geo_rows") - F.col("geo_prefixes"),
            "extra_ids": F.col("customer_ids") - F.col("unique_customers"),
            "orphans": total(*orphans),
            "child_rows": total("rows_order_items", "rows_order_payments", "rows_order_reviews"),
        }
    )
    return quality.issue_register(measured, rules)
