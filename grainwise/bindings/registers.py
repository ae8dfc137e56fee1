"""Expectation, issue and dictionary registers over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.bindings.tables import CATEGORY_LOOKUP, DELIVERED_STATUS, PROMISED_DAYS, REPEAT_MIN, Star
from grainwise.functions.classify import first_match
from grainwise.functions.stats import count_true, ratio
from grainwise.functions.temporal import plus_days
from grainwise.operators import quality
from grainwise.operators.frames import side_by_side, union_all
from grainwise.operators.grain import cogroup_counts
from grainwise.plans.audit import as_metrics

ALL_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Fields, types and meaning of the profiled tables.
FIELDS = {
    "region": [("r_regionkey", "int", "Region key."), ("r_name", "string", "Region name.")],
    "nation": [
        ("n_nationkey", "int", "Nation key."),
        ("n_name", "string", "Nation name; the state of a customer."),
        ("n_regionkey", "int", "Region of the nation."),
    ],
    "customer": [
        ("c_custkey", "bigint", "Person key."),
        ("c_name", "string", "Customer name."),
        ("c_nationkey", "int", "Nation of the customer."),
        ("c_acctbal", "double", "Account balance."),
        ("c_mktsegment", "string", "Market segment."),
    ],
    "supplier": [
        ("s_suppkey", "bigint", "Seller key."),
        ("s_name", "string", "Seller name."),
        ("s_nationkey", "int", "Nation of the seller."),
        ("s_acctbal", "double", "Account balance."),
    ],
    "part": [
        ("p_partkey", "bigint", "Product key."),
        ("p_name", "string", "Product name."),
        ("p_brand", "string", "Brand; repeated dimension key."),
        ("p_type", "string", "Type of part, read as a category."),
        ("p_size", "int", "Size."),
        ("p_retailprice", "double", "List price."),
    ],
    "orders": [
        ("o_orderkey", "bigint", "Key of the order."),
        ("o_custkey", "bigint", "Key of the ordering customer."),
        ("o_orderstatus", "string", "F counts as delivered."),
        ("o_totalprice", "double", "Order total."),
        ("o_orderdate", "timestamp_ntz", "Time the order was entered; months and recency count from it."),
        ("o_orderpriority", "string", "Priority; sets the promised days."),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "Order of the item."),
        ("l_partkey", "bigint", "Product of the item."),
        ("l_suppkey", "bigint", "Seller of the item."),
        ("l_linenumber", "int", "Number of the line; not unique within an order."),
        ("l_quantity", "double", "Quantity; source of the review score."),
        ("l_extendedprice", "double", "Item price."),
        ("l_discount", "double", "Discount."),
        ("l_tax", "double", "Tax share; source of freight."),
        ("l_returnflag", "string", "R marks a review with text."),
        ("l_linestatus", "string", "O marks a review with a title."),
        ("l_shipdate", "timestamp_ntz", "Shipping time."),
    ],
    "events": [
        ("event_id", "bigint", "Key of the event; later events have larger keys."),
        ("ts", "timestamp_ntz", "Event time."),
        ("user_id", "bigint", "Customer of the event."),
        ("event_type", "string", "Payment type."),
        ("value", "double", "Payment value."),
        ("props", "string", "Raw properties."),
    ],
    "documents": [
        ("doc_id", "bigint", "Key of the document."),
        ("text", "string", "Whole text."),
        ("lang", "string", "Language code."),
        ("source", "string", "Where the text comes from."),
        ("n_chars", "bigint", "Length of the text in characters."),
    ],
    "embeddings": [
        ("vec_id", "bigint", "Key of the vector."),
        ("embedding", "array<float>", "Components of the vector."),
        ("label", "int", "Cluster the vector was drawn from."),
    ],
    "pages": [
        ("page_id", "bigint", "Key of the page."),
        ("url", "string", "Address of the page."),
        ("html", "string", "Source of the page."),
    ],
    "benchmark": [
        ("item_id", "bigint", "Key of the passage."),
        ("text", "string", "Text of the passage."),
    ],
    "conversations": [
        ("conv_id", "bigint", "Conversation of the turn."),
        ("turn", "bigint", "Place of the turn."),
        ("role", "string", "Who speaks."),
        ("text", "string", "What is said."),
    ],
    "labels": [
        ("doc_id", "bigint", "Labelled document."),
        ("quality", "int", "Reference label."),
        ("toxic", "int", "System label, inverted."),
    ],
}


#: Fields of the order grain that no table holds.
DERIVED = {
    "delivery_days": "Days from order to delivery.",
    "est_delivery_days": "Days from order to promise.",
    "is_late": "Delivered after the promise.",
    "has_items": "An item row exists.",
    "order_value": "Item prices and freight.",
    "n_items": "Item rows.",
    "review_score": "Mean score of the item rows.",
    "purchase_ym": "Month of the order.",
}


def dictionary_tables(t: Star) -> tuple[dict[str, DataFrame], dict[tuple[str, str], str]]:
    """All tables and the derived order grain, with the meaning of each field."""
    derived = t.order_grain().select(*DERIVED).withColumn("order_value", F.col("order_value").cast("double"))
    tables = {name: t.raw(name) for name in FIELDS} | {"order_grain": derived}
    meaning = {(name, field): text for name, fields in FIELDS.items() for field, _, text in fields}
    return tables, meaning | {("order_grain", field): text for field, text in DERIVED.items()}


ORPHANS = [
    "items_orphan_orders", "payments_orphan_customers", "orders_orphan_customers", "items_orphan_products",
]
CHILDLESS = [
    "orders_without_items", "customers_without_payments", "customers_without_orders", "products_without_items",
]

_RELATIONS = [
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("customer", "c_custkey", "events", "user_id"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
]


def integrity(t: Star) -> DataFrame:
    """All orphan and childless counts in one row, one shuffle per relation."""
    checked = [
        quality.key_coverage(t.raw(parent), pk, t.raw(child), ck, orphans, childless)
        for (parent, pk, child, ck), orphans, childless in zip(_RELATIONS, ORPHANS, CHILDLESS)
    ]
    return side_by_side(*checked)


# orders without items are a known gap and stay flagged, so does the unmeasured metric
EXPECTED = [
    quality.Expectation("table sizes", "nations", 25),
    quality.Expectation("table sizes", "regions", 5),
    quality.Expectation("unique keys", "order_key_duplicates", 0),
    quality.Expectation("unique keys", "label_key_duplicates", 0),
    quality.Expectation("complete orders", "missing_order_fields", 0),
    *[quality.Expectation("referential integrity", name, 0) for name in ORPHANS],
    quality.Expectation("orders have items", "orders_without_items", 0),
    quality.Expectation("mean score", "mean_review_score", 3.0, 0.1),
    quality.Expectation("late share", "late_share", 0.42, 0.1),
    quality.Expectation("payments are positive", "nonpositive_payments", 0),
    quality.Expectation("unmeasured", "not_measured", 1),
]


def _order_audit(t: Star) -> DataFrame:
    """Figures of orders and their lines in one row: each table read once, one shuffle on the order key."""
    raw = t.raw("orders")
    days = first_match([(F.substring("o_orderpriority", 1, 1) == p, d) for p, d in PROMISED_DAYS.items()])
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    orders = raw.select(
        F.col("o_orderkey").alias("k"), F.lit(1).cast("bigint").alias("orders"),
        flag(F.col("o_orderstatus") == DELIVERED_STATUS).alias("arrived"),
        flag(F.col("o_orderstatus") != DELIVERED_STATUS).alias("undelivered"),
        plus_days(F.col("o_orderdate"), days).alias("promised"),
        sum((F.col(c).isNull().cast("bigint") for c in raw.columns), F.lit(0).cast("bigint")).alias("blank"),
    )
    lines = t.lines().select(
        F.col("order_id").alias("k"), F.lit(1).cast("bigint").alias("items"), F.col("shipped"), F.col("review_score").alias("score"),
        F.col("review_comment_message").isNull().cast("bigint").alias("message"),
        F.col("review_comment_title").isNull().cast("bigint").alias("title"),
    )
    sums = ("orders", "arrived", "undelivered", "blank", "items", "score", "message", "title")
    per_key = union_all([orders, lines]).groupBy("k").agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in sums], F.max("promised").alias("promised"), F.max("shipped").alias("shipped")
    )
    known = F.col("k").isNotNull()
    late = F.when(F.col("arrived") > 0, (F.col("shipped") > F.col("promised")).cast("int"))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return per_key.agg(
        (total("orders") - count_true(F.col("orders") > 0)).alias("order_key_duplicates"),
        total("blank").alias("missing_order_fields"),
        total("items", ~known | (F.col("orders") == 0)).alias("items_orphan_orders"),
        total("orders", ~known | (F.col("items") == 0)).alias("orders_without_items"),
        F.round(ratio(total("score"), total("items")), 6).alias("mean_review_score"),
        F.round(F.avg(late), 6).alias("late_share"),
        count_true(F.col("items") > 1).alias("multi"),
        F.max("items").alias("largest"),
        count_true(F.col("items") > 0).alias("parents"),
        total("message").alias("message"), total("title").alias("title"), total("items").alias("lines"),
        total("undelivered").alias("undelivered"), total("orders").alias("orders"),
    )


def _customer_audit(t: Star) -> DataFrame:
    """Figures of customers, their orders and their payments in one row, one shuffle on the customer key."""
    per_key = cogroup_counts(
        "k",
        {
            "people": (t.raw("customer").select(F.col("c_custkey").alias("k")), {}),
            "orders": (t.raw("orders").select(F.col("o_custkey").alias("k")), {}),
            "payments": (
                t.payments().withColumnRenamed("customer_id", "k"),
                {
                    "nonpositive": (F.col("payment_cents") <= 0).cast("bigint"),
                    "undefined": (F.col("payment_type") == "error").cast("bigint"),
                },
            ),
        },
    )
    known = F.col("k").isNotNull()
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return per_key.agg(
        total("n_payments", ~known | (F.col("n_people") == 0)).alias("payments_orphan_customers"),
        total("n_orders", ~known | (F.col("n_people") == 0)).alias("orders_orphan_customers"),
        total("n_people", ~known | (F.col("n_payments") == 0)).alias("customers_without_payments"),
        total("nonpositive").alias("nonpositive_payments"), total("undefined").alias("undefined"),
        total("n_payments").alias("payments"), total("n_people").alias("customers"), total("n_orders").alias("order_ids"),
        count_true(known & (F.col("n_orders") > 0)).alias("people"),
        count_true(F.col("n_orders") >= REPEAT_MIN).alias("repeat"),
    )


def _product_links(t: Star) -> DataFrame:
    return quality.key_coverage(
        t.raw("part"), "p_partkey", t.raw("lineitem"), "l_partkey", "items_orphan_products", "products_without_items"
    )


def expectations(t: Star) -> DataFrame:
    """Expected against measured values with tolerances."""
    keys = t.raw("labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    measured = [
        t.raw("nation").agg(F.count("*").alias("nations")),
        t.raw("region").agg(F.count("*").alias("regions")),
        keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("label_key_duplicates")),
        _order_audit(t).select(
            "order_key_duplicates", "missing_order_fields", "items_orphan_orders", "orders_without_items", "mean_review_score", "late_share"
        ),
        _customer_audit(t).select("payments_orphan_customers", "orders_orphan_customers", "nonpositive_payments"),
        _product_links(t).select("items_orphan_products"),
    ]
    return quality.expectation_register(union_all([as_metrics(m) for m in measured]), EXPECTED)


RULES = [
    quality.Rule("DQ-01", "fan-out", "lineitem", ("multi", "largest"), "multi", "parents"),
    quality.Rule("DQ-02", "duplicate", "part", ("brand_rows", "brands"), "brand_repeats", "brand_rows"),
    quality.Rule("DQ-03", "identity", "orders", ("order_ids", "people", "repeat"), "repeat", "people"),
    quality.Rule("DQ-04", "missing", "lineitem", ("message", "title"), "message", "lines"),
    quality.Rule("DQ-05", "missing", "orders", ("undelivered",), "undelivered", "orders"),
    quality.Rule("DQ-06", "missing", "part", ("uncategorised",), "uncategorised", "brand_rows"),
    quality.Rule("DQ-07", "unmapped", "part", ("unmapped",), "unmapped_rows", "brand_rows"),
    quality.Rule("DQ-08", "invalid", "events", ("nonpositive_payments", "undefined"), "nonpositive_payments", "payments"),
    quality.Rule("DQ-09", "childless", "parents", ("orders_without_items", "customers_without_payments"), "orders_without_items", "orders"),
    quality.Rule("DQ-10", "disagreement", "labels", ("labelled", "mismatches"), "mismatches", "labelled"),
    quality.Rule("RI-00", "orphan", "children", ("orphans",), "orphans", "lines"),
]


def dq_register(t: Star) -> DataFrame:
    """One row per rule with the measured extent, severity and treatment."""
    category = F.col("p_type")
    named = category.isin(list(CATEGORY_LOOKUP))
    parts = t.raw("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    products = side_by_side(
        parts.groupBy("p_brand").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("brand_rows"), F.count("p_brand").alias("brands")),
        parts.groupBy("p_type").agg(F.sum("n").alias("n")).agg(
            F.coalesce(F.sum(F.when(category.isNull(), F.col("n"))), F.lit(0)).alias("uncategorised"),
            count_true(~named).alias("unmapped"),
            F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("unmapped_rows"),
        ),
    )
    wide = side_by_side(
        _order_audit(t), _customer_audit(t), _product_links(t), products,
        t.raw("labels").agg(F.count("*").alias("labelled"), count_true(F.col("quality") != 1 - F.col("toxic")).alias("mismatches")),
    )
    measured = wide.withColumns(
        {
            "brand_repeats": F.col("brand_rows") - F.col("brands"),
            "orphans": sum((F.col(c) for c in ORPHANS), F.lit(0)),
        }
    )
    return quality.issue_register(measured, RULES)
