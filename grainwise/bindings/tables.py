"""Star-schema test tables seen as marketplace tables.

All order-level children live in ``lineitem`` here, so they are aggregated together:
one scan gives items, reviews and the delivery date. Only a product that keeps the
distinct sellers needs a second shuffle. Catalyst prunes the aggregates and columns
that a product does not use.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.functions.classify import first_match
from grainwise.functions.money import cents, exact_total
from grainwise.functions.temporal import plus_days
from grainwise.operators.frames import inline_table
from grainwise.operators.grain import attach, to_parent_grain
from grainwise.plans.orders import derive_order_fields, graded_payments, item_measures, review_measures

DELIVERED_STATUS = "F"
REPEAT_MIN = 12  # every customer orders more than once in this data
PROMISED_DAYS = {"1": 300, "2": 600, "3": 900, "4": 1200, "5": 1500}
DELIVERY_EDGES = (0, 250, 500, 1000, 2000)
CATEGORY_LOOKUP = {"STANDARD": "standard", "PROMO": "promotional", "LARGE": "large_goods", "SMALL": "small_goods"}
CATEGORY_MANUAL = {"MEDIUM": "medium_goods"}
LANGUAGES = ["en", "de", "fr", "es", "pt"]
QUALITY = ["good", "poor"]

# Columns and types of the test tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class Star:
    """Lazy access to the tables of one folder, raw and in marketplace shape."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        """Lazy scan with the declared schema; inferring it would start a job per table."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def orders(self) -> DataFrame:
        first = F.substring("o_orderpriority", 1, 1)
        days = first_match([(first == p, d) for p, d in PROMISED_DAYS.items()])
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            plus_days(F.col("o_orderdate"), days).alias("order_estimated_delivery_date"),
        )

    def lines(self) -> DataFrame:
        price = cents(F.col("l_extendedprice"))
        message = F.when(F.col("l_returnflag") == "R", F.col("l_returnflag"))
        title = F.when(F.col("l_linestatus") == "O", F.col("l_linestatus"))
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            price.alias("price_cents"),
            (price * cents(F.col("l_tax"))).alias("freight_units"),  # ten-thousandths
            F.expr("1 + (cast(l_quantity as int) - 1) div 10").alias("review_score"),
            message.alias("review_comment_message"),
            title.alias("review_comment_title"),
            F.col("l_shipdate").alias("shipped"),
        )

    @staticmethod
    def item_measures() -> dict[str, Column]:
        return item_measures(
            exact_total(F.col("price_cents")),
            exact_total(F.col("freight_units"), 4),
            F.col("order_item_id"),
            F.col("seller_id"),
        )

    def order_children(self) -> DataFrame:
        score = F.col("review_score")
        return to_parent_grain(
            self.lines(),
            "order_id",
            {
                **self.item_measures(),
                **review_measures(score, F.col("review_comment_message").isNotNull()),
                "review_total": F.sum(score),
                "review_spread": F.var_pop(score) * F.count(score),
                "shipped": F.max("shipped"),
            },
        )

    def order_grain(self, with_payments: bool = False) -> DataFrame:
        joined = attach(self.orders(), self.order_children(), "order_id")
        if with_payments:  # the parent of a payment is the customer here
            joined = attach(joined, self.payment_grain(), "customer_id")
        arrived = F.when(F.col("order_status") == DELIVERED_STATUS, F.col("shipped"))
        return derive_order_fields(
            joined.withColumn("order_delivered_customer_date", arrived)
            .withColumn("customer_unique_id", F.col("customer_id"))
            .drop("shipped"),
            DELIVERED_STATUS,
        )

    def delivered_grain(self) -> DataFrame:
        """The order grain of orders with a delivery date: the filter reaches the scan of orders."""
        orders = self.orders().filter(F.col("order_status") == DELIVERED_STATUS)
        joined = orders.join(self.order_children().filter(F.col("shipped").isNotNull()), "order_id")
        return derive_order_fields(
            joined.withColumnRenamed("shipped", "order_delivered_customer_date")
            .withColumn("customer_unique_id", F.col("customer_id")),
            DELIVERED_STATUS,
        )

    def customers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", F.col("n_name").alias("customer_state"))
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_custkey").alias("customer_unique_id"),
                "customer_state",
            )
        )

    def payments(self) -> DataFrame:
        """Events as payments; their parent is the customer."""
        return self.raw("events").select(
            F.col("user_id").alias("customer_id"),
            F.col("event_id").alias("payment_sequential"),
            F.col("event_type").alias("payment_type"),
            F.hour("ts").alias("payment_installments"),
            cents(F.col("value")).alias("payment_cents"),
        )

    def payment_grain(self) -> DataFrame:
        """Payments of each customer with the type of the largest one."""
        return graded_payments(
            self.payments(), "customer_id", F.col("payment_cents"), F.col("payment_sequential"), F.col("payment_installments")
        )

    def order_totals(self) -> DataFrame:
        """Orders as the item-like child of a customer."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("customer_id"), cents(F.col("o_totalprice")).alias("price_cents")
        )

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category_name")
        )

    def translation(self) -> DataFrame:
        return inline_table(
            self.spark,
            {
                "product_category_name": list(CATEGORY_LOOKUP),
                "product_category_name_english": list(CATEGORY_LOOKUP.values()),
            },
        )

    def classified(self) -> DataFrame:
        """Labelled documents as classified reviews; only the narrow columns are read."""
        documents = self.raw("documents").select(
            F.col("doc_id"),
            F.col("lang").alias("topic"),
            (F.col("n_chars") / F.lit(1000.0)).alias("delivery_days"),
            F.least(F.lit(5), F.expr("1 + n_chars div 1000")).cast("int").alias("review_score"),
        )
        quality, toxic = F.col("quality"), F.col("toxic")
        name = lambda flag: F.when(flag == 1, "good").otherwise("poor")
        sentiment = first_match([(toxic == 1, "negative"), (quality == 1, "positive")], "neutral")
        labels = self.raw("labels").select(
            "doc_id",
            name(quality).alias("reference"),
            name(1 - toxic).alias("system"),
            sentiment.alias("sentiment"),
        )
        return labels.join(documents, "doc_id")


class LandedStar(Star):
    """The same tables, some of them read from where they were landed."""

    def __init__(self, spark: SparkSession, folder: str, landed: Mapping[str, DataFrame]):
        super().__init__(spark, folder)
        self.landed = landed

    def raw(self, name: str) -> DataFrame:
        return self.landed[name] if name in self.landed else super().raw(name)
