"""Schemas of the nine marketplace tables (fixed values: column names and types).

Declared rather than inferred: inference costs a pass over the data and drifts
with the sample. Money is decimal so that totals do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "timestamp_ntz": TimestampNTZType(),
    "decimal(12,2)": DecimalType(12, 2),
}


def _struct(columns: str) -> StructType:
    pairs = (field.split() for field in columns.replace("(12,2)", "(12;2)").split(","))
    return StructType([StructField(name, _TYPES[kind.replace(";", ",")]) for name, kind in pairs])


_DDL = {
    "orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz,
        order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz,
        order_estimated_delivery_date timestamp_ntz""",
    "order_items": """
        order_id string, order_item_id int, product_id string, seller_id string,
        shipping_limit_date timestamp_ntz, price decimal(12,2), freight_value decimal(12,2)""",
    "order_payments": """
        order_id string, payment_sequential int, payment_type string,
        payment_installments int, payment_value decimal(12,2)""",
    "order_reviews": """
        review_id string, order_id string, review_score int, review_comment_title string,
        review_comment_message string, review_creation_date timestamp_ntz,
        review_answer_timestamp timestamp_ntz""",
    "products": """
        product_id string, product_category_name string, product_name_lenght int,
        product_description_lenght int, product_photos_qty int, product_weight_g int,
        product_length_cm int, product_height_cm int, product_width_cm int""",
    "sellers": """
        seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string""",
    "customers": """
        customer_id string, customer_unique_id string, customer_zip_code_prefix int,
        customer_city string, customer_state string""",
    "geolocation": """
        geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double,
        geolocation_city string, geolocation_state string""",
    "category_translation": """
        product_category_name string, product_category_name_english string""",
}

MARKETPLACE = {name: _struct(ddl) for name, ddl in _DDL.items()}
LABELS = _struct("idx int, topic string, sentiment string")
