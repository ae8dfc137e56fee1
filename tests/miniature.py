"""A hand-written marketplace with one row per known trap."""

from __future__ import annotations

from datetime import datetime as dt
from decimal import Decimal as D

from pyspark.sql import DataFrame, SparkSession

from grainwise.sources.schemas import MARKETPLACE

P = dt(2018, 1, 10, 12, 0, 0)


def _order(oid, cust, status="delivered", bought=P, arrived=None, promised=dt(2018, 2, 1)):
    return (oid, cust, status, bought, bought, bought, arrived, promised)


ORDERS = [
    # two items and three payments: fan-out; delivered exactly 5.0 days later
    _order("o01", "c01", arrived=dt(2018, 1, 15, 12)),
    # same person under a second customer id, bought 23:00, nothing attached
    _order("o02", "c02", "canceled", dt(2018, 3, 1, 23)),
    # delivered by status without a date, and a date without the status
    _order("o03", "c03"),
    _order("o04", "c04", "shipped", arrived=dt(2018, 1, 20, 12)),
    # late by one second, exactly on the promise, no promise
    _order("o05", "c05", arrived=dt(2018, 2, 1, 0, 0, 1)),
    _order("o06", "c06", arrived=dt(2018, 2, 1)),
    _order("o07", "c07", arrived=dt(2018, 1, 30, 12), promised=None),
    # negative delivery time
    _order("o08", "c08", arrived=dt(2018, 1, 9, 12)),
    # month without a delivered order, and the last purchase of all at 01:00
    _order("o09", "c09", "invoiced", dt(2018, 2, 2)),
    _order("o10", "c10", "created", dt(2018, 3, 3, 1)),
    _order("o11", "c11", arrived=dt(2018, 4, 30)),
    _order("o12", "c12", arrived=dt(2018, 1, 17, 12)),
]


def _item(oid, n, product, price, freight="1.00", seller="s1"):
    return (oid, n, product, seller, P, D(price), D(freight))


ITEMS = [
    _item("o01", 1, "p1", "10.00"),
    _item("o01", 2, "p2", "20.50", seller="s2"),
    _item("o03", 1, "p1", "5.00"),
    _item("o04", 1, "p3", "7.25"),
    _item("o05", 1, "p4", "30.50"),
    _item("o06", 1, "p5", "99.99", "10.01"),
    _item("o07", 1, "p5", "0.01", "0.00"),
    _item("o08", 1, "p1", "15.50"),
    _item("o09", 1, "p2", "10.00"),
    _item("o11", 1, "p6", "12.00"),
    _item("o12", 1, "p1", "3.00"),
    _item("orphan", 1, "p1", "1.00"),
    _item("o12", 2, "missing", "2.00"),
]


def _pay(oid, n, kind, value, installments=1):
    return (oid, n, kind, installments, D(value))


PAYMENTS = [
    _pay("o01", 1, "voucher", "12.50"),
    _pay("o01", 2, "credit_card", "12.50", 3),  # equal largest: the later row wins
    _pay("o01", 3, "voucher", "7.50"),
    _pay("o03", 1, "boleto", "6.00"),
    _pay("o04", 1, "boleto", "8.25"),
    _pay("o05", 1, "credit_card", "31.50", 10),
    _pay("o06", 1, "debit_card", "110.00"),
    _pay("o07", 1, "not_defined", "0.00"),
    _pay("o08", 1, "boleto", "16.50"),
    _pay("o09", 1, "boleto", "11.00"),
    _pay("o11", 1, "boleto", "13.00"),
    _pay("orphan", 1, "boleto", "2.00"),
]


def _review(rid, oid, score, message=None, title=None):
    return (rid, oid, score, title, message, P, P)


NASTY = 'line one\nline "two",  and\tmore  '
REVIEWS = [
    _review("r01", "o01", 2, NASTY),
    _review("r02", "o01", 3),  # mean 2.5
    _review("r03", "o05", 1, "late", "t"),
    _review("r04", "o06", 5),
    _review("r05", "o07", 4, "ok"),
    _review("r06", "o07", 5),  # mean 4.5
    _review("r07", "o08", 5),
    _review("r08", "o11", 1),
    _review("r09", "o09", 2),
    _review("r10", "orphan", 3, "who"),
    _review("r11", "o12", 4),
]

PRODUCTS = [
    ("p1", "brinquedos") + (1,) * 7,
    ("p2", "moveis") + (1,) * 7,
    ("p3", None) + (None,) * 7,
    ("p4", "brinquedos") + (1,) * 7,
    ("p5", "pc_gamer") + (1,) * 7,
    ("p6", "nova_categoria") + (1,) * 7,
]
TRANSLATION = [("brinquedos", "toys"), ("moveis", "furniture")]
SELLERS = [("s1", 1000, "x", "SP"), ("s2", 2000, "y", "RJ")]
CUSTOMERS = [
    (f"c{i:02d}", "u01" if i in (1, 2) else f"u{i:02d}", 1000 + i, "city", "SP" if i < 6 else "RJ") for i in range(1, 13)
]
GEO = [
    (1000, -1.0, 10.0, "a", "SP"),
    (1000, -2.0, 20.0, "b", "SP"),
    (1000, -3.0, 30.0, "b", "RJ"),
    (2000, 5.0, 5.0, "m", "RJ"),  # tied city: the greater name wins
    (2000, 7.0, 5.0, "n", "RJ"),
]

ROWS = {
    "orders": ORDERS,
    "order_items": ITEMS,
    "order_payments": PAYMENTS,
    "order_reviews": REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "customers": CUSTOMERS,
    "geolocation": GEO,
    "category_translation": TRANSLATION,
}


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, MARKETPLACE[name]) for name, rows in ROWS.items()}
