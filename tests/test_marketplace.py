"""End-to-end checks on the miniature marketplace, figures worked out by hand."""

from __future__ import annotations

import math
import os
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainwise.operators import quality
from grainwise.operators.quality import Expectation, register_tally
from grainwise.plans import audit, marketplace
from grainwise.plans import orders as od
from grainwise.plans import outputs as out
from grainwise.plans.labels import build_labels, ingest_labels, review_sample
from grainwise.plans.questions import QUESTIONS
from grainwise.sources.io import land_marketplace, load_marketplace, write_csv
from tests.miniature import ITEMS, ORDERS, PAYMENTS, tables


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    raw, landed = (str(tmp_path_factory.mktemp(d)) for d in ("raw", "landed"))
    for name, df in tables(spark).items():
        write_csv(df, os.path.join(raw, f"{name}.csv"), single_file=True)
    land_marketplace(spark, raw, landed)
    return load_marketplace(spark, landed)


@pytest.fixture(scope="module")
def oc(t):
    return od.orders_clean(t).cache()


@pytest.fixture(scope="module")
def by_id(oc):
    return {r["order_id"]: r for r in oc.collect()}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_one_row_per_order(by_id, oc):
    assert oc.count() == len(ORDERS) == len(by_id)
    total = sum(r["order_product_revenue"] for r in by_id.values())
    assert total == sum(i[5] for i in ITEMS if i[0] != "orphan")


def test_children_are_aggregated_not_multiplied(by_id):
    r = by_id["o01"]
    assert (float(r.order_product_revenue), r.n_items, r.n_sellers, r.n_payments) == (30.5, 2, 2, 3)
    assert (float(r.order_payment_total), r.n_installments, r.main_payment_type) == (32.5, 3, "credit_card")
    assert (r.review_score, r.n_reviews, r.review_has_text) == (2.5, 2, 1)


def test_order_without_children(by_id):
    r = by_id["o02"]
    assert (r.has_items, r.has_payment, float(r.order_value), r.n_items) == (False, False, 0.0, 0)
    assert (r.order_payment_total, r.review_score, r.review_has_text) == (None, None, 0)


def test_delivery_fields(by_id):
    assert by_id["o01"].delivery_days == 5.0
    assert by_id["o08"].delivery_days == -1.0
    assert [by_id[k].is_late for k in ("o05", "o06", "o07", "o03")] == [True, False, None, None]
    assert (by_id["o03"].delivered, by_id["o03"].delivery_days) == (True, None)
    assert (by_id["o04"].delivered, by_id["o04"].delivery_days) == (False, 10.0)
    assert by_id["o02"].purchase_ym == "2018-03" and str(by_id["o02"].purchase_date) == "2018-03-01"


def test_geo_clean(t):
    got = {r.zip_prefix: (r.lat, r.lng, r.city, r.state) for r in od.geo_clean(t["geolocation"]).collect()}
    assert got == {1000: (-2.0, 20.0, "b", "SP"), 2000: (6.0, 5.0, "n", "RJ")}


def test_category_rules(t):
    products = od.products_clean(t["products"], t["category_translation"])
    got = {r.product_id: r.category_en for r in products.collect()}
    assert got == {"p1": "toys", "p2": "furniture", "p3": "unknown", "p4": "toys", "p5": "gaming_pc", "p6": "unknown"}
    items = od.items_with_category(t["order_items"], products)
    assert items.count() == len(ITEMS)
    assert items.filter("product_id = 'missing'").first().category_en == "unknown"


def test_rfm(t, oc):
    rfm = {r.customer_unique_id: r for r in od.customer_rfm(oc, od.last_purchase(t["orders"])).collect()}
    assert len(rfm) == 11
    one = rfm["u01"]
    # 2018-03-01 23:00 to 2018-03-03 01:00 is one whole day, although two calendar days
    assert (one.recency_days, one.frequency, float(one.monetary), one.is_repeat) == (1, 2, 32.5, True)
    assert one.segment == "Repeat (Loyal/Champion)"
    assert rfm["u10"].recency_days == 0 and rfm["u10"].R_score == 5 and float(rfm["u10"].monetary) == 0.0
    assert sorted(r.R_score for r in rfm.values()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    assert sorted(r.M_score for r in rfm.values()) == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_monthly_trend(oc):
    got = {r.purchase_ym: (r.orders, r.delivered_orders, r.gmv) for r in out.monthly_trend(oc).collect()}
    # March orders have no items; February has items and nothing delivered
    assert got == {"2018-01": (9, 8, 205.75), "2018-02": (1, 0, 10.0)}
    peak = out.trend_peak(out.monthly_trend(oc), min_orders=5).first()
    assert (peak.first_month, peak.last_month, peak.months, peak.supported_months) == ("2018-01", "2018-02", 2, 1)
    assert (peak.peak_month, peak.peak_orders) == ("2018-01", 9)
    assert out.trend_peak(out.monthly_trend(oc), min_orders=50).first().peak_month is None


def test_score_rounding_differs_between_the_two_products(oc):
    even = {r.score: r.n for r in out.score_vs_delivery(oc).collect()}
    up = {r.score: r.n for r in out.score_vs_delivery_sql(oc).collect()}
    assert even == {1: 2, 2: 1, 4: 2, 5: 2}  # 2.5 -> 2, 4.5 -> 4
    assert up == {1.0: 2, 3.0: 1, 4.0: 1, 5.0: 3}


def test_delivery_distribution_keeps_empty_buckets(oc):
    got = {r.bucket: r.orders for r in out.delivery_distribution(oc).collect()}
    assert list(got) == ["0-5", "5-10", "10-15", "15-20", "20-25", "25-30", "30-40", "40-60", "60+"]
    # exactly 5.0 and 20.0 days open their interval; the negative time is dropped
    assert list(got.values()) == [0, 2, 1, 0, 3, 0, 0, 0, 1]


def test_delivery_stats_match_sorted_values(oc, by_id):
    days = sorted(r.delivery_days for r in by_id.values() if r.delivery_days is not None)
    at = 0.9 * (len(days) - 1)
    lo = math.floor(at)
    p90 = days[lo] + (at - lo) * (days[lo + 1] - days[lo])
    r = out.delivery_stats(oc).first()
    assert (r.median_days, r.p90_days) == (round((days[3] + days[4]) / 2, 2), round(p90, 2))
    # 8 dated orders; the one without a promise is neither late nor on time
    assert (r.on_time_rate_pct, r.delivered_with_dates) == (62.5, 8)


def test_reconciliation(t):
    got = {r.metric: (r.naive_raw, r.decision_ready) for r in marketplace.output_tables(
        t, od.orders_clean(t), od.customer_rfm(od.orders_clean(t), od.last_purchase(t["orders"])),
        od.items_with_category(t["order_items"], od.products_clean(t["products"], t["category_translation"])),
    )["reconciliation"].collect()}
    ids = {o[0] for o in ORDERS}
    naive = [(i[5], p[4], i[0]) for i in ITEMS for p in PAYMENTS if i[0] == p[0] and i[0] in ids]
    with_items = {i[0] for i in ITEMS} & ids
    gmv = sum(i[5] for i in ITEMS if i[0] in ids)
    assert got["Join rows used for revenue"] == (len(naive), len(with_items))
    assert got["Product revenue (sum price, BRL)"] == (float(sum(n[0] for n in naive)), float(gmv))
    assert got["Cash collected (sum payment_value, BRL)"] == (
        float(sum(n[1] for n in naive)), float(sum(p[4] for p in PAYMENTS)),
    )
    half_up = lambda total, n: float((total / n).quantize(Decimal("0.01"), ROUND_HALF_UP))
    naive_aov = half_up(sum(n[0] for n in naive), len({n[2] for n in naive}))
    assert got["AOV (BRL per order)"] == (naive_aov, half_up(gmv, len(with_items)))


def test_invalid_payments_can_be_excluded(t):
    every, valid = (marketplace.fan_out(t, exclude_invalid=x).first() for x in (False, True))
    assert (every.naive_orders, valid.naive_orders) == (9, 8)  # o07 only has an undefined payment
    assert every.ready_cash == valid.ready_cash  # of value zero


def test_pareto_ties(spark):
    revenue = spark.createDataFrame(
        [("a", 50), ("b", 20), ("c", 20), ("d", 10)], "category_en string, r int"
    ).select("category_en", F.col("r").cast("decimal(12,2)").alias("revenue"))
    by_row = [(r.category_en, r.cum_pct) for r in out.category_pareto(revenue).orderBy("rank").collect()]
    assert by_row == [("a", 50.0), ("b", 70.0), ("c", 90.0), ("d", 100.0)]
    by_range = [(r.category_en, r.cum_pct) for r in out.category_pareto_top(revenue).orderBy("rank").collect()]
    assert by_range == [("a", 50.0), ("b", 90.0), ("c", 90.0), ("d", 100.0)]
    assert rows(out.pareto_threshold(revenue)) == [(2, 4)]


def test_build_writes_every_table(spark, t, tmp_path):
    outputs = marketplace.build(spark, t, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "cleaned")) == [
        "customer_rfm", "geo_clean", "order_items_clean", "orders_clean", "products_clean",
    ]
    assert sorted(os.listdir(tmp_path / "output")) == sorted(outputs)
    kpi = {r.kpi: r.value for r in outputs["kpi_summary"].collect()}
    assert len(kpi) == 13
    assert kpi["GMV (product revenue, BRL)"] == 215.75
    assert kpi["Total orders"] == 12 and kpi["Delivered orders"] == 8
    assert kpi["Unique customers (customer_unique_id)"] == 11
    assert kpi["Repeat-customer rate (%)"] == 9.09
    assert kpi["% reviews with text"] == 36.36
    states = {r.customer_state: (r.gmv, r.orders, r.customers) for r in outputs["revenue_by_state"].collect()}
    assert states == {"SP": (73.25, 4, 4), "RJ": (142.5, 6, 6)}


def test_audit_register(t):
    wanted = [
        Expectation("rows", "rows_orders", 12), Expectation("rows", "cols_orders", 8),
        Expectation("multi", "multi_items", 2), Expectation("multi", "max_items", 2),
        Expectation("pay", "multi_payments", 1), Expectation("pay", "max_payments", 3),
        Expectation("orphans", "items_orphan_orders", 1), Expectation("orphans", "payments_orphan_orders", 1),
        Expectation("orphans", "reviews_orphan_orders", 1), Expectation("orphans", "items_orphan_products", 1),
        Expectation("childless", "orders_without_items", 2), Expectation("childless", "orders_without_payments", 3),
        Expectation("people", "unique_customers", 11), Expectation("people", "repeat_rate_pct", 9.09),
        Expectation("unmapped", "unmapped_categories", 2), Expectation("missing", "missing_category", 1),
        Expectation("invalid", "nonpositive_value", 1), Expectation("invalid", "not_defined_type", 1),
        Expectation("peak", "peak_month", 201801), Expectation("text", "with_text", 4),
        # delivered orders average 2.5 + 1 + 5 + ... ; the orphan review counts as not delivered
        Expectation("score", "mean_not_delivered", 2.5), Expectation("score", "mean_all", 35 / 11, 0.0001),
        Expectation("wrong", "geo_rows", 6), Expectation("absent", "no_such_metric", 0),
    ]
    register = audit.audit_register(t, wanted)
    failed = {r.check for r in register.filter(~F.col("ok")).collect()}
    assert failed == {"wrong", "absent"}
    assert rows(register_tally(register)) == [(len({w.check for w in wanted}) - 2, len({w.check for w in wanted}))]
    published = audit.audit_register(t)
    assert published.count() == len(audit.EXPECTED)
    assert len({e.check for e in audit.EXPECTED}) == 37


def test_issue_register(t):
    got = {r.id: r.issue for r in audit.issue_register(t).collect()}
    assert len(got) == 11
    assert got["DQ-01"] == "multi items 2, max items 2, multi payments 1, max payments 3"
    assert got["RI-00"] == (
        "items orphan orders 1, payments orphan orders 1, reviews orphan orders 1, items orphan products 1"
    )
    assert got["DQ-10"] == "labelled 0, label mismatches 0"


def test_issue_register_compares_labels(spark, t):
    labels = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "topic string, gold_topic string")
    row = next(r for r in audit.issue_register(t, labels).collect() if r.id == "DQ-10")
    assert (row.issue, row.severity, row.impact) == ("labelled 2, label mismatches 1", "High", "50.00 % of labelled")


def test_repeated_lookup_key_keeps_products_apart(spark):
    products = spark.createDataFrame([("p", "x"), ("q", "x")], "product_id string, product_category_name string")
    lookup = spark.createDataFrame([("x", "b"), ("x", "a")], "product_category_name string, product_category_name_english string")
    assert sorted(map(tuple, od.products_clean(products, lookup).collect())) == [("p", "x", "a"), ("q", "x", "a")]


def test_equal_states_go_to_the_first(spark):
    states = spark.createDataFrame([("B", 5.0, 50.0), ("A", 5.0, 50.0)], "customer_state string, gmv double, pct_gmv double")
    trend = spark.createDataFrame([("2018-01", 3)], "purchase_ym string, orders bigint")
    revenue = spark.createDataFrame([("c", 1.0)], "category_en string, revenue double")
    assert out.concentration(states, trend, revenue).first().top_state == "A"


def test_correlation_of_a_constant_is_null(spark):
    df = spark.range(1000).select(F.lit(12.3).alias("x"), F.lit(1).alias("n"), (F.col("id") % 5).alias("y"))
    got = out.corr_at_child_grain(df.withColumn("inside", F.lit(0.0)), "x", "n", "y", "inside").first()
    assert (got.r, got.n) == (None, 1000)


def test_correlation_with_a_large_offset(spark):
    """Mean 1e9 and deviation 1: power sums would have no digit left."""
    rng = np.random.default_rng(5)
    x = 1e9 + rng.normal(size=2000)
    children = [(float(a), [1e9 + 0.6 * (a - 1e9) + e for e in rng.normal(size=1 + i % 4)]) for i, a in enumerate(x)]
    rows = [(a, len(ys), float(sum(ys)), float(np.var(ys) * len(ys))) for a, ys in children]
    df = spark.createDataFrame(rows, "x double, n bigint, total double, inside double")
    want = np.corrcoef([a - 1e9 for a, ys in children for _ in ys], [y - 1e9 for _, ys in children for y in ys])[0, 1]
    got = out.corr_at_child_grain(df, "x", "n", "total", "inside").first()
    assert abs(got.r - want) < 1e-4 and got.n == sum(len(ys) for _, ys in children)


def test_a_tolerance_is_not_reached(spark):
    measured = spark.createDataFrame([("m", 10.5)], "metric string, value double")
    exact = [quality.Expectation("c", "m", 10.0, 0.5), quality.Expectation("c", "m", 10.0, 0.6)]
    assert [r.ok for r in quality.expectation_register(measured, exact).orderBy("tolerance").collect()] == [False, True]


def test_views(spark, t):
    marketplace.register_marketplace_views(t)
    got = spark.sql(
        "SELECT pc.category_en, sum(i.price) AS revenue FROM items i JOIN product_category pc USING (product_id) GROUP BY 1"
    )
    assert {r.category_en: float(r.revenue) for r in got.collect()}["gaming_pc"] == 100.0
    assert spark.sql("SELECT count(*) FILTER (WHERE delivered) AS n FROM order_grain").first().n == 8


ANSWERS = {
    "row_counts": [
        ("category_translation", 2), ("customers", 12), ("geolocation", 5), ("order_items", 13), ("order_payments", 12),
        ("order_reviews", 11), ("orders", 12), ("products", 6), ("sellers", 2),
    ],
    "missing_timestamps": [(0, 0, 4)],
    "text_coverage": [(11, 7, 10, 4, 36.36)],
    "missing_category": [(1, 6)],
    "unmapped_categories": [("nova_categoria",), ("pc_gamer",)],
    "geo_duplication": [(5, 2, 2.5)],
    "multi_item_orders": [(2, 2)],
    "multi_payment_orders": [(1, 3)],
    "identity_collapse": [(12, 11)],
    "repeat_rate": [(11, 1, 9.09)],
    "invalid_payments": [(1, 1)],
    "referential_integrity": [(1, 1, 1, 1)],
    "childless_orders": [(2, 3)],
    "status_mix": [
        ("delivered", 8, 66.67), ("canceled", 1, 8.33), ("created", 1, 8.33), ("invoiced", 1, 8.33), ("shipped", 1, 8.33),
    ],
    "monthly_orders": [("2018-01", 9, 8, 205.75), ("2018-02", 1, 0, 10.0)],
    "category_pareto": [
        ("gaming_pc", 100.0, 46.57, 46.57, 1), ("toys", 65.0, 30.27, 76.83, 2), ("furniture", 30.5, 14.2, 91.04, 3),
        ("unknown", 19.25, 8.96, 100.0, 4),
    ],
    "categories_for_80pct": [(3, 4)],
    "delivery_stats": [(15.0, 47.9, 62.5, 8)],
    "score_vs_delivery": [(1.0, 65.5, 100.0, 2), (3.0, 5.0, 0.0, 1), (4.0, 7.0, 0.0, 1), (5.0, 13.5, 0.0, 3)],
    "repeat_behaviour": [("1", 10, 90.91, 86.21), ("2", 1, 9.09, 13.79)],
    "state_concentration": [("RJ", 142.5, 66.05, 6), ("SP", 73.25, 33.95, 4)],
    "raw_vs_ready": [(271.75, 216.75, 25.37, 261.25, 230.75)],
}


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_questions(t, name):
    got = rows(QUESTIONS[name](t))
    if name in ANSWERS:
        assert got == ANSWERS[name]
    else:
        assert got


def test_questions_are_complete():
    assert len(QUESTIONS) == 29


def test_dashboard_figures(t):
    kpi = QUESTIONS["dashboard_kpi"](t).first()
    # revenue and freight of all item rows, the orphan included
    assert (kpi.gmv, kpi.freight, kpi.net_revenue_delivered) == (216.75, 21.01, 198.5)
    assert (kpi.total_orders, kpi.delivered_orders, kpi.unique_customers) == (12, 8, 11)
    assert (kpi.aov_net, kpi.median_delivery_days) == (24.81, 15.0)
    assert [tuple(r) for r in QUESTIONS["dashboard_score_vs_delivery"](t).collect()] == [
        (score, days, n) for score, days, _, n in ANSWERS["score_vs_delivery"]
    ]
    top = QUESTIONS["payment_mix"](t).first()
    assert (top.payment_type, top.payment_rows, top.pct_rows, top.total_value) == ("debit_card", 1, 8.33, 110.0)


def test_review_sample(t, oc):
    drawn = {r.idx: r for r in review_sample(t["order_reviews"], oc, size=3, gold=2).collect()}
    assert sorted(drawn) == [0, 1, 2] and sum(r.in_gold for r in drawn.values()) == 2
    every = [r for r in review_sample(t["order_reviews"], oc, size=10, gold=2).collect()]
    assert {r.review_id for r in every} == {"r01", "r03", "r05", "r10"}
    texts = {r.review_id: r.text for r in every}
    assert texts["r01"] == 'line one line "two", and more'
    assert {r.review_id: r.delivery_days for r in every}["r10"] is None


def test_label_reports(spark, t, oc, tmp_path):
    sample = review_sample(t["order_reviews"], oc, size=10, gold=2)
    drawn = {r.idx: r for r in sample.collect()}
    lines = ["idx,topic,sentiment"] + [f"{i},other,negative" for i in drawn]
    (tmp_path / "bulk.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "gold.csv").write_text("\n".join(lines[:1] + [f"{i},other,negative" for i in drawn if drawn[i].in_gold]) + "\n")
    bulk = ingest_labels(spark, str(tmp_path / "bulk.csv"), 4)
    gold = ingest_labels(spark, str(tmp_path / "gold.csv"), 2)
    with pytest.raises(ValueError, match="expected 5 unique labels"):
        ingest_labels(spark, str(tmp_path / "bulk.csv"), 5)
    reports = build_labels(sample, bulk, gold, str(tmp_path / "labels"))
    assert sorted(os.listdir(tmp_path / "labels")) == sorted([*reports, "review_classification", "to_label"])
    report = reports["annotator_report"].first()
    assert (report.n, report.topic_kappa, report.joint_agreement) == (2, 1.0, 1.0)
    # scores of the four reviews with text are 2, 1, 4 and 3
    assert report.star_agreement == 0.5
    # their orders took 5, 21.5 and 20 days; the order of the fourth is unknown
    assert rows(reports["topic_breakdown"]) == [("other", 4, 15.5, 2.5, 100.0)]
    assert {r.label: r.recall for r in reports["topic_recall"].collect()}["other"] == 1.0


def test_audit_reads_order_rows_once(t):
    """Statuses, payments and scores are read for the row per order alone, before the report."""
    text = audit.audit_metrics(t)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any(c in r for r in read for c in ("review_score", "payment_value", "order_status")), read
    assert read.count("customer_id:string") <= 2  # persons with several orders; ids of customers


def test_reports_leave_customers_and_unused_children_alone(t):
    for name in ("monthly_orders", "delivery_stats", "score_vs_delivery", "delivery_score_correlation"):
        text = QUESTIONS[name](t)._jdf.queryExecution().executedPlan().toString()
        assert "customer_unique_id" not in text and "payment_value" not in text, name
    text = QUESTIONS["childless_orders"](t)._jdf.queryExecution().executedPlan().toString()
    assert "product_id" not in text and "review" not in text
