"""Independent SQL for every registered query, written for the raw star tables."""

from __future__ import annotations

# The names below are written out here, so that a table or check the tested code forgets is missed.
FIELDS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
MEANING = {
    "r_regionkey": "Region key.", "r_name": "Region name.", "n_nationkey": "Nation key.",
    "n_name": "Nation name; the state of a customer.", "n_regionkey": "Region of the nation.", "c_custkey": "Person key.",
    "c_name": "Customer name.", "c_nationkey": "Nation of the customer.", "c_acctbal": "Account balance.",
    "c_mktsegment": "Market segment.", "s_suppkey": "Seller key.", "s_name": "Seller name.",
    "s_nationkey": "Nation of the seller.", "s_acctbal": "Account balance.", "p_partkey": "Product key.",
    "p_name": "Product name.", "p_brand": "Brand; repeated dimension key.", "p_type": "Type of part, read as a category.",
    "p_size": "Size.", "p_retailprice": "List price.", "o_orderkey": "Key of the order.",
    "o_custkey": "Key of the ordering customer.", "o_orderstatus": "F counts as delivered.", "o_totalprice": "Order total.",
    "o_orderdate": "Time the order was entered; months and recency count from it.",
    "o_orderpriority": "Priority; sets the promised days.", "l_orderkey": "Order of the item.", "l_partkey": "Product of the item.",
    "l_suppkey": "Seller of the item.", "l_linenumber": "Number of the line; not unique within an order.",
    "l_quantity": "Quantity; source of the review score.", "l_extendedprice": "Item price.", "l_discount": "Discount.",
    "l_tax": "Tax share; source of freight.", "l_returnflag": "R marks a review with text.",
    "l_linestatus": "O marks a review with a title.", "l_shipdate": "Shipping time.",
    "event_id": "Key of the event; later events have larger keys.", "ts": "Event time.", "user_id": "Customer of the event.",
    "event_type": "Payment type.", "value": "Payment value.", "props": "Raw properties.",
    "documents.doc_id": "Key of the document.", "documents.text": "Whole text.", "lang": "Language code.",
    "source": "Where the text comes from.", "n_chars": "Length of the text in characters.", "vec_id": "Key of the vector.",
    "embedding": "Components of the vector.", "label": "Cluster the vector was drawn from.", "page_id": "Key of the page.",
    "url": "Address of the page.", "html": "Source of the page.", "item_id": "Key of the passage.",
    "benchmark.text": "Text of the passage.", "labels.doc_id": "Labelled document.", "quality": "Reference label.",
    "toxic": "System label, inverted.", "conv_id": "Conversation of the turn.", "turn": "Place of the turn.",
    "role": "Who speaks.", "conversations.text": "What is said.",
}
DERIVED = {
    "delivery_days": ("double", "days", "Days from order to delivery."),
    "est_delivery_days": ("double", "est_days", "Days from order to promise."),
    "is_late": ("boolean", "is_late", "Delivered after the promise."),
    "has_items": ("boolean", "has_items", "An item row exists."),
    "order_value": ("double", "order_value", "Item prices and freight."),
    "n_items": ("bigint", "coalesce(n_items, 0)", "Item rows."),
    "review_score": ("double", "review_score", "Mean score of the item rows."),
    "purchase_ym": ("string", "ym", "Month of the order."),
}
EXPECTED = [
    ("table sizes", "nations", 25, 0), ("table sizes", "regions", 5, 0), ("unique keys", "order_key_duplicates", 0, 0),
    ("unique keys", "label_key_duplicates", 0, 0), ("complete orders", "missing_order_fields", 0, 0),
    ("referential integrity", "items_orphan_orders", 0, 0), ("referential integrity", "payments_orphan_customers", 0, 0),
    ("referential integrity", "orders_orphan_customers", 0, 0), ("referential integrity", "items_orphan_products", 0, 0),
    ("orders have items", "orders_without_items", 0, 0), ("mean score", "mean_review_score", 3.0, 0.1),
    ("late share", "late_share", 0.42, 0.1), ("payments are positive", "nonpositive_payments", 0, 0), ("unmeasured", "not_measured", 1, 0),
]

LINES = """lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight,
         1 + (CAST(l_quantity AS INTEGER) - 1) // 10 AS score,
         l_returnflag = 'R' AS has_text, l_shipdate AS shipped
  FROM lineitem)"""

CHILD = (
    LINES
    + """, child AS (
  SELECT order_id, sum(price) AS revenue, sum(freight) AS freight, count(item_id) AS n_items,
         count(DISTINCT seller_id) AS n_sellers, avg(score) AS review_score, count(*) AS n_reviews,
         max(CASE WHEN has_text THEN 1 ELSE 0 END) AS review_has_text, max(shipped) AS shipped
  FROM lines GROUP BY order_id)"""
)

GRAIN = (
    CHILD
    + """, base AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_orderdate AS bought,
         CASE WHEN o_orderstatus = 'F' THEN c.shipped END AS arrived,
         o_orderdate + (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 300 WHEN '2' THEN 600 WHEN '3' THEN 900
                        WHEN '4' THEN 1200 WHEN '5' THEN 1500 END) * INTERVAL 1 DAY AS promised,
         c.revenue, c.freight, c.n_items, c.n_sellers, c.review_score, c.n_reviews, c.review_has_text
  FROM orders LEFT JOIN child c ON c.order_id = o_orderkey),
og AS (
  SELECT *, revenue IS NOT NULL AS has_items, order_status = 'F' AS delivered,
         (epoch_us(arrived) - epoch_us(bought)) / 86400000000.0 AS days,
         (epoch_us(promised) - epoch_us(bought)) / 86400000000.0 AS est_days,
         arrived > promised AS is_late, strftime(bought, '%Y-%m') AS ym,
         coalesce(revenue, 0) + coalesce(freight, 0) AS order_value
  FROM base)"""
)

CUSTOMERS = """people AS (SELECT c_custkey AS customer_id, n_name AS state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

PAYMENTS = """pay AS (SELECT user_id AS customer_id, event_id AS seq, event_type AS ptype, hour(ts) AS inst,
  CAST(value AS DECIMAL(12,2)) AS paid FROM events)"""

CATEGORY = """cat AS (SELECT p_partkey AS product_id, p_type AS product_category_name,
  CASE p_type WHEN 'STANDARD' THEN 'standard' WHEN 'PROMO' THEN 'promotional' WHEN 'LARGE' THEN 'large_goods'
       WHEN 'SMALL' THEN 'small_goods' WHEN 'MEDIUM' THEN 'medium_goods' ELSE 'unknown' END AS category_en
  FROM part)"""

REVENUE = (
    LINES
    + ", "
    + CATEGORY
    + """, rev AS (SELECT category_en, sum(price) AS revenue
  FROM lines JOIN cat USING (product_id) GROUP BY 1)"""
)

# literal three-way join of customers, their orders and all their events
NAIVE = """naive AS (SELECT c_custkey AS customer_id, o_orderkey, event_id,
  CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(value AS DECIMAL(12,2)) AS paid
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN events ON user_id = c_custkey),
tot AS (SELECT count(*) AS naive_rows, sum(price) AS np, sum(paid) AS nc, count(DISTINCT customer_id) AS nk FROM naive),
good AS (SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS ready_rows,
  (SELECT sum(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders JOIN customer ON c_custkey = o_custkey) AS gp,
  (SELECT sum(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders) AS ap,
  (SELECT sum(CAST(value AS DECIMAL(12,2))) FROM events) AS gc)"""

RFM = (
    GRAIN
    + """, person AS (
  SELECT customer_id, max(bought) AS last_bought, count(DISTINCT order_id) AS frequency, sum(order_value) AS monetary
  FROM og GROUP BY 1),
aged AS (
  SELECT *, CAST(floor((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(last_bought)) / 86400000000.0) AS BIGINT)
         AS recency_days, count(*) OVER () AS n FROM person),
placed AS (
  SELECT *, row_number() OVER (ORDER BY recency_days, customer_id) AS rr,
         row_number() OVER (ORDER BY monetary, customer_id) AS mr FROM aged),
binned AS (
  SELECT *, 6 - greatest(1, CAST(ceil(5.0 * (rr - 1) / greatest(n - 1, 1)) AS INTEGER)) AS r_bin,
         greatest(1, CAST(ceil(5.0 * (mr - 1) / greatest(n - 1, 1)) AS INTEGER)) AS m_bin FROM placed),
rfm AS (
  SELECT customer_id AS customer_unique_id, recency_days, frequency, CAST(monetary AS DOUBLE) AS monetary,
         r_bin AS "R_score", m_bin AS "M_score", frequency >= 12 AS is_repeat,
         CASE WHEN frequency >= 12 THEN 'Repeat (Loyal/Champion)'
              WHEN r_bin >= 4 AND m_bin >= 4 THEN 'New high-value'
              WHEN r_bin >= 4 THEN 'New / recent'
              WHEN r_bin <= 2 AND m_bin >= 4 THEN 'Dormant high-value'
              WHEN r_bin <= 2 THEN 'Dormant' ELSE 'Mid one-time' END AS segment
  FROM binned)"""
)

TREND = """trend AS (SELECT ym AS purchase_ym, count(DISTINCT order_id) AS orders,
  count(DISTINCT order_id) FILTER (WHERE delivered) AS delivered_orders,
  CAST(round(sum(revenue), 2) AS DOUBLE) AS gmv FROM og WHERE revenue IS NOT NULL GROUP BY 1)"""

STATES = (
    CUSTOMERS
    + """, st AS (SELECT state AS customer_state, round(sum(revenue), 2) AS g, count(DISTINCT order_id) AS orders,
  count(DISTINCT og.customer_id) AS customers
  FROM og JOIN people ON people.customer_id = og.customer_id WHERE revenue IS NOT NULL GROUP BY 1),
states AS (SELECT customer_state, CAST(g AS DOUBLE) AS gmv, orders, customers,
  round(100.0 * CAST(g AS DOUBLE) / CAST(sum(g) OVER () AS DOUBLE), 2) AS pct_gmv FROM st)"""
)

CLASSIFIED = """cl AS (SELECT l.doc_id, d.lang AS topic, d.n_chars / 1000.0 AS delivery_days,
  least(5, 1 + d.n_chars // 1000) AS review_score,
  CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS reference,
  CASE WHEN 1 - toxic = 1 THEN 'good' ELSE 'poor' END AS system,
  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM labels l JOIN documents d USING (doc_id)),
cs AS (SELECT *, CASE WHEN review_score >= 4 THEN 'positive' WHEN review_score = 3 THEN 'neutral' ELSE 'negative' END AS stars
  FROM cl)"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}) / CAST({n} AS DOUBLE)"
    centre = f"({p} + 3.8416 / (2.0 * {n}))"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))"
    den = f"(1 + 3.8416 / {n})"
    return (
        f"round(greatest(0.0, ({centre} - {half}) / {den}), 6)",
        f"round(least(1.0, ({centre} + {half}) / {den}), 6)",
    )


def _kappa(ref: str, sys: str, labels: list[str]) -> str:
    """CTE body: n, hits, po, pe for one pair of label columns of ``cs``."""
    pe = " + ".join(
        f"(avg(CASE WHEN {ref} = '{x}' THEN 1.0 ELSE 0.0 END) * avg(CASE WHEN {sys} = '{x}' THEN 1.0 ELSE 0.0 END))"
        for x in labels
    )
    return (
        f"SELECT count(*) AS n, count(*) FILTER (WHERE {ref} = {sys}) AS hits, "
        f"avg(CASE WHEN {ref} = {sys} THEN 1.0 ELSE 0.0 END) AS po, {pe} AS pe FROM cs"
    )


_KAPPA_EXPR = "round(CASE WHEN {a}.pe = 1 THEN 1.0 ELSE ({a}.po - {a}.pe) / (1 - {a}.pe) END, 6)"

SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CLEAN_TEXT = f"trim(regexp_replace(text, '{SPACES}', ' ', 'g'))"

SAMPLE = f"""drawn AS (SELECT row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS idx, doc_id, n_chars,
  {CLEAN_TEXT} AS text FROM documents WHERE text IS NOT NULL),
flagged AS (SELECT idx, doc_id, n_chars, text,
  CASE WHEN row_number() OVER (ORDER BY md5('43:' || idx), idx) <= 200 THEN 1 ELSE 0 END AS in_gold
  FROM drawn WHERE idx < 1000)"""

_ORPHAN_SQL = {
    "items_orphan_orders": "SELECT count(*) FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL",
    "payments_orphan_customers": "SELECT count(*) FROM events LEFT JOIN customer ON c_custkey = user_id WHERE c_custkey IS NULL",
    "orders_orphan_customers": "SELECT count(*) FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL",
    "items_orphan_products": "SELECT count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL",
}
_CHILDLESS_SQL = {
    "orders_without_items": "SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "customers_without_payments": "SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)",
    "customers_without_orders": "SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "products_without_items": "SELECT count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
}


def _scalars(parts: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"({sql}) AS {name}" for name, sql in parts.items())


def _null_rows(table: str, fields: list[tuple[str, str]], source: str | None = None) -> list[str]:
    return [
        f"SELECT '{table}' AS tbl, '{f}' AS field, count(*) AS rows, count(*) - count({e}) AS missing, "
        f"round(100.0 * (count(*) - count({e})) / nullif(count(*), 0), 2) AS missing_pct FROM {source or table}"
        for f, e in fields
    ]


def _null_profile(extra: list[str] = ()) -> str:
    rows = [row for table, fields in FIELDS.items() for row in _null_rows(table, [(f, f) for f in fields.split()])]
    return " UNION ALL ".join([*rows, *extra])


def _value_text(expression: str) -> str:
    """Text of a value by its type, which SQL knows only when it runs."""
    return (
        f"CASE WHEN ({expression}) IS NULL THEN NULL WHEN typeof({expression}) IN ('DOUBLE', 'FLOAT') OR typeof({expression}) LIKE 'DECIMAL%' THEN "
        f"CAST(TRY_CAST(TRY_CAST({expression} AS DOUBLE)::VARCHAR AS DECIMAL(38,6)) AS VARCHAR) WHEN typeof({expression}) LIKE 'TIMESTAMP%' THEN "
        f"substr(({expression})::VARCHAR, 1, 19) WHEN typeof({expression}) LIKE '%[]' THEN "
        f"'array of ' || len(string_split(({expression})::VARCHAR, ',')) ELSE ({expression})::VARCHAR END"
    )


def _field_row(table: str, field: str, expression: str, source: str) -> str:
    return (
        f"SELECT '{table}' AS tbl, '{field}' AS field, count(*) AS rows, "
        f"round(100.0 * (count(*) - count({expression})) / count(*), 2) AS missing_pct, count(DISTINCT {expression}) AS n_distinct, "
        f"arg_min(substr({_value_text(expression)}, 1, 60), md5({_value_text(expression)})) AS example FROM {source}"
    )


def _dictionary() -> str:
    """Types come from DESCRIBE, written as Spark names them."""
    described = " UNION ALL ".join(f"SELECT '{t}' AS tbl, column_name AS field, column_type AS kind FROM (DESCRIBE {t})" for t in FIELDS)
    meaning = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{f}' AS field, '{MEANING.get(f'{t}.{f}') or MEANING[f]}' AS description"
        for t, fields in FIELDS.items()
        for f in fields.split()
    )
    derived = " UNION ALL ".join(
        f"SELECT 'order_grain' AS tbl, '{f}' AS field, '{kind}' AS dtype, '{text}' AS description, 'yes' AS derived"
        for f, (kind, _, text) in DERIVED.items()
    )
    own = [_field_row(t, f, f, t) for t, fields in FIELDS.items() for f in fields.split()]
    profile = " UNION ALL ".join([*own, *[_field_row("order_grain", f, e, "og") for f, (_, e, _) in DERIVED.items()]])
    return (
        f"WITH {GRAIN}, prof AS ({profile}), described AS ({described}), meaning AS ({meaning}), fields AS ("
        "SELECT tbl, field, CASE kind WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
        "WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' ELSE kind END AS dtype, description, 'no' AS derived "
        f"FROM described JOIN meaning USING (tbl, field) UNION ALL {derived}) "
        "SELECT tbl, field, dtype, description, derived, rows, missing_pct, n_distinct, n_distinct < 65536 AS distinct_exact, example "
        "FROM fields JOIN prof USING (tbl, field)"
    )


def _expectations() -> str:
    measured = {
        "nations": "SELECT count(*) FROM nation",
        "regions": "SELECT count(*) FROM region",
        "order_key_duplicates": "SELECT count(*) - count(DISTINCT o_orderkey) FROM orders",
        "label_key_duplicates": "SELECT count(*) - count(DISTINCT doc_id) FROM labels",
        "missing_order_fields": "SELECT "
        + " + ".join(f"(count(*) - count({f}))" for f in FIELDS["orders"].split())
        + " FROM orders",
        **_ORPHAN_SQL,
        "orders_without_items": _CHILDLESS_SQL["orders_without_items"],
        "mean_review_score": "SELECT round(avg(score), 6) FROM lines",
        "late_share": "SELECT round(avg(CAST(is_late AS INTEGER)), 6) FROM og",
        "nonpositive_payments": "SELECT count(*) FILTER (WHERE value <= 0) FROM events",
    }
    values = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, CAST(({sql}) AS DOUBLE) AS actual" for name, sql in measured.items()
    )
    wanted = " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", '{metric}' AS metric, CAST({expected} AS DOUBLE) AS expected, "
        f"CAST({tolerance} AS DOUBLE) AS tolerance"
        for check, metric, expected, tolerance in EXPECTED
    )
    return (
        f"WITH {GRAIN}, measured AS ({values}), wanted AS ({wanted}) "
        "SELECT \"check\", metric, expected, actual, tolerance, coalesce(CASE WHEN tolerance > 0 THEN abs(actual - expected) < tolerance ELSE actual = expected END, FALSE) AS ok "
        "FROM wanted LEFT JOIN measured USING (metric)"
    )


def _dq_register() -> str:
    """Figures, affected rows and their total of each rule; wording and severity follow from them."""
    orphans = " + ".join(f"({x})" for x in _ORPHAN_SQL.values())
    no_items, no_payments = _CHILDLESS_SQL["orders_without_items"], _CHILDLESS_SQL["customers_without_payments"]
    family = "FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)"
    person = "FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)"
    rules = [
        ("DQ-01", "lineitem fan-out", f"SELECT 'multi ' || count(*) FILTER (WHERE n > 1) || ', largest ' || max(n) {family}",
         f"SELECT count(*) FILTER (WHERE n > 1) {family}", f"SELECT count(*) {family}", "parents", "sum children per parent before a join"),
        ("DQ-02", "part duplicate", "SELECT 'brand rows ' || count(*) || ', brands ' || count(DISTINCT p_brand) FROM part",
         "SELECT count(*) - count(DISTINCT p_brand) FROM part", "SELECT count(*) FROM part", "brand rows", "reduce to one row per key"),
        ("DQ-03", "orders identity", f"SELECT 'order ids ' || sum(n) || ', people ' || count(*) || ', repeat ' || count(*) FILTER (WHERE n >= 12) {person}",
         f"SELECT count(*) FILTER (WHERE n >= 12) {person}", f"SELECT count(*) {person}", "people", "count persons instead of ids"),
        ("DQ-04", "lineitem missing", "SELECT 'message ' || count(*) FILTER (WHERE l_returnflag <> 'R') || ', title ' || "
         "count(*) FILTER (WHERE l_linestatus <> 'O') FROM lineitem", "SELECT count(*) FILTER (WHERE l_returnflag <> 'R') FROM lineitem",
         "SELECT count(*) FROM lineitem", "lines", "leave null, never impute"),
        ("DQ-05", "orders missing", "SELECT 'undelivered ' || count(*) FROM orders WHERE o_orderstatus <> 'F'",
         "SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'", "SELECT count(*) FROM orders", "orders", "leave null, never impute"),
        ("DQ-06", "part missing", "SELECT 'uncategorised ' || count(*) FROM part WHERE p_type IS NULL",
         "SELECT count(*) FROM part WHERE p_type IS NULL", "SELECT count(*) FROM part", "brand rows", "leave null, never impute"),
        ("DQ-07", "part unmapped", "SELECT 'unmapped ' || count(DISTINCT p_type) FROM part WHERE p_type NOT IN ('STANDARD', 'PROMO', 'LARGE', 'SMALL')",
         "SELECT count(*) FROM part WHERE p_type NOT IN ('STANDARD', 'PROMO', 'LARGE', 'SMALL')", "SELECT count(*) FROM part", "brand rows",
         "give the value a label"),
        ("DQ-08", "events invalid", "SELECT 'nonpositive payments ' || count(*) FILTER (WHERE value <= 0) || ', undefined ' || "
         "count(*) FILTER (WHERE event_type = 'error') FROM events", "SELECT count(*) FILTER (WHERE value <= 0) FROM events",
         "SELECT count(*) FROM events", "payments", "flag the row"),
        ("DQ-09", "parents childless", f"SELECT 'orders without items ' || ({no_items}) || ', customers without payments ' || ({no_payments})",
         no_items, "SELECT count(*) FROM orders", "orders", "keep the parent without child measures"),
        ("DQ-10", "labels disagreement", "SELECT 'labelled ' || count(*) || ', mismatches ' || count(*) FILTER (WHERE quality <> 1 - toxic) FROM labels",
         "SELECT count(*) FILTER (WHERE quality <> 1 - toxic) FROM labels", "SELECT count(*) FROM labels", "labelled", "publish agreement and kappa"),
        ("RI-00", "children orphan", f"SELECT 'orphans ' || ({orphans})", f"SELECT {orphans}", "SELECT count(*) FROM lineitem", "lines",
         "count, attach to nothing"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT '{i}' AS id, '{area}' AS area, ({text}) AS issue, CAST(({hit}) AS DOUBLE) / nullif(({total}), 0) AS share, "
        f"'{unit}' AS unit, '{treatment}' AS treatment"
        for i, area, text, hit, total, unit, treatment in rules
    )
    return (
        f"WITH r AS ({rows}) SELECT id, area, issue, CASE WHEN share <= 0 THEN 'Info' WHEN share >= 0.2 THEN 'High' "
        "WHEN share >= 0.02 THEN 'Medium' ELSE 'Low' END AS severity, treatment, "
        "format('{:,.2f}', 100 * share) || ' % of ' || unit AS impact, CASE WHEN share > 0 THEN 'Open' ELSE 'Clear' END AS status FROM r"
    )


def _kpi() -> str:
    rows = {
        "GMV (product revenue, BRL)": "SELECT round(sum(revenue), 2) FROM og WHERE revenue IS NOT NULL",
        "Net product revenue, delivered (BRL)": "SELECT round(sum(revenue), 2) FROM og WHERE delivered",
        "Freight (BRL)": "SELECT round(sum(freight), 2) FROM og WHERE revenue IS NOT NULL",
        "Total orders": "SELECT count(*) FROM orders",
        "Delivered orders": "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'",
        "% delivered": "SELECT round(100.0 * count(*) FILTER (WHERE delivered) / count(*), 2) FROM og",
        "AOV net (BRL/delivered order)": "SELECT round(CAST(sum(revenue) AS DOUBLE) / count(*), 2) FROM og WHERE delivered",
        "On-time delivery rate (%)": "SELECT round(100.0 * count(*) FILTER (WHERE NOT is_late) / count(*), 2) FROM og "
        "WHERE arrived IS NOT NULL",
        "Median delivery days": "SELECT round(median(days), 2) FROM og WHERE arrived IS NOT NULL",
        "P90 delivery days": "SELECT round(quantile_cont(days, 0.9), 2) FROM og WHERE arrived IS NOT NULL",
        "Unique customers (customer_unique_id)": "SELECT count(DISTINCT o_custkey) FROM orders",
        "Repeat-customer rate (%)": "SELECT round(100.0 * count(*) FILTER (WHERE n >= 12) / count(*), 2) "
        "FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
        "% reviews with text": "SELECT round(100.0 * count(*) FILTER (WHERE has_text) / count(*), 2) FROM lines",
    }
    return f"WITH {GRAIN} " + " UNION ALL ".join(
        f"SELECT '{label}' AS kpi, CAST(({sql}) AS DOUBLE) AS value" for label, sql in rows.items()
    )


def _agreement() -> str:
    topic_lo, topic_hi = _wilson("t.hits", "t.n")
    sent_lo, sent_hi = _wilson("s.hits", "s.n")
    kt, ks = _KAPPA_EXPR.format(a="t"), _KAPPA_EXPR.format(a="s")
    return f"""WITH {CLASSIFIED}, t AS ({_kappa('reference', 'system', ['good', 'poor'])}),
s AS ({_kappa('stars', 'sentiment', ['negative', 'neutral', 'positive'])}),
j AS (SELECT avg(CASE WHEN reference = system AND stars = sentiment THEN 1.0 ELSE 0.0 END) AS jt,
  avg(CASE WHEN stars = sentiment THEN 1.0 ELSE 0.0 END) AS sa FROM cs)
SELECT t.n AS n, round(t.po, 6) AS topic_agreement, {topic_lo} AS topic_ci_low, {topic_hi} AS topic_ci_high,
  {kt} AS topic_kappa, round(s.po, 6) AS sentiment_agreement, {sent_lo} AS sentiment_ci_low,
  {sent_hi} AS sentiment_ci_high, {ks} AS sentiment_kappa, round(jt, 6) AS joint_agreement,
  round(sa, 6) AS star_agreement,
  CASE WHEN {kt} >= 0.7 AND {ks} >= 0.7 AND sa >= 0.8 THEN 'High'
       WHEN {kt} >= 0.55 AND {ks} >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence
FROM t, s, j"""


def _cohen() -> str:
    lo, hi = _wilson("t.hits", "t.n")
    return (
        f"WITH {CLASSIFIED}, t AS ({_kappa('reference', 'system', ['good', 'poor'])}) SELECT t.n AS n, t.hits AS hits, "
        f"round(t.po, 6) AS agreement, {lo} AS ci_low, {hi} AS ci_high, {_KAPPA_EXPR.format(a='t')} AS kappa FROM t"
    )


def _fixed_rows(column: str, labels: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS {column}" for x in labels)


def _external() -> str:
    lo, hi = _wilson("hits", "n")
    return f"""WITH {CLASSIFIED}, g AS (
  SELECT sentiment, count(*) AS n, sum(review_score) AS sc, count(*) FILTER (WHERE sentiment = stars) AS hits FROM cs GROUP BY 1
  UNION ALL SELECT 'all', count(*), sum(review_score), count(*) FILTER (WHERE sentiment = stars) FROM cs)
SELECT sentiment, round(sc / CAST(n AS DOUBLE), 4) AS mean_score, n, round(hits / CAST(n AS DOUBLE), 6) AS agreement,
  {lo} AS ci_low, {hi} AS ci_high FROM g"""


def _wilson_query() -> str:
    lo, hi = _wilson("hits", "n")
    return f"""WITH {CLASSIFIED}, g AS (SELECT topic, count(*) AS n, count(*) FILTER (WHERE reference = system) AS hits
  FROM cs GROUP BY 1) SELECT topic, hits, n, round(hits / CAST(n AS DOUBLE), 6) AS rate, {lo} AS ci_low, {hi} AS ci_high FROM g"""


LANGS = ["en", "de", "fr", "es", "pt"]

ORACLE: dict[str, str] = {
    "src_csv_roundtrip": "SELECT * FROM orders",
    "src_csv_multiline": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "parse_ts_coerce": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS parsed FROM orders",
    "item_grain": f"WITH {CHILD} SELECT order_id, CAST(revenue AS DOUBLE) AS order_product_revenue, "
    "CAST(freight AS DOUBLE) AS order_freight, n_items, n_sellers FROM child",
    "payment_grain": f"WITH {PAYMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id "
    "ORDER BY paid DESC, seq DESC) AS k FROM pay) SELECT customer_id, CAST(sum(paid) AS DOUBLE) AS order_payment_total, "
    "count(*) AS n_payments, max(inst) AS n_installments, max(ptype) FILTER (WHERE k = 1) AS main_payment_type FROM r GROUP BY 1",
    "dominant_payment": f"WITH {PAYMENTS} SELECT customer_id, ptype AS main_payment_type FROM pay "
    "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY paid DESC, seq DESC) = 1",
    "review_grain": f"WITH {CHILD} SELECT order_id, review_score, n_reviews, review_has_text FROM child",
    "orders_clean": f"""WITH {GRAIN}, {CUSTOMERS}, {PAYMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY paid DESC, seq DESC) AS k FROM pay), paid AS (SELECT customer_id, CAST(sum(paid) AS DOUBLE) AS order_payment_total,
  count(*) AS n_payments, max(inst) AS n_installments, max(ptype) FILTER (WHERE k = 1) AS main_payment_type FROM r GROUP BY 1)
  SELECT og.customer_id, order_id, order_status,
  bought AS order_purchase_timestamp, promised AS order_estimated_delivery_date, arrived AS order_delivered_customer_date,
  CAST(coalesce(revenue, 0) AS DOUBLE) AS order_product_revenue, CAST(coalesce(freight, 0) AS DOUBLE) AS order_freight,
  coalesce(n_items, 0) AS n_items, coalesce(n_sellers, 0) AS n_sellers, review_score, n_reviews,
  coalesce(review_has_text, 0) AS review_has_text, og.customer_id AS customer_unique_id, has_items,
  CAST(order_value AS DOUBLE) AS order_value, delivered, days AS delivery_days, est_days AS est_delivery_days, is_late,
  ym AS purchase_ym, CAST(bought AS DATE) AS purchase_date, state AS customer_state,
  order_payment_total, n_payments, n_installments, main_payment_type, order_payment_total IS NOT NULL AS has_payment
  FROM og LEFT JOIN people ON people.customer_id = og.customer_id LEFT JOIN paid ON paid.customer_id = og.customer_id""",
    "order_grain_bucketed": f"""WITH {GRAIN} SELECT order_id, customer_id, CAST(order_value AS DOUBLE) AS order_value, coalesce(n_items, 0) AS n_items,
  coalesce(n_sellers, 0) AS n_sellers, review_score, days AS delivery_days, is_late, ym AS purchase_ym FROM og""",
    "payment_ingest": """SELECT CASE WHEN event_type = 'error' THEN 'unknown_type' WHEN user_id IS NULL THEN 'no_customer'
  WHEN value < 1 OR value IS NULL THEN 'below_one' ELSE 'accepted' END AS outcome, count(*) AS rows,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS rows_observed FROM events GROUP BY 1""",
    "integrity_by_load": """WITH e AS (SELECT * FROM (VALUES (1, TIMESTAMP '0001-01-01', TIMESTAMP '1997-01-01'),
  (2, TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01'), (3, TIMESTAMP '1999-01-01', TIMESTAMP '9999-01-01')) AS v(load, a, b))
SELECT load, (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderdate >= a AND o_orderdate < b
    UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate >= a AND l_shipdate < b)) AS touched,
  CAST((SELECT count(*) FROM lineitem WHERE l_shipdate < b AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < b)) AS BIGINT) AS orphans,
  CAST((SELECT count(*) FROM orders WHERE o_orderdate < b AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < b)) AS BIGINT) AS childless
FROM e""",
    "labelling_text": f"WITH {SAMPLE} SELECT idx, text FROM flagged",
    "delivery_days": f"WITH {GRAIN} SELECT order_id, days AS delivery_days, est_days AS est_delivery_days, is_late FROM og",
    "geo_dedupe": """WITH m AS (SELECT p_brand, sum(CAST(p_retailprice AS DECIMAL(12,2))) AS sp, sum(p_size) AS ss, count(*) AS n
  FROM part GROUP BY 1), ty AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type DESC) = 1),
nm AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name DESC) = 1)
SELECT m.p_brand AS p_brand, round(CAST(sp AS DOUBLE) / m.n, 6) AS avg_price, round(CAST(ss AS DOUBLE) / m.n, 6) AS avg_size,
  p_type AS modal_type, p_name AS modal_name
FROM m JOIN ty ON ty.p_brand = m.p_brand JOIN nm ON nm.p_brand = m.p_brand""",
    "category_map": f"WITH {CATEGORY} SELECT product_id, product_category_name, category_en FROM cat",
    "items_with_category": f"WITH {LINES}, {CATEGORY} SELECT order_id, item_id AS order_item_id, lines.product_id AS product_id, "
    "CAST(price AS DOUBLE) AS price, coalesce(category_en, 'unknown') AS category_en "
    "FROM lines LEFT JOIN cat ON cat.product_id = lines.product_id",
    "fanout_naive": f"WITH {NAIVE} SELECT CAST(naive_rows AS DECIMAL(38,0)) AS naive_rows, CAST(round(np, 2) AS DOUBLE) AS naive_revenue, "
    "CAST(round(nc, 2) AS DOUBLE) AS naive_cash, nk AS naive_orders, round(CAST(np AS DOUBLE) / nk, 2) AS naive_aov FROM tot",
    "fanout_algebraic": f"WITH {NAIVE} SELECT customer_id, count(DISTINCT o_orderkey) AS n_items, "
    "count(DISTINCT event_id) AS n_payments, CAST(count(*) AS DECIMAL(38,0)) AS naive_rows, CAST(sum(price) AS DOUBLE) AS naive_revenue, "
    "CAST(sum(paid) AS DOUBLE) AS naive_cash FROM naive GROUP BY 1",
    "fanout_reconciliation": f"""WITH {NAIVE}, f AS (SELECT *,
  CAST(CAST(round(CAST(naive_rows AS DOUBLE) / ready_rows, 4) AS DECIMAL(20,4)) AS VARCHAR) AS fr,
  CAST(CAST(round(CAST(np AS DOUBLE) / CAST(gp AS DOUBLE), 4) AS DECIMAL(20,4)) AS VARCHAR) || ' payment rows a unit of revenue' AS fp,
  CAST(CAST(round(CAST(nc AS DOUBLE) / CAST(gc AS DOUBLE), 4) AS DECIMAL(20,4)) AS VARCHAR) AS fc,
  CAST(CAST(round(CAST(nk AS DOUBLE) / ready_rows, 4) AS DECIMAL(20,4)) AS VARCHAR) AS fk FROM tot, good), pairs AS (
  SELECT 'Join rows used for revenue' AS metric, CAST(naive_rows AS DOUBLE) AS a, CAST(ready_rows AS DOUBLE) AS b,
    fr || ' joined rows a parent' AS why FROM f
  UNION ALL SELECT 'Product revenue (sum price, BRL)', CAST(round(np, 2) AS DOUBLE), CAST(round(gp, 2) AS DOUBLE), fp FROM f
  UNION ALL SELECT 'Cash collected (sum payment_value, BRL)', CAST(round(nc, 2) AS DOUBLE), CAST(round(gc, 2) AS DOUBLE),
    fc || ' item rows a unit of cash' FROM f
  UNION ALL SELECT 'AOV (BRL per order)', round(CAST(np AS DOUBLE) / nk, 2), round(CAST(gp AS DOUBLE) / ready_rows, 2),
    fp || ', ' || fk || ' of the parents' FROM f)
SELECT metric, a AS naive_raw, b AS decision_ready, why, round(100.0 * (a - b) / b, 2) AS inflation_pct FROM pairs""",
    "fanout_reconciliation_sql": f"""WITH {NAIVE} SELECT CAST(round(np, 2) AS DOUBLE) AS naive_product_revenue,
  CAST(round(ap, 2) AS DOUBLE) AS decision_ready_gmv, round(100.0 * CAST(np - ap AS DOUBLE) / CAST(ap AS DOUBLE), 2) AS revenue_inflation_pct,
  CAST(round(nc, 2) AS DOUBLE) AS naive_cash, CAST(round(gc, 2) AS DOUBLE) AS decision_ready_cash FROM tot, good""",
    "fanout_profile": " UNION ALL ".join(
        f"SELECT '{name}' AS child, count(*) AS multi_parents, max(n) AS max_children "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {key}) WHERE n > 1"
        for name, table, key in [
            ("items_per_order", "lineitem", "l_orderkey"),
            ("payments_per_customer", "events", "user_id"),
            ("orders_per_customer", "orders", "o_custkey"),
            ("nations_per_key", "nation", "n_nationkey"),
        ]
    ),
    "monthly_trend": f"WITH {GRAIN}, {TREND} SELECT * FROM trend",
    "monthly_trend_peak": f"""WITH {GRAIN}, {TREND} SELECT min(purchase_ym) AS first_month, max(purchase_ym) AS last_month,
  count(*) AS months, count(*) FILTER (WHERE orders >= 50) AS supported_months,
  (SELECT purchase_ym FROM trend WHERE orders >= 50 ORDER BY orders DESC, purchase_ym LIMIT 1) AS peak_month,
  max(orders) FILTER (WHERE orders >= 50) AS peak_orders,
  (SELECT purchase_ym FROM trend ORDER BY delivered_orders DESC, purchase_ym LIMIT 1) AS peak_delivered_month,
  max(delivered_orders) AS peak_delivered_orders FROM trend""",
    "delivery_stats": f"""WITH {GRAIN} SELECT round(median(days), 2) AS median_days, round(quantile_cont(days, 0.9), 2) AS p90_days,
  round(100.0 * count(*) FILTER (WHERE is_late = FALSE) / count(*) FILTER (WHERE days IS NOT NULL), 2) AS on_time_rate_pct,
  count(*) FILTER (WHERE days IS NOT NULL) AS delivered_with_dates FROM og""",
    "delivery_distribution": f"""WITH {GRAIN}, b AS (
  SELECT 0 AS lo, 250 AS hi, '0-250' AS bucket UNION ALL SELECT 250, 500, '250-500' UNION ALL SELECT 500, 1000, '500-1000'
  UNION ALL SELECT 1000, 2000, '1000-2000' UNION ALL SELECT 2000, 1000000000, '2000+'),
h AS (SELECT bucket, count(order_id) AS orders FROM b LEFT JOIN og ON days >= lo AND days < hi GROUP BY 1)
SELECT bucket, orders, round(100.0 * orders / nullif(CAST(sum(orders) OVER () AS DOUBLE), 0), 6) AS pct FROM h""",
    "delivery_quantiles_merged": f"""WITH {GRAIN} SELECT substr(ym, 1, 4) AS year, count(DISTINCT ym) AS months,
  count(*) AS n, true AS p50_within, true AS p90_within FROM og WHERE days IS NOT NULL GROUP BY 1""",
    "people_by_month_merged": """WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_custkey AS person, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT ym, lag(ym) OVER (ORDER BY ym) AS before FROM (SELECT DISTINCT ym FROM p)),
r AS (SELECT *, sum(n) OVER (PARTITION BY person ORDER BY ym) AS upto FROM p),
f AS (SELECT person, min(ym) AS first, min(ym) FILTER (WHERE upto > 1) AS again FROM r GROUP BY 1)
SELECT ym AS purchase_ym, CAST((SELECT sum(n) FROM p WHERE p.ym = m.ym) AS BIGINT) AS orders, (SELECT count(*) FROM p WHERE p.ym = m.ym) AS people,
  (SELECT count(*) FROM f WHERE first <= m.ym) AS people_to_date, (SELECT count(*) FROM f WHERE again <= m.ym) AS repeat_to_date,
  (SELECT count(*) FROM p WHERE p.ym = m.ym AND person IN (SELECT person FROM p AS q WHERE q.ym = m.before)) AS also_in_group_before FROM m""",
    "score_vs_delivery": f"""WITH {GRAIN} SELECT CAST(round_even(review_score, 0) AS INTEGER) AS score,
  round(avg(days), 2) AS mean_delivery_days, round(median(days), 2) AS median_delivery_days,
  round(100.0 * avg(CAST(is_late AS INTEGER)), 2) AS late_rate, count(DISTINCT order_id) AS n
  FROM og WHERE arrived IS NOT NULL AND review_score IS NOT NULL GROUP BY 1""",
    "score_vs_delivery_sql": f"""WITH {GRAIN} SELECT round(review_score) AS score, round(avg(days), 2) AS avg_delivery_days,
  round(100.0 * avg(CASE WHEN is_late THEN 1.0 ELSE 0.0 END), 2) AS late_rate_pct, count(*) AS n
  FROM og WHERE days IS NOT NULL AND review_score IS NOT NULL GROUP BY 1""",
    "corr_delivery_score": f"WITH {GRAIN} SELECT round(corr(days, review_score), 4) AS r, count(*) AS n FROM og "
    "WHERE days IS NOT NULL AND review_score IS NOT NULL",
    "signal_delivery_vs_score": f"WITH {GRAIN} SELECT round(corr(days, score), 4) AS r, count(*) AS n "
    "FROM og JOIN lines ON lines.order_id = og.order_id WHERE days IS NOT NULL",
    "score_by_status": f"""WITH {LINES} SELECT round(avg(score), 4) AS mean_all,
  round(avg(score) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_delivered,
  round(avg(score) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'F'), 4) AS mean_not_delivered
  FROM lines LEFT JOIN orders ON o_orderkey = order_id""",
    "signal_value_vs_payment": f"""WITH {PAYMENTS}, v AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS value
  FROM orders GROUP BY 1), p AS (SELECT customer_id AS k, sum(paid) AS paid FROM pay GROUP BY 1)
SELECT round(corr(CAST(value AS DOUBLE), CAST(paid AS DOUBLE)), 4) AS r_value_vs_payment, count(*) AS n_orders FROM v JOIN p ON p.k = v.k""",
    "kpi_summary": _kpi(),
    "dashboard_kpi": f"""WITH {GRAIN} SELECT (SELECT CAST(round(sum(price), 2) AS DOUBLE) FROM lines) AS gmv,
  (SELECT CAST(round(sum(freight), 2) AS DOUBLE) FROM lines) AS freight,
  CAST(round(sum(revenue) FILTER (WHERE delivered), 2) AS DOUBLE) AS net_revenue_delivered, count(*) AS total_orders,
  count(*) FILTER (WHERE delivered) AS delivered_orders, round(100.0 * count(*) FILTER (WHERE delivered) / count(*), 2) AS pct_delivered,
  round(CAST(sum(revenue) FILTER (WHERE delivered) AS DOUBLE) / count(*) FILTER (WHERE delivered), 2) AS aov_net,
  round(100.0 * count(*) FILTER (WHERE is_late = FALSE) / count(days), 2) AS on_time_rate,
  round(median(days), 2) AS median_delivery_days, (SELECT count(DISTINCT c_custkey) FROM customer) AS unique_customers FROM og""",
    "text_coverage": """SELECT count(*) AS reviews, count(*) FILTER (WHERE l_returnflag <> 'R') AS missing_message,
  count(*) FILTER (WHERE l_linestatus <> 'O') AS missing_title, count(*) FILTER (WHERE l_returnflag = 'R') AS with_text,
  round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 2) AS pct_with_text FROM lineitem""",
    "category_pareto": f"""WITH {REVENUE}, r2 AS (SELECT category_en, round(revenue, 2) AS v FROM rev)
SELECT category_en, CAST(v AS DOUBLE) AS revenue, round(100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 6) AS pct,
  round(100.0 * CAST(sum(v) OVER (ORDER BY v DESC, category_en ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 6) AS cum_pct,
  row_number() OVER (ORDER BY v DESC, category_en) AS rank FROM r2""",
    "category_pareto_top15": f"""WITH {REVENUE}, r2 AS (SELECT category_en, CAST(round(revenue, 2) AS DOUBLE) AS revenue,
  round(100.0 * CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 2) AS pct,
  round(100.0 * CAST(sum(revenue) OVER (ORDER BY revenue DESC) AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 2) AS cum_pct,
  row_number() OVER (ORDER BY revenue DESC, category_en) AS rank FROM rev) SELECT * FROM r2 WHERE rank <= 15""",
    "pareto_80": f"""WITH {REVENUE}, r2 AS (SELECT 100.0 * CAST(sum(revenue) OVER (ORDER BY revenue DESC) AS DOUBLE)
  / CAST(sum(revenue) OVER () AS DOUBLE) AS c FROM rev)
SELECT count(*) FILTER (WHERE c <= 80) + 1 AS categories_for_80pct, count(*) AS total_categories FROM r2""",
    "state_revenue": f"WITH {GRAIN}, {STATES} SELECT customer_state, gmv, orders, customers, pct_gmv FROM states",
    "state_top10": f"WITH {GRAIN}, {STATES} SELECT customer_state, gmv, pct_gmv, orders FROM states "
    "ORDER BY gmv DESC, customer_state LIMIT 10",
    "state_top8": f"WITH {GRAIN}, {STATES} SELECT customer_state, gmv, pct_gmv, orders FROM states "
    "ORDER BY gmv DESC, customer_state LIMIT 8",
    "concentration_topn": f"""WITH {GRAIN}, {STATES}, {TREND}, {CATEGORY},
rev AS (SELECT category_en, sum(price) AS revenue FROM lines JOIN cat ON cat.product_id = lines.product_id GROUP BY 1),
r2 AS (SELECT 100.0 * CAST(sum(revenue) OVER (ORDER BY revenue DESC) AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) AS c FROM rev)
SELECT (SELECT round(sum(pct_gmv), 2) FROM (SELECT pct_gmv FROM states ORDER BY gmv DESC, customer_state LIMIT 3)) AS top_states_pct,
  (SELECT customer_state FROM states ORDER BY gmv DESC, customer_state LIMIT 1) AS top_state,
  (SELECT purchase_ym FROM trend ORDER BY orders DESC, purchase_ym LIMIT 1) AS peak_month,
  (SELECT max(orders) FROM trend) AS peak_orders,
  (SELECT count(*) FILTER (WHERE c <= 80) + 1 FROM r2) AS categories_for_80pct, (SELECT count(*) FROM r2) AS total_categories,
  (SELECT count(*) FROM labels JOIN documents ON documents.doc_id = labels.doc_id WHERE toxic = 1) AS negative_reviews""",
    "view_category_revenue": f"""WITH {LINES}, {CATEGORY} SELECT coalesce(category_en, 'unknown') AS category_en, count(*) AS items,
  count(DISTINCT lines.product_id) AS products, CAST(sum(price) AS DOUBLE) AS revenue
  FROM lines LEFT JOIN cat ON cat.product_id = lines.product_id GROUP BY 1""",
    "payment_mix": f"""WITH {PAYMENTS} SELECT ptype AS payment_type, count(*) AS payment_rows, round(avg(inst), 2) AS avg_installments,
  CAST(round(sum(paid), 2) AS DOUBLE) AS total_value,
  round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct_rows FROM pay GROUP BY 1""",
    "rfm_customers": f"WITH {RFM} SELECT * FROM rfm",
    "rfm_segments": f"""WITH {RFM} SELECT segment, count(*) AS customers, round(avg(monetary), 2) AS avg_monetary,
  round(avg(frequency), 3) AS avg_frequency, round(avg(recency_days), 1) AS avg_recency,
  round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct_customers FROM rfm GROUP BY 1""",
    "repeat_summary": f"""WITH {RFM}, b AS (SELECT CASE frequency WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS freq_bucket,
  count(*) AS customers, sum(monetary) AS v FROM person GROUP BY 1)
SELECT freq_bucket, customers, CAST(round(v, 2) AS DOUBLE) AS revenue,
  round(100.0 * customers / CAST(sum(customers) OVER () AS DOUBLE), 2) AS pct_customers,
  round(100.0 * CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 2) AS pct_revenue FROM b""",
    "repeat_rate": """WITH p AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 12) AS repeat_customers,
  round(100.0 * count(*) FILTER (WHERE n >= 12) / count(*), 2) AS repeat_rate_pct FROM p""",
    "identity_collapse": "SELECT count(DISTINCT o_orderkey) AS customer_ids, count(DISTINCT o_custkey) AS unique_customers FROM orders",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{x}' AS tbl, (SELECT count(*) FROM {x}) AS rows, "
        f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {x})) AS cols"
        for x in FIELDS
    ),
    "null_profile": _null_profile(),
    "geo_dup_ratio": "SELECT count(*) AS rows, count(DISTINCT p_brand) AS distinct_keys, "
    "round(count(*) / CAST(count(DISTINCT p_brand) AS DOUBLE), 1) AS rows_per_key FROM part",
    "ref_integrity": _scalars(_ORPHAN_SQL),
    "childless_parents": _scalars(_CHILDLESS_SQL),
    "unmapped_categories": "SELECT DISTINCT p_type AS product_category_name FROM part "
    "WHERE p_type IS NOT NULL AND p_type NOT IN ('STANDARD', 'PROMO', 'LARGE', 'SMALL')",
    "invalid_values": "SELECT count(*) FILTER (WHERE value <= 0) AS nonpositive_value, "
    "count(*) FILTER (WHERE event_type = 'error') AS not_defined_type FROM events",
    "status_mix": "SELECT o_orderstatus AS order_status, count(*) AS orders, "
    "round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS pct FROM orders GROUP BY 1",
    "data_dictionary": _dictionary(),
    "view_state_orders": f"""WITH {GRAIN}, {CUSTOMERS} SELECT state AS customer_state, count(*) AS orders,
  count(*) FILTER (WHERE delivered) AS delivered, CAST(sum(coalesce(revenue, 0)) AS DOUBLE) AS revenue
  FROM og JOIN people ON people.customer_id = og.customer_id GROUP BY state""",
    "expectations": _expectations(),
    "dq_register": _dq_register(),
    "sample_reviews": f"WITH {SAMPLE} SELECT idx, doc_id, n_chars, in_gold, text FROM flagged",
    "review_classification": f"""WITH {SAMPLE}, {CLASSIFIED} SELECT f.doc_id AS doc_id, idx, n_chars, in_gold, system AS topic,
  sentiment, reference AS gold_topic, stars AS gold_sentiment FROM flagged f LEFT JOIN cs ON cs.doc_id = f.doc_id""",
    "normalize_text": f"SELECT doc_id, {CLEAN_TEXT} AS text FROM documents",
    "annotator_agreement": _agreement(),
    "cohen_kappa": _cohen(),
    "confusion_matrix": f"""WITH {CLASSIFIED}, r AS ({_fixed_rows('reference', ['good', 'poor'])})
SELECT r.reference AS reference, count(*) FILTER (WHERE system = 'good') AS good, count(*) FILTER (WHERE system = 'poor') AS poor
FROM r LEFT JOIN cs ON cs.reference = r.reference GROUP BY 1""",
    "class_recall": f"""WITH {CLASSIFIED}, r AS ({_fixed_rows('label', ['good', 'poor', 'unused'])})
SELECT label, count(reference) AS support, round(count(*) FILTER (WHERE reference = system) / nullif(CAST(count(reference) AS DOUBLE), 0), 6)
  AS recall FROM r LEFT JOIN cs ON reference = label GROUP BY 1""",
    "wilson_ci": _wilson_query(),
    "label_distribution": f"WITH {CLASSIFIED}, r AS ({_fixed_rows('label', LANGS)}) "
    "SELECT label, count(topic) AS n FROM r LEFT JOIN cs ON topic = label GROUP BY 1",
    "external_validity": _external(),
    "topic_breakdown": f"""WITH {CLASSIFIED} SELECT topic, count(*) AS n, round(avg(delivery_days), 2) AS avg_delivery_days,
  round(avg(review_score), 2) AS avg_review_score, round(100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS pct_of_negatives
  FROM cs WHERE sentiment = 'negative' GROUP BY 1""",
    "sentiment_by_topic": f"""WITH {CLASSIFIED}, r AS ({_fixed_rows('topic', LANGS)})
SELECT r.topic AS topic, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'positive') AS positive
FROM r LEFT JOIN cs ON cs.topic = r.topic GROUP BY 1""",
    "subgroup_baseline": f"""WITH {CLASSIFIED} SELECT
  round(avg(delivery_days) FILTER (WHERE sentiment = 'negative' AND topic = 'en'), 4) AS days_subgroup,
  round(avg(delivery_days), 4) AS days_base,
  round(avg(review_score) FILTER (WHERE sentiment = 'negative' AND topic = 'en'), 4) AS score_subgroup,
  round(avg(review_score), 4) AS score_base FROM cs""",
}
