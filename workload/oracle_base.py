"""Shared pieces of the oracle SQL: canonical lines, windows, months."""

from __future__ import annotations

from typing import NamedTuple


class Source(NamedTuple):
    """``cte`` defines ``o``; ``key`` is the store column of the output, or nothing."""

    cte: str
    key: str


def r(x: str) -> str:
    """Output form of a number: double, 6 places, no negative zero."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


def lines(product: bool = False, store: bool = False, guests: bool = False, returns: bool = False) -> Source:
    sign = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END *" if returns else ""
    customer = "CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END" if guests else "o_custkey"
    price, rate = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_discount AS DECIMAL(4,2))"
    extra = joins = ""
    if product:
        extra += """, p_name AS product_name, p_brand AS category,
            CAST(CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(12,2)) * 2.1 AS DECIMAL(18,4)) AS cost"""
        joins += " JOIN part ON l_partkey = p_partkey"
    if store:
        joins += " JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    cte = f"""o AS (SELECT {'n_name' if store else "'all'"} AS store_id, l_orderkey AS order_id, o_orderdate AS order_date,
        CAST(o_orderdate AS DATE) AS day, {customer} AS customer_id, CAST(l_partkey AS VARCHAR) AS sku,
        CAST({sign} {price} * (1 - {rate}) AS DECIMAL(18,4)) AS amount,
        CAST({price} * {rate} AS DECIMAL(18,4)) AS discount {extra}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey {joins})"""
    return Source(cte, "store_id," if store else "")


def edges(with_product: bool = False, with_order: bool = False) -> Source:
    """Lines of which some stores are odd; only those with a product or an order if asked."""
    base = lines(store=True)
    wanted = [c for c, yes in (("sku IS NOT NULL", with_product), ("order_id IS NOT NULL", with_order)) if yes]
    cte = f"""whole AS ({base.cte.removeprefix('o AS (')},
    odd AS (SELECT store_id, CASE WHEN store_id = 'FRANCE' AND order_id % 3 = 0 THEN NULL ELSE order_id END AS order_id,
        CASE WHEN store_id = 'EGYPT' THEN TIMESTAMP '1997-05-05' ELSE order_date END AS order_date,
        CASE WHEN store_id = 'EGYPT' THEN DATE '1997-05-05' ELSE day END AS day,
        CASE WHEN store_id = 'GERMANY' THEN 7 ELSE customer_id END AS customer_id,
        CASE WHEN store_id = 'ALGERIA' THEN '1' WHEN store_id = 'ARGENTINA' THEN CAST(CAST(sku AS BIGINT) % 2 AS VARCHAR)
            WHEN store_id = 'BRAZIL' THEN CAST(CAST(sku AS BIGINT) % 3 AS VARCHAR)
            WHEN store_id = 'ETHIOPIA' AND CAST(sku AS BIGINT) % 2 = 0 THEN NULL ELSE sku END AS sku,
        CASE WHEN store_id = 'CANADA' THEN 0 ELSE amount END AS amount, CASE WHEN store_id = 'CANADA' THEN 0 ELSE discount END AS discount FROM whole),
    o AS (SELECT * FROM odd WHERE {' AND '.join(wanted) or 'true'})"""
    return Source(cte, base.key)


def named() -> Source:
    """Lines whose products go by name."""
    base = lines(product=True)
    return Source(f"whole AS ({base.cte.removeprefix('o AS (')}, o AS (SELECT * REPLACE (product_name AS sku) FROM whole)", "")


def purchases() -> Source:
    return Source(
        """o AS (SELECT 'all' AS store_id, event_id AS order_id, ts AS order_date, CAST(ts AS DATE) AS day, user_id AS customer_id,
        CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS amount FROM events WHERE event_type = 'purchase')""",
        "",
    )


def query(src: Source, parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join([src.cte, *parts]) + "\n" + select


def refs(ref: str | None = None) -> str:
    day = f"DATE '{ref}'" if ref else "max(day)"
    return f"refs AS (SELECT store_id, {day} AS ref FROM o GROUP BY store_id)"


def windows() -> str:
    return """win AS (SELECT store_id, period, side, label, ref - oldest AS ps, ref - newest AS pe FROM refs,
        (VALUES ('30d', 'current', 'Past 30 Days', 0, 29), ('30d', 'prior', 'Prior 30 Days', 30, 59),
            ('90d', 'current', 'Past 90 Days', 0, 89), ('90d', 'prior', 'Prior 90 Days', 90, 179),
            ('365d', 'current', 'Past 365 Days', 0, 364), ('365d', 'prior', 'Prior 365 Days', 365, 729)
        ) AS w(period, side, label, newest, oldest))"""


CUSTOMER_FIRST = """firsts AS (SELECT store_id, customer_id, min(day) AS fd FROM o WHERE customer_id IS NOT NULL GROUP BY 1, 2)"""

SUMMARY_COLUMNS = [
    ("revenue", "v"),
    ("orders", "n"),
    ("aov", "v"),
    ("customers", "n"),
    ("new_customers", "n"),
    ("returning_customers", "n"),
    ("new_customer_revenue", "v"),
    ("returning_customer_revenue", "v"),
    ("new_customer_aov", "v"),
    ("returning_customer_aov", "v"),
    ("avg_discount_rate", "v"),
]


def summary() -> str:
    return """sides AS (
    SELECT w.store_id, w.period, w.side, x.order_id, x.customer_id, x.amount, x.discount,
        coalesce(f.fd BETWEEN w.ps AND w.pe, false) AS is_new
    FROM win w JOIN o x ON x.store_id = w.store_id AND x.day BETWEEN w.ps AND w.pe
    LEFT JOIN firsts f ON f.store_id = x.store_id AND f.customer_id = x.customer_id),
summ AS (
    SELECT store_id, period, side,
        CAST(sum(amount) AS DOUBLE) AS revenue,
        count(DISTINCT order_id) AS orders,
        CAST(sum(amount) AS DOUBLE) / nullif(count(DISTINCT order_id), 0) AS aov,
        count(DISTINCT customer_id) AS customers,
        count(DISTINCT customer_id) FILTER (is_new) AS new_customers,
        count(DISTINCT customer_id) - count(DISTINCT customer_id) FILTER (is_new) AS returning_customers,
        coalesce(CAST(sum(amount) FILTER (is_new) AS DOUBLE), 0) AS new_customer_revenue,
        coalesce(CAST(sum(amount) FILTER (NOT is_new) AS DOUBLE), 0) AS returning_customer_revenue,
        coalesce(CAST(sum(amount) FILTER (is_new) AS DOUBLE) / nullif(count(DISTINCT order_id) FILTER (is_new), 0), 0)
            AS new_customer_aov,
        coalesce(CAST(sum(amount) FILTER (NOT is_new) AS DOUBLE) / nullif(count(DISTINCT order_id) FILTER (NOT is_new), 0), 0)
            AS returning_customer_aov,
        coalesce(CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount + discount) AS DOUBLE), 0), 0) AS avg_discount_rate
    FROM sides GROUP BY 1, 2, 3)"""


COVERAGE = """spans AS (SELECT store_id, CAST(date_sub('day', min(order_date), max(order_date)) AS BIGINT) AS span_days FROM o GROUP BY 1)"""

ANNUAL = """annual AS (SELECT store_id, span_days, total_revenue,
        greatest(CASE WHEN span_days > 0 AND span_days < 365 THEN total_revenue * (CAST(365 AS DOUBLE) / span_days)
            ELSE total_revenue END, 0) AS annual_revenue
    FROM spans JOIN (SELECT store_id, CAST(sum(amount) AS DOUBLE) AS total_revenue FROM o GROUP BY 1) USING (store_id))"""

MONTHS = """months AS (SELECT store_id, strftime(day, '%Y-%m') AS month, CAST(sum(amount) AS DOUBLE) AS revenue,
        count(DISTINCT order_id) AS orders, count(DISTINCT day) AS days_with_data, CAST(max(day(last_day(day))) AS BIGINT) AS days_in_month
    FROM o GROUP BY 1, 2)"""

LATEST = """numbered AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month DESC) AS back,
        count(*) OVER (PARTITION BY store_id) AS months FROM months),
lastm AS (SELECT store_id, months, month AS last_month, days_with_data AS last_month_days,
        days_with_data < days_in_month / 2.0 AS partial_last_month FROM numbered WHERE back = 1),
latest AS (
    SELECT l.*, CASE WHEN p.revenue <> 0 THEN c.revenue / p.revenue - 1 END AS mom_growth_latest,
        CASE WHEN p.month IS NOT NULL THEN coalesce(((c.revenue / c.orders) - (p.revenue / p.orders)) / nullif(p.revenue / p.orders, 0), 0)
            END AS aov_change,
        CASE WHEN p.month IS NOT NULL THEN coalesce((c.orders - p.orders) / nullif(CAST(p.orders AS DOUBLE), 0), 0) END AS order_count_change
    FROM lastm l
    LEFT JOIN numbered c ON c.store_id = l.store_id AND c.back = CASE WHEN partial_last_month THEN 2 ELSE 1 END
    LEFT JOIN numbered p ON p.store_id = l.store_id AND p.back = c.back + 1)"""
