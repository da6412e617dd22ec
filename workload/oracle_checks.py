"""Oracle SQL of whole-history KPIs, the 23 checks, and issues, actions and clusters."""

from __future__ import annotations

from workload import expected as rules
from workload.oracle_base import ANNUAL, COVERAGE, CUSTOMER_FIRST, LATEST, MONTHS, Source, lines, query, r

REPEATS = """repeats AS (SELECT store_id, CAST(sum(amount) AS DOUBLE) AS total_revenue,
        CAST(coalesce(sum(amount) FILTER (fd IS NULL OR day <> fd), 0) AS DOUBLE) AS repeat_revenue,
        coalesce(CAST(coalesce(sum(amount) FILTER (fd IS NULL OR day <> fd), 0) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0), 0)
            AS repeat_revenue_share
    FROM o LEFT JOIN firsts USING (store_id, customer_id) GROUP BY store_id)"""

TOP_CUSTOMERS = """topc AS (
    SELECT store_id, max(n) AS customers, max(k) AS top_customers, CAST(sum(v) FILTER (rk <= k) AS DOUBLE) AS top_revenue,
        CAST(sum(v) FILTER (rk <= k) AS DOUBLE) / CAST(max(rev) AS DOUBLE) AS top_share
    FROM (SELECT *, CAST(greatest(1, floor(n * CAST({fraction} AS DOUBLE))) AS BIGINT) AS k FROM (
        SELECT store_id, v, row_number() OVER (PARTITION BY store_id ORDER BY v DESC) AS rk, count(*) OVER (PARTITION BY store_id) AS n
        FROM (SELECT store_id, customer_id, sum(amount) AS v FROM o WHERE customer_id IS NOT NULL GROUP BY 1, 2)))
    JOIN (SELECT store_id, sum(amount) AS rev FROM o GROUP BY 1) USING (store_id) GROUP BY store_id)"""

TOP_PRODUCTS = """topp AS (
    SELECT store_id, max(n) AS products, max(k) AS top_products, CAST(sum(v) FILTER (rk <= k) AS DOUBLE) AS top_revenue,
        sum(v) AS total, CAST(sum(v) FILTER (rk <= k) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS top_share
    FROM (SELECT *, CAST(greatest(1, floor(n * CAST(0.2 AS DOUBLE))) AS BIGINT) AS k FROM (
        SELECT store_id, v, row_number() OVER (PARTITION BY store_id ORDER BY v DESC) AS rk, count(*) OVER (PARTITION BY store_id) AS n
        FROM (SELECT store_id, sku, sum(amount) AS v FROM o GROUP BY 1, 2))) GROUP BY store_id)"""

DAILY = """daily AS (SELECT store_id, count(*) AS days, avg(v) AS mean_revenue, stddev_samp(v) / avg(v) AS daily_revenue_cv
    FROM (SELECT store_id, day, CAST(sum(amount) AS DOUBLE) AS v FROM o GROUP BY 1, 2) GROUP BY 1)"""

RATES = """rates AS (SELECT store_id, count(*) AS customers, count(*) FILTER (n >= 2) AS repeat_customers,
        count(*) FILTER (n >= 2) / CAST(count(*) AS DOUBLE) AS repeat_purchase_rate
    FROM (SELECT store_id, customer_id, count(DISTINCT order_id) AS n FROM o WHERE customer_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""

GAPS = """gaps AS (SELECT store_id, count(m) AS customers_with_gaps, avg(m) AS avg_purchase_interval_days FROM (
    SELECT store_id, customer_id, avg(CAST(gap AS DOUBLE)) AS m FROM (
        SELECT store_id, customer_id, date_sub('day', lag(order_date) OVER (PARTITION BY store_id, customer_id ORDER BY order_date),
            order_date) AS gap FROM o WHERE customer_id IS NOT NULL) GROUP BY 1, 2) GROUP BY 1)"""

RFM_BASE = """rfm_base AS (SELECT store_id, customer_id, CAST(date_sub('day', max(order_date), newest) AS BIGINT) AS recency_days,
        count(DISTINCT order_id) AS frequency, CAST(sum(amount) AS DOUBLE) AS monetary
    FROM o JOIN (SELECT store_id, max(order_date) AS newest FROM o GROUP BY 1) USING (store_id)
    WHERE customer_id IS NOT NULL GROUP BY store_id, customer_id, newest)"""

RFM = """edges AS (SELECT store_id, list_sort(list_distinct(list_transform(
        quantile_cont(CAST(recency_days AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: round(x, 9)))) AS e
    FROM rfm_base GROUP BY 1),
ranks AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY frequency, customer_id) AS fr,
        row_number() OVER (PARTITION BY store_id ORDER BY monetary, customer_id) AS mr,
        count(*) OVER (PARTITION BY store_id) AS n FROM rfm_base),
scores AS (SELECT store_id, customer_id, recency_days, frequency, monetary,
        CASE WHEN len(e) >= 2 THEN CAST(5 - greatest(len(list_filter(e, lambda x: x < recency_days)) - 1, 0) AS BIGINT) END AS r_score,
        CASE WHEN n > 1 THEN CAST(greatest(1, ceil(CAST(5 AS DOUBLE) * (fr - 1) / (n - 1))) AS BIGINT) END AS f_score,
        CASE WHEN n > 1 THEN CAST(greatest(1, ceil(CAST(5 AS DOUBLE) * (mr - 1) / (n - 1))) AS BIGINT) END AS m_score
    FROM ranks JOIN edges USING (store_id)),
rfm AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal'
        WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
        WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost' ELSE 'Potential' END AS segment FROM scores)"""

CONVERTING = """conv AS (SELECT store_id, count(*) AS products, count(*) FILTER (v > 0) AS converting,
        count(*) FILTER (v > 0) / CAST(count(*) AS DOUBLE) AS converting_rate
    FROM (SELECT store_id, sku, sum(amount) AS v FROM o GROUP BY 1, 2) GROUP BY 1)"""

MULTI = """multi AS (SELECT store_id, count(*) AS orders, count(*) FILTER (n > 1) AS multi_item_orders,
        count(*) FILTER (n > 1) / CAST(count(*) AS DOUBLE) AS multi_item_rate
    FROM (SELECT store_id, order_id, count(DISTINCT sku) AS n FROM o GROUP BY 1, 2) GROUP BY 1)"""

STAGES = """pm AS (SELECT store_id, sku, date_trunc('month', day) AS m, CAST(sum(amount) AS DOUBLE) AS v FROM o GROUP BY 1, 2, 3),
pmr AS (SELECT *, row_number() OVER (PARTITION BY store_id, sku ORDER BY m DESC) AS back FROM pm),
rel AS (SELECT store_id, sku, sum(v) AS total_revenue, count(*) AS months_active,
        round(coalesce(regr_slope(v, -back) FILTER (back <= 3) / nullif(avg(v) FILTER (back <= 3), 0), 0), 12) AS rs FROM pmr GROUP BY 1, 2),
stages AS (SELECT store_id, sku AS product, total_revenue, months_active, CASE WHEN months_active < 2 THEN 'Launch'
        WHEN rs > 0.1 THEN 'Growth' WHEN rs < -0.1 THEN 'Decline' ELSE 'Mature' END AS lifecycle_stage FROM rel)"""

TIERS = """prices AS (SELECT store_id, sku, round(CAST(sum(amount) AS DOUBLE) / count(amount), 9) AS p FROM o GROUP BY 1, 2),
tiers AS (SELECT store_id, count(*) AS products, CAST(len(list_distinct(list_transform(
        quantile_cont(p, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 9)))) - 1 AS BIGINT) AS price_tiers FROM prices GROUP BY 1)"""

RATES_BY_MONTH = """drates AS (SELECT store_id, strftime(day, '%Y-%m') AS month,
        coalesce(CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount + discount) AS DOUBLE), 0), 0) AS discount_rate FROM o GROUP BY 1, 2)"""

DEPENDENCY = """slopes AS (SELECT store_id, count(*) AS n, regr_slope(discount_rate, i) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month) - 1 AS i FROM drates) GROUP BY 1),
dep AS (SELECT store_id, coalesce(CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount + discount) AS DOUBLE), 0), 0) AS avg_discount_rate,
        count(*) FILTER (discount > 0) / CAST(count(*) AS DOUBLE) AS discounted_line_ratio,
        any_value(CASE WHEN n < 3 THEN 'stable' WHEN s > 0.005 THEN 'increasing' WHEN s < -0.005 THEN 'decreasing' ELSE 'stable' END)
            AS discount_rate_trend FROM o JOIN slopes USING (store_id) GROUP BY 1)"""

MARGINS = """margins AS (SELECT store_id, category, CAST(sum(amount) AS DOUBLE) AS revenue, CAST(sum(cost) AS DOUBLE) AS cost,
        CAST(sum(amount) - sum(cost) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) AS margin FROM o GROUP BY 1, 2)"""

LARGE = """large AS (SELECT store_id, CAST(max(v) AS DOUBLE) AS largest_order, CAST(max(v) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS largest_order_share
    FROM (SELECT store_id, order_id, sum(amount) AS v FROM o GROUP BY 1, 2) GROUP BY 1 HAVING sum(v) > 0)"""

SHIP = """ot AS (SELECT store_id, order_id, CAST(sum(amount) AS DOUBLE) AS v FROM o GROUP BY 1, 2),
md AS (SELECT store_id, median(v) AS median_order, round_even(median(v) * 1.2, -2) AS t, avg(v) AS aov FROM ot GROUP BY 1),
ship AS (SELECT store_id, count(*) AS orders, max(aov) AS current_aov, max(median_order) AS median_order, max(t) AS suggested_threshold,
        count(*) FILTER (v < t) / CAST(count(*) AS DOUBLE) AS below,
        coalesce((max(t) - avg(v) FILTER (v >= t * CAST(0.8 AS DOUBLE) AND v < t)) / max(aov), 0) AS lift
    FROM ot JOIN md USING (store_id) GROUP BY 1)"""


def pairs(min_support: float) -> str:
    return f"""b AS (SELECT DISTINCT store_id, order_id, sku FROM o),
nb AS (SELECT store_id, count(DISTINCT order_id) AS n, greatest(2, floor(count(DISTINCT order_id) * CAST({min_support} AS DOUBLE))) AS needed
    FROM o GROUP BY 1),
ic AS (SELECT store_id, sku, count(*) AS c FROM b GROUP BY 1, 2),
pc AS (SELECT x.store_id, x.sku AS product_a, y.sku AS product_b, count(*) AS count FROM b x
    JOIN b y ON x.store_id = y.store_id AND x.order_id = y.order_id AND x.sku < y.sku GROUP BY 1, 2, 3),
pairs AS (SELECT pc.store_id, product_a, product_b, count / CAST(n AS DOUBLE) AS support,
        (count / CAST(n AS DOUBLE)) / ((i.c / CAST(n AS DOUBLE)) * (j.c / CAST(n AS DOUBLE))) AS lift, count
    FROM pc JOIN nb USING (store_id) JOIN ic i ON i.store_id = pc.store_id AND i.sku = product_a
    JOIN ic j ON j.store_id = pc.store_id AND j.sku = product_b WHERE count >= needed)"""


def pct(x: str) -> str:
    return f"printf('%.1f%%', {x} * 100)"


def higher(v: str, good: float, fair: float, strict: bool = False) -> str:
    op = ">" if strict else ">="
    return f"CASE WHEN {v} {op} {good} THEN 'pass' WHEN {v} {op} {fair} THEN 'watch' ELSE 'fail' END"


def lower(v: str, good: float, fair: float) -> str:
    return f"CASE WHEN {v} < {good} THEN 'pass' WHEN {v} < {fair} THEN 'watch' ELSE 'fail' END"


SUFFIX = "CASE WHEN partial_last_month THEN ' (partial month excluded)' ELSE '' END"


def check_parts(min_support: float, bare: bool) -> list[str]:
    """CTEs ending in ``checks(store_id, ord, check_id, category, severity, result, message, value, ...)``."""
    base = [
        MONTHS, LATEST, CUSTOMER_FIRST, REPEATS, TOP_CUSTOMERS.replace("{fraction}", "0.1"), DAILY, LARGE, SHIP, RATES, GAPS,
        RFM_BASE, RFM, TOP_PRODUCTS, CONVERTING, MULTI, pairs(min_support), STAGES, TIERS,
    ]
    wide = """repeats JOIN latest USING (store_id) JOIN topc USING (store_id) JOIN daily USING (store_id) JOIN large USING (store_id)
        JOIN ship USING (store_id) JOIN (SELECT store_id, customers AS known, repeat_purchase_rate FROM rates) USING (store_id)
        JOIN gaps USING (store_id)
        JOIN (SELECT store_id, avg(CASE WHEN segment IN ('Champions', 'Loyal') THEN 1.0 ELSE 0.0 END) AS cl,
            avg(CASE WHEN segment = 'At Risk' THEN 1.0 ELSE 0.0 END) AS ar, avg(CASE WHEN segment = 'Lost' THEN 1.0 ELSE 0.0 END) AS lo
            FROM rfm GROUP BY 1) USING (store_id)
        JOIN (SELECT store_id, top_share AS top20 FROM topp) USING (store_id)
        JOIN (SELECT store_id, products, converting, converting_rate FROM conv) USING (store_id)
        JOIN (SELECT store_id, multi_item_rate FROM multi) USING (store_id)
        LEFT JOIN (SELECT store_id, count(*) FILTER (lift > 2) AS lifted FROM pairs GROUP BY 1) USING (store_id)
        JOIN (SELECT store_id, avg(CASE WHEN lifecycle_stage = 'Decline' THEN 1.0 ELSE 0.0 END) AS decline FROM stages GROUP BY 1)
            USING (store_id)
        JOIN (SELECT store_id, price_tiers FROM tiers) USING (store_id)"""
    if not bare:
        base += [RATES_BY_MONTH, DEPENDENCY, MARGINS]
        wide += """ JOIN dep USING (store_id)
            JOIN (SELECT store_id, count(*) FILTER (margin < 0) AS negative FROM margins GROUP BY 1) USING (store_id)"""
    share = pct("repeat_revenue_share")
    ship = f"{pct('lift')} || ' (suggested: ' || format('{{:,}}', CAST(suggested_threshold AS BIGINT)) || ')'"
    lifted = "coalesce(lifted, 0)"
    rows = [
        ("monthly_revenue_trend", "mom_growth_latest", higher("mom_growth_latest", 0, -0.05, True), f"'MoM revenue growth: ' || {pct('mom_growth_latest')} || {SUFFIX}"),
        ("aov_trend", "aov_change", higher("aov_change", -0.05, -0.1, True), f"'AOV MoM change: ' || {pct('aov_change')} || {SUFFIX}"),
        ("order_count_trend", "order_count_change", higher("order_count_change", -0.05, -0.1, True), f"'MoM order count change: ' || {pct('order_count_change')} || {SUFFIX}"),
        ("repeat_customer_revenue_share", "repeat_revenue_share", higher("repeat_revenue_share", 0.3, 0.2), f"'Repeat customer revenue share: ' || {share}"),
        ("revenue_concentration_top10", "topc.top_share", lower("topc.top_share", 0.6, 0.8), f"'Top 10% customer revenue share: ' || {pct('topc.top_share')}"),
        ("avg_discount_rate_trend", "avg_discount_rate", lower("avg_discount_rate", 0.15, 0.25), f"'Average discount rate: ' || {pct('avg_discount_rate')}"),
        ("daily_revenue_volatility", "daily_revenue_cv", lower("daily_revenue_cv", 0.5, 0.8), "'Daily revenue coefficient of variation: ' || printf('%.2f', daily_revenue_cv)"),
        ("large_order_dependency", "largest_order_share", lower("largest_order_share", 0.05, 0.1), f"'Largest order share of revenue: ' || {pct('largest_order_share')}"),
        ("discounted_order_ratio", "discounted_line_ratio", lower("discounted_line_ratio", 0.4, 0.6), f"'Discounted order ratio: ' || {pct('discounted_line_ratio')}"),
        ("discount_depth_trend", None, "CASE WHEN discount_rate_trend IN ('stable', 'decreasing') THEN 'pass' ELSE 'watch' END", "'Discount depth trend: ' || discount_rate_trend"),
        ("category_margin_variance", "negative", "CASE WHEN negative = 0 THEN 'pass' WHEN negative = 1 THEN 'watch' ELSE 'fail' END", "'Categories with negative margin: ' || CAST(negative AS VARCHAR)"),
        ("free_shipping_threshold_effectiveness", "lift", higher("lift", 0.1, 0.05), f"'Free-shipping threshold AOV lift potential: ' || {ship}"),
        ("repeat_purchase_rate", "repeat_purchase_rate", higher("repeat_purchase_rate", 0.25, 0.15), f"'Repeat purchase rate: ' || {pct('repeat_purchase_rate')}"),
        ("days_to_second_purchase", "avg_purchase_interval_days", lower("avg_purchase_interval_days", 60, 90), "'Avg days to 2nd purchase: ' || printf('%.0f', avg_purchase_interval_days)"),
        ("champions_loyal_share", "cl", higher("cl", 0.2, 0.1), f"'Champions + Loyal segment share: ' || {pct('cl')}"),
        ("at_risk_segment_share", "ar", lower("ar", 0.25, 0.35), f"'At-Risk segment share: ' || {pct('ar')}"),
        ("lost_segment_share", "lo", lower("lo", 0.3, 0.45), f"'Lost segment share: ' || {pct('lo')}"),
        ("top20_revenue_concentration", "top20", "CASE WHEN top20 BETWEEN 0.5 AND 0.8 THEN 'pass' WHEN top20 <= 0.9 THEN 'watch' ELSE 'fail' END", f"'Top 20% SKU revenue concentration: ' || {pct('top20')}"),
        ("converting_sku_rate", "converting_rate", higher("converting_rate", 0.7, 0.5), f"'Converting SKU rate: ' || {pct('converting_rate')} || printf(' (%d/%d)', converting, products)"),
        ("multi_item_order_rate", "multi_item_rate", higher("multi_item_rate", 0.25, 0.15), f"'Multi-item order rate: ' || {pct('multi_item_rate')}"),
        ("cross_sell_pair_lift", lifted, higher(lifted, 3, 1), f"'Cross-sell pairs with lift > 2.0: ' || CAST({lifted} AS VARCHAR)"),
        ("lifecycle_stage_distribution", "decline", lower("decline", 0.3, 0.5), f"'Decline-stage products: ' || {pct('decline')}"),
        ("price_tier_distribution", "price_tiers", higher("price_tiers", 3, 2), "'Distinct price tiers: ' || CAST(price_tiers AS VARCHAR)"),
    ]
    # Checks whose value may be missing are graded na then, with their own message.
    missing = {
        "monthly_revenue_trend": "Insufficient data for MoM growth (<2 months)",
        "daily_revenue_volatility": "Insufficient daily data for CV calculation",
        "days_to_second_purchase": "Insufficient data for purchase interval calculation",
    }
    selects = []
    for place, ((check_id, category, severity, limit), (name, value, result, message)) in enumerate(zip(rules.CHECKS, rows), start=1):
        assert check_id == name
        if bare and check_id in ("discounted_order_ratio", "discount_depth_trend", "category_margin_variance"):
            continue
        if bare and check_id == "avg_discount_rate_trend":
            value, result, message = "CAST(NULL AS DOUBLE)", "'na'", "'No discount data available'"
        if check_id in missing:
            result = f"CASE WHEN {value} IS NULL THEN 'na' ELSE {result} END"
            message = f"coalesce({message}, '{missing[check_id]}')"
        textual = value is None
        selects.append(
            f"""SELECT store_id, CAST({place} AS BIGINT) AS ord, '{check_id}' AS check_id, '{category}' AS category,
            '{severity}' AS severity, {result} AS result, {message} AS message,
            {'CAST(NULL AS DOUBLE)' if textual else f'CAST({value} AS DOUBLE)'} AS value,
            {'discount_rate_trend' if textual else 'CAST(NULL AS VARCHAR)'} AS value_text,
            {'CAST(NULL AS DOUBLE)' if textual else f'CAST({limit} AS DOUBLE)'} AS threshold,
            {f"'{limit}'" if textual else 'CAST(NULL AS VARCHAR)'} AS threshold_text FROM {wide}
            {'WHERE aov_change IS NOT NULL' if check_id in ('aov_trend', 'order_count_trend') else ''}"""
        )
    return [*base, "checks AS (" + " UNION ALL ".join(selects) + ")"]


SEVERITY = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"

IMPACT = """impact AS (SELECT checks.*, round_even(CASE WHEN check_id = 'avg_discount_rate_trend'
            THEN annual_revenue * greatest(0, value - 0.12) * 0.5
            ELSE annual_revenue * CAST(CASE severity WHEN 'critical' THEN 0.03 WHEN 'high' THEN 0.015 WHEN 'medium' THEN 0.005 ELSE 0.001 END
                AS DOUBLE) END, 0) AS est,
        CASE WHEN check_id = 'avg_discount_rate_trend' OR severity = 'critical' THEN 'high' WHEN severity = 'high' THEN 'medium'
            ELSE 'low' END AS confidence, annual_revenue
    FROM checks JOIN annual USING (store_id) WHERE result NOT IN ('pass', 'na'))"""

ISSUES = f"""issues AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {SEVERITY},
        CASE WHEN result = 'fail' THEN 0 ELSE 1 END, est DESC, ord) AS rank FROM impact) WHERE rank <= 10)"""


def _values(rows: list[tuple]) -> str:
    def lit(x) -> str:
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


def _clusters() -> str:
    rows = [(i, name, c) for i, (name, ids, *_) in enumerate(rules.CLUSTERS, 1) for c in ids]
    texts = [(i, t, a) for i, (_, _, t, a) in enumerate(rules.CLUSTERS, 1)]
    return f"""members AS (SELECT * FROM (VALUES {_values(rows)}) AS m(cluster_ord, name, check_id)),
texts AS (SELECT * FROM (VALUES {_values(texts)}) AS t(cluster_ord, template, approach)),
hits AS (SELECT c.*, cluster_ord, name FROM checks c JOIN members USING (check_id) WHERE result NOT IN ('pass', 'na')),
clusters AS (SELECT store_id, cluster_ord, name, count(*) AS count,
        list(message ORDER BY {SEVERITY}, CASE WHEN result = 'fail' THEN 0 ELSE 1 END, ord) AS messages
    FROM hits GROUP BY 1, 2, 3)"""


def check_queries(parts: Source, by_parts: Source) -> dict[str, str]:
    support = 0.0001
    full, bare = check_parts(support, False), check_parts(support, True)
    mixed = lines(product=True, guests=True, returns=True)
    cols = f"""ord, check_id, category, severity, result, message, {r('value')} AS value, value_text,
        {r('threshold')} AS threshold, threshold_text FROM checks"""
    annual = [COVERAGE, ANNUAL]
    issue_cols = f"rank, check_id, category, severity, result, message, {r('est')} AS estimated_annual_impact FROM issues"
    actions = ", ".join(f"('{k}', '{v}')" for k, v in rules.ACTIONS.items())
    clusters = """cluster_ord, name, count, array_to_string(messages, ', ') AS related_issues,
        replace(replace(template, '{n}', CAST(count AS VARCHAR)), '{worst}', messages[1]) AS hypothesis, approach
        FROM clusters JOIN texts USING (cluster_ord) WHERE count >= 2"""
    marks = [(i, node, c) for i, (node, ids) in enumerate(rules.MARKERS.items(), 1) for c in ids]
    strict = " UNION ALL ".join(
        f"""SELECT store_id, cluster_ord, name, count(*) AS count FROM hits WHERE name = '{name}' GROUP BY 1, 2, 3
        HAVING count(*) >= {least} """
        + " ".join(
            f"AND count(*) FILTER (check_id IN ({', '.join(chr(39) + c + chr(39) for c in ids)})) >= {need}" for need, ids in groups
        )
        for name, (least, groups) in rules.STRICT_CLUSTERS.items()
    )
    return {
        "health_checks": query(parts, full, f"SELECT {cols}"),
        "health_checks_returns": query(mixed, full, f"SELECT {cols}"),
        "health_checks_bare": query(lines(), bare, f"SELECT {cols}"),
        "health_checks_by_store": query(by_parts, full, f"SELECT store_id, {cols}"),
        "impact_estimates": query(
            mixed, [*full, *annual, IMPACT],
            f"SELECT check_id, {r('est')} AS annual_revenue_impact, confidence, severity, result FROM impact WHERE annual_revenue > 0",
        ),
        "top_issues": query(mixed, [*full, *annual, IMPACT, ISSUES], f"SELECT {issue_cols}"),
        "top_issues_by_store": query(by_parts, [*full, *annual, IMPACT, ISSUES], f"SELECT store_id, {issue_cols}"),
        "action_candidates": query(
            mixed, [*full, *annual, IMPACT, ISSUES],
            f"""SELECT rank, action, check_id AS source_check, severity, {r('est')} AS estimated_annual_impact,
            CASE severity WHEN 'critical' THEN 'this_week' WHEN 'high' THEN 'this_month' ELSE 'this_quarter' END AS timeline
            FROM issues JOIN (VALUES {actions}) AS a(check_id, action) USING (check_id)""",
        ),
        "finding_clusters": query(mixed, [*full, _clusters()], f"SELECT {clusters}"),
        "finding_clusters_by_store": query(by_parts, [*full, _clusters()], f"SELECT store_id, {clusters}"),
        "strict_clusters_by_store": query(
            by_parts, [*full, _clusters()], f"SELECT store_id, cluster_ord, name, count FROM ({strict})"
        ),
        "structural_clusters": _structural(),
        "kpi_markers": query(
            parts, full,
            f"""SELECT node_ord, node, count(*) AS checks, CASE max(CASE result WHEN 'pass' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END)
            WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS marker
            FROM checks JOIN (VALUES {_values(marks)}) AS m(node_ord, node, check_id) USING (check_id) WHERE result <> 'na'
            GROUP BY store_id, 1, 2""",
        ),
    }


def _structural() -> str:
    """Both windows as two stores of one source, so that one set of checks serves both."""
    src = lines(product=True)
    both = f"""all_lines AS ({src.cte.removeprefix('o AS (')},
    o AS (SELECT a.* REPLACE (w.name AS store_id) FROM all_lines a
        JOIN (VALUES ('short', 27), ('long', 89)) AS w(name, oldest) ON a.day BETWEEN DATE '1996-06-30' - oldest AND DATE '1996-06-30')"""
    return query(
        Source(both, ""),
        [*check_parts(0.0001, False), _clusters()],
        """SELECT s.cluster_ord, s.name, s.count AS short_count, l.count AS long_count FROM clusters s JOIN clusters l USING (cluster_ord)
        WHERE s.store_id = 'short' AND l.store_id = 'long' AND s.count >= 2 AND l.count >= 2""",
    )


def benchmark_query(parts: Source) -> str:
    ups = "CASE WHEN v >= {a} THEN 'pass' WHEN v >= {b} THEN 'watch' ELSE 'fail' END"
    downs = "CASE WHEN v <= {a} THEN 'pass' WHEN v <= {b} THEN 'watch' ELSE 'fail' END"
    rows = " UNION ALL ".join(
        f"SELECT '{vertical}' AS vertical, kpi, {r('v')} AS value, {(ups if op == '>=' else downs).format(a=a, b=b)} AS result FROM vals WHERE kpi = '{kpi}'"
        for vertical, kpi, op, a, b in rules.BENCHMARKS
    )
    vals = """vals AS (
        SELECT 'aov' AS kpi, CAST(sum(amount) AS DOUBLE) / count(DISTINCT order_id) AS v FROM o
        UNION ALL SELECT 'discount_rate', CAST(sum(discount) AS DOUBLE) / CAST(sum(amount + discount) AS DOUBLE) FROM o
        UNION ALL SELECT 'gross_margin', CAST(sum(amount) - sum(cost) AS DOUBLE) / CAST(sum(amount) AS DOUBLE) FROM o
        UNION ALL SELECT 'repeat_purchase_rate', repeat_purchase_rate FROM rates)"""
    return query(parts, [RATES, vals], rows)
