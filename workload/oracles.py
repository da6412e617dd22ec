"""SQL that computes the registered queries independently of the library (DuckDB dialect)."""

from __future__ import annotations

from workload import oracle_checks, oracle_review
from workload.oracle_base import (
    ANNUAL,
    COVERAGE,
    CUSTOMER_FIRST,
    LATEST,
    MONTHS,
    SUMMARY_COLUMNS,
    Source,
    edges,
    lines,
    named,
    purchases,
    query,
    r,
    refs,
    summary,
    windows,
)

EARLY = "1996-06-30"
STD = lines()
SHORT = purchases()


def _summary(src: Source, ref=None) -> str:
    cols = ", ".join(
        f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" if kind == "n" else f"{r(f'coalesce({c}, 0)')} AS {c}"
        for c, kind in SUMMARY_COLUMNS
    )
    return query(
        src,
        [refs(ref), windows(), CUSTOMER_FIRST, summary()],
        f"""SELECT {src.key} period, side, label, strftime(ps, '%Y-%m-%d') AS period_start,
            strftime(pe, '%Y-%m-%d') AS period_end, {cols}
        FROM win LEFT JOIN summ USING (store_id, period, side)""",
    )


PAIRED = """paired AS (
    SELECT w.store_id, w.period,
        {cols}
    FROM (SELECT * FROM win LEFT JOIN summ USING (store_id, period, side) WHERE side = 'current') w
    JOIN (SELECT * FROM win LEFT JOIN summ USING (store_id, period, side) WHERE side = 'prior') p
        ON w.store_id = p.store_id AND w.period = p.period)""".format(
    cols=", ".join(
        f"CAST(coalesce(w.{c}, 0) AS DOUBLE) AS c_{c}, CAST(coalesce(p.{c}, 0) AS DOUBLE) AS p_{c}" for c, _ in SUMMARY_COLUMNS
    )
)


def chg(k: str) -> str:
    return f"CASE WHEN p_{k} <> 0 THEN (c_{k} - p_{k}) / abs(p_{k}) WHEN c_{k} = 0 THEN 0.0 END"


def share(k: str) -> str:
    return f"CASE WHEN c_revenue <> 0 THEN c_{k} / c_revenue ELSE 0 END"


DRIVER_SQL = """
    CASE WHEN p_revenue <> 0 THEN round_even((c_aov - p_aov) * c_orders, 2) ELSE 0 END + 0.0 AS aov_effect,
    CASE WHEN p_revenue <> 0 THEN round_even((c_orders - p_orders) * p_aov, 2) ELSE 0 END + 0.0 AS volume_effect,
    CASE WHEN p_revenue <> 0 THEN round_even(c_revenue - p_revenue - (c_orders - p_orders) * p_aov
        - (c_aov - p_aov) * c_orders, 2) ELSE 0 END + 0.0 AS mix_effect"""


def _paired(src: Source, select: str, ref=None, tail: str = "") -> str:
    return query(
        src,
        [refs(ref), windows(), CUSTOMER_FIRST, summary(), PAIRED],
        f"SELECT {src.key} {select} FROM paired {tail}",
    )


def _comparison(src: Source, ref=None) -> str:
    parts = [
        f"SELECT {src.key} period, '{k}' AS kpi, {r(f'c_{k}')} AS current, {r(f'p_{k}')} AS prior, {r(chg(k))} AS change FROM paired"
        for k, _ in SUMMARY_COLUMNS
    ]
    return query(src, [refs(ref), windows(), CUSTOMER_FIRST, summary(), PAIRED], " UNION ALL ".join(parts))


def _block(src: Source, ref=None) -> str:
    cols = ["period"]
    for k in ("revenue", "orders", "aov", "customers"):
        value = f"CAST(c_{k} AS BIGINT)" if k in ("orders", "customers") else r(f"c_{k}")
        cols += [f"{value} AS {k}", f"{r(chg(k))} AS {k}_change"]
    for s in ("new", "returning"):
        cols += [
            f"{r(f'c_{s}_customer_revenue')} AS {s}_customer_revenue",
            f"{r(share(f'{s}_customer_revenue'))} AS {s}_customer_revenue_share",
            f"CAST(c_{s}_customers AS BIGINT) AS {s}_customers",
            f"{r(chg(f'{s}_customers'))} AS {s}_customers_change",
            f"{r(f'c_{s}_customer_aov')} AS {s}_customer_aov",
        ]
    return _paired(src, ", ".join(cols) + "," + DRIVER_SQL, ref)


def _separate(src: Source, ref=None) -> str:
    """The summary with guests beside the returning customers."""
    split = """split AS (SELECT store_id, period, side,
        sum(amount) FILTER (customer_id IS NULL) AS guest_revenue, count(DISTINCT order_id) FILTER (customer_id IS NULL) AS guest_orders,
        sum(amount) FILTER (customer_id IS NOT NULL AND NOT is_new) AS kept_revenue,
        count(DISTINCT order_id) FILTER (customer_id IS NOT NULL AND NOT is_new) AS kept_orders FROM sides GROUP BY 1, 2, 3)"""
    own = {
        "returning_customer_revenue": "CAST(kept_revenue AS DOUBLE)",
        "returning_customer_aov": "CAST(kept_revenue AS DOUBLE) / nullif(kept_orders, 0)",
    }
    cols = ", ".join(
        f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" if kind == "n" else f"{r(f'coalesce({own.get(c, c)}, 0)')} AS {c}"
        for c, kind in SUMMARY_COLUMNS
    )
    return query(
        src,
        [refs(ref), windows(), CUSTOMER_FIRST, summary(), split],
        f"""SELECT {src.key} period, side, label, strftime(ps, '%Y-%m-%d') AS period_start, strftime(pe, '%Y-%m-%d') AS period_end, {cols},
            {r('coalesce(guest_revenue, 0)')} AS guest_revenue, CAST(coalesce(guest_orders, 0) AS BIGINT) AS guest_orders
        FROM win LEFT JOIN summ USING (store_id, period, side) LEFT JOIN split USING (store_id, period, side)""",
    )


def _mix(src: Source, ref=None) -> str:
    """Volume, mix and AOV effects from the orders and revenue of new and other customers."""
    parts = """seg AS (SELECT w.store_id, w.period, w.side, k.is_new, count(DISTINCT s.order_id) AS n, coalesce(sum(s.amount), 0) AS v
        FROM win w CROSS JOIN (VALUES (true), (false)) AS k(is_new)
        LEFT JOIN sides s ON s.store_id = w.store_id AND s.period = w.period AND s.side = w.side AND s.is_new = k.is_new GROUP BY ALL),
    tot AS (SELECT store_id, period, side, sum(n) AS tn, sum(v) AS tv FROM seg GROUP BY ALL),
    both_sides AS (SELECT a.store_id, a.period, a.n AS n1, CAST(a.v AS DOUBLE) AS v1, b.n AS n0, CAST(b.v AS DOUBLE) AS v0,
            ta.tn AS t1, CAST(ta.tv AS DOUBLE) AS r1, tb.tn AS t0, CAST(tb.tv AS DOUBLE) AS r0
        FROM seg a JOIN seg b ON a.store_id = b.store_id AND a.period = b.period AND a.is_new = b.is_new AND a.side = 'current' AND b.side = 'prior'
        JOIN tot ta ON ta.store_id = a.store_id AND ta.period = a.period AND ta.side = 'current'
        JOIN tot tb ON tb.store_id = a.store_id AND tb.period = a.period AND tb.side = 'prior')"""
    aov = lambda k: f"coalesce(v{k} / nullif(n{k}, 0), 0)"
    has = "min(t0) > 0 AND min(t1) > 0"
    return query(
        src,
        [refs(ref), windows(), CUSTOMER_FIRST, summary(), parts],
        f"""SELECT {src.key} period, {r('min(r1) - min(r0)')} AS revenue_delta,
            CASE WHEN {has} THEN {r('(min(t1) - min(t0)) * (min(r0) / min(t0))')} END AS volume_effect,
            CASE WHEN {has} THEN {r(f'sum(t1 * (n1 / CAST(t1 AS DOUBLE) - n0 / CAST(t0 AS DOUBLE)) * {aov(0)})')} END AS mix_effect,
            CASE WHEN {has} THEN {r(f'sum(n1 * ({aov(1)} - {aov(0)}))')} END AS aov_effect
        FROM both_sides GROUP BY store_id, period""",
    )


SECOND = """placed AS (SELECT store_id, customer_id, order_id, min(order_date) AS t FROM o
        WHERE customer_id IS NOT NULL AND order_id IS NOT NULL GROUP BY ALL),
    ranked AS (SELECT store_id, customer_id, t, row_number() OVER (PARTITION BY store_id, customer_id ORDER BY t) AS k
        FROM (SELECT DISTINCT store_id, customer_id, t FROM placed)),
    gaps AS (SELECT a.store_id, date_sub('day', a.t, b.t) AS gap FROM ranked a
        JOIN ranked b ON a.store_id = b.store_id AND a.customer_id = b.customer_id AND a.k = 1 AND b.k = 2)"""


TREND = """trend AS (
    SELECT x.store_id, strftime(x.day, '%Y-%m') AS month, sum(x.amount) AS revenue,
        count(DISTINCT order_id) AS orders, count(DISTINCT x.customer_id) AS customers,
        count(DISTINCT CASE WHEN fd BETWEEN greatest(date_trunc('month', x.day), ref - 364)
            AND least(last_day(x.day), ref) THEN x.customer_id END) AS new_customers,
        count(DISTINCT x.day) AS days_with_data, max(day(last_day(x.day))) AS month_days
    FROM o x JOIN refs USING (store_id) LEFT JOIN firsts f USING (store_id, customer_id)
    WHERE x.day BETWEEN ref - 364 AND ref
    GROUP BY x.store_id, strftime(x.day, '%Y-%m'))"""


def _trend(src: Source, ref=None) -> str:
    return query(
        src,
        [refs(ref), CUSTOMER_FIRST, TREND],
        f"""SELECT {src.key} month, {r('revenue')} AS revenue, orders, {r('CAST(revenue AS DOUBLE) / nullif(orders, 0)')} AS aov,
            customers, new_customers, customers - new_customers AS returning_customers, days_with_data,
            days_with_data < month_days / 2.0 AS partial
        FROM trend WHERE NOT (orders = 0 AND revenue = 0)""",
    )


def _top_customers(src: Source, fraction: float) -> str:
    return query(
        src,
        [oracle_checks.TOP_CUSTOMERS.replace("{fraction}", str(fraction))],
        f"""SELECT {src.key} customers, top_customers, {r('top_revenue')} AS top_revenue, {r('top_share')} AS top_share FROM topc""",
    )


# How a quoted word and the end of its field look in a CSV line.
QUOTED, BOXED = '""new"""', '""boxed"""'

QUALITY = """SELECT store_id, 'partial_period' AS type, last_month AS period, last_month_days AS days_with_data,
            CAST(NULL AS BIGINT) AS days,
            printf('Latest month (%s) has only %d days of data. MoM comparisons use prior complete months.',
                last_month, last_month_days) AS message
        FROM latest WHERE partial_last_month
        UNION ALL SELECT store_id, 'short_data_span', NULL, NULL, span_days,
            printf('Data spans only %d days. 90d and 365d analyses are unavailable; interpret results with caution.', span_days)
        FROM spans WHERE span_days < 90
        UNION ALL SELECT store_id, 'limited_data_span', NULL, NULL, span_days,
            printf('Data spans %d days (<1 year). 365d analysis may be unavailable; year-over-year comparisons are limited.',
                span_days)
        FROM spans WHERE span_days >= 90 AND span_days < 365"""


def _document(src: Source, period: str | None = None) -> str:
    keyed = src._replace(key="store_id,")
    actions = ", ".join(f"('{k}', '{v}')" for k, v in oracle_checks.rules.ACTIONS.items())
    quality = query(keyed, [COVERAGE, MONTHS, LATEST], QUALITY)
    return oracle_review.document(src, _block(keyed), _trend(keyed), quality, actions, 0.0001, period)


def _one(src: Source, parts: list[str], select: str) -> str:
    return query(src, parts, f"SELECT {src.key} {select}")


def _edges() -> dict[str, str]:
    k = oracle_checks
    odd, sold, placed = edges(), edges(with_product=True), edges(with_order=True)
    # Fewer than four products ask for fewer bins.
    tiers = """prices AS (SELECT store_id, sku, round(CAST(sum(amount) AS DOUBLE) / count(amount), 9) AS p FROM o GROUP BY 1, 2),
        tiers AS (SELECT store_id, count(*) AS products, CASE WHEN count(*) = 1 THEN 1 ELSE CAST(len(list_distinct(list_transform(
            CASE count(*) WHEN 2 THEN quantile_cont(p, [0.0, 0.5, 1.0]) WHEN 3 THEN quantile_cont(p, [0.0, 1.0 / 3, 2.0 / 3, 1.0])
            ELSE quantile_cont(p, [0.0, 0.25, 0.5, 0.75, 1.0]) END, lambda x: round(x, 9)))) - 1 AS BIGINT) END AS price_tiers FROM prices GROUP BY 1)"""
    top = f"products, top_products, {r('top_revenue')} AS top_revenue, {r('top_share')} AS top_share FROM topp WHERE total > 0"
    products = k.TOP_PRODUCTS.replace("/ CAST(sum(v) AS DOUBLE) AS top_share", "/ nullif(CAST(sum(v) AS DOUBLE), 0) AS top_share")
    multi = f"orders, multi_item_orders, {r('multi_item_rate')} AS multi_item_rate FROM multi"
    large = """large AS (SELECT store_id, CAST(max(v) FILTER (order_id IS NOT NULL) AS DOUBLE) AS largest_order,
            CAST(max(v) FILTER (order_id IS NOT NULL) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS largest_order_share
        FROM (SELECT store_id, order_id, sum(amount) AS v FROM o GROUP BY 1, 2) GROUP BY 1 HAVING sum(v) > 0)"""
    rfm = f"""customer_id, recency_days, frequency, {r('monetary')} AS monetary, r_score, f_score, m_score, r_score + f_score + m_score AS rfm_sum, segment FROM rfm"""
    customers = k.TOP_CUSTOMERS.replace("{fraction}", "0.1").replace("/ CAST(max(rev) AS DOUBLE) AS top_share", "/ nullif(CAST(max(rev) AS DOUBLE), 0) AS top_share")
    gaps = f"count(*) AS customers, {r('avg(gap)')} AS avg_days, {r('quantile_cont(gap, 0.5)')} AS median_days FROM gaps GROUP BY store_id"
    meta = f"""strftime(min(day), '%Y-%m-%d') AS data_start, strftime(max(day), '%Y-%m-%d') AS data_end,
        count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
        {r('sum(amount)')} AS total_revenue, 'USD' AS currency,
        'Net sales after discounts, before tax and shipping' AS revenue_definition FROM o GROUP BY store_id"""
    return {
        "edges_price_tiers": _one(sold, [tiers], "products, price_tiers FROM tiers"),
        "edges_top20_share": _one(sold, [products], top),
        "edges_converting_rate": _one(sold, [k.CONVERTING], f"products, converting, {r('converting_rate')} AS converting_rate FROM conv"),
        "edges_multi_item_rate": _one(placed, [k.MULTI], multi),
        "edges_large_order_share": _one(odd, [large], f"{r('largest_order')} AS largest_order, {r('largest_order_share')} AS largest_order_share FROM large"),
        "edges_rfm_scores": _one(odd, [k.RFM_BASE, k.RFM], rfm),
        "edges_repeat_purchase_rate": _one(odd, [k.RATES], f"customers, repeat_customers, {r('repeat_purchase_rate')} AS repeat_purchase_rate FROM rates"),
        "edges_repeat_revenue_share": _one(
            odd, [CUSTOMER_FIRST, k.REPEATS],
            f"{r('total_revenue')} AS total_revenue, {r('repeat_revenue')} AS repeat_revenue, {r('repeat_revenue_share')} AS repeat_revenue_share FROM repeats",
        ),
        "edges_top_decile_share": _one(
            odd, [customers], f"customers, top_customers, {r('top_revenue')} AS top_revenue, {r('coalesce(top_share, 0)')} AS top_share FROM topc"
        ),
        "edges_days_to_second_order": _one(odd, [SECOND], gaps),
        "edges_latest_months": _one(
            odd, [MONTHS, LATEST],
            f"""months, last_month, last_month_days, partial_last_month, {r('mom_growth_latest')} AS mom_growth_latest,
            {r('aov_change')} AS aov_change, {r('order_count_change')} AS order_count_change FROM latest""",
        ),
        "edges_metadata": _one(odd, [], meta),
        "named_price_tiers": _one(named(), [k.TIERS], "products, price_tiers FROM tiers"),
        "named_top20_share": _one(named(), [k.TOP_PRODUCTS], top),
        "named_multi_item_rate": _one(named(), [k.MULTI], multi),
    }


def oracle_sql() -> dict[str, str]:
    by = lines(store=True)
    guests, returns = lines(guests=True), lines(returns=True)
    parts = lines(product=True)
    by_parts = lines(product=True, store=True)
    by_guests, by_returns = lines(store=True, guests=True), lines(store=True, returns=True)
    k = oracle_checks
    out: dict[str, str] = {}

    # Calendar, metadata, coverage
    out["period_windows"] = _one(
        STD, [refs(), windows()],
        "period, side, label, strftime(ps, '%Y-%m-%d') AS period_start, strftime(pe, '%Y-%m-%d') AS period_end FROM win",
    )
    out["month_slices"] = _one(
        STD, [refs()],
        """strftime(m, '%Y-%m') AS month, strftime(greatest(m, ref - 364), '%Y-%m-%d') AS period_start,
            strftime(least(last_day(m), ref), '%Y-%m-%d') AS period_end
        FROM (SELECT store_id, ref, CAST(unnest(generate_series(date_trunc('month', ref - 364), CAST(ref AS TIMESTAMP),
            INTERVAL 1 MONTH)) AS DATE) AS m FROM refs)""",
    )
    meta = f"""strftime(min(day), '%Y-%m-%d') AS data_start, strftime(max(day), '%Y-%m-%d') AS data_end,
        count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
        {r('sum(amount)')} AS total_revenue, 'USD' AS currency,
        'Net sales after discounts, before tax and shipping' AS revenue_definition FROM o GROUP BY store_id"""
    out["metadata"] = _one(STD, [], meta)
    out["metadata_by_store"] = _one(by, [], meta)
    cover = "span_days, span_days >= 45 AS covered_30d, span_days >= 120 AS covered_90d, span_days >= 400 AS covered_365d FROM spans"
    out["data_coverage"] = _one(STD, [COVERAGE], cover)
    out["data_coverage_short"] = _one(SHORT, [COVERAGE], cover)
    quality = f"* EXCLUDE (store_id) FROM ({QUALITY})"
    out["data_quality"] = _one(STD, [COVERAGE, MONTHS, LATEST], quality)
    out["data_quality_short"] = _one(SHORT, [COVERAGE, MONTHS, LATEST], quality)
    annual = f"span_days, {r('total_revenue')} AS total_revenue, {r('annual_revenue')} AS annual_revenue FROM annual"
    out["annual_revenue"] = _one(STD, [COVERAGE, ANNUAL], annual)
    out["annual_revenue_short"] = _one(SHORT, [COVERAGE, ANNUAL], annual)

    trailing = """y AS (SELECT store_id, min(ref) AS ref, sum(amount) FILTER (day BETWEEN ref - 364 AND ref) AS v
        FROM o JOIN refs USING (store_id) GROUP BY store_id)"""
    for name, src, ref in (("trailing_year_revenue", STD, None), ("trailing_year_revenue_by_store", by, EARLY)):
        out[name] = query(
            src,
            [refs(ref), trailing],
            f"SELECT {src.key} strftime(ref, '%Y-%m-%d') AS until, {r('coalesce(v, 0)')} AS trailing_year_revenue FROM y",
        )

    # Period KPIs
    out["period_summary_guests_separate"] = _separate(lines(store=True, guests=True), EARLY)
    out["drivers_mix"] = _mix(STD)
    out["drivers_mix_guests_by_store"] = _mix(lines(store=True, guests=True), EARLY)
    seconds = f"count(*) AS customers, {r('avg(gap)')} AS avg_days, {r('quantile_cont(gap, 0.5)')} AS median_days FROM gaps GROUP BY store_id"
    out["days_to_second_order"] = query(lines(guests=True), [SECOND], f"SELECT {seconds}")
    out["days_to_second_order_short"] = query(SHORT, [SECOND], f"SELECT {seconds}")
    out["days_to_second_order_by_store"] = query(by, [SECOND], f"SELECT store_id, {seconds}")
    discounted = """d AS (SELECT store_id, order_id, max(discount > 0) AS has FROM o WHERE order_id IS NOT NULL GROUP BY ALL)"""
    for name, src in (("discounted_orders", STD), ("discounted_orders_by_store", by)):
        out[name] = query(
            src,
            [discounted],
            f"""SELECT {src.key} count(*) AS orders, count(*) FILTER (has) AS discounted_orders,
                {r('avg(has::INT)')} AS discounted_order_ratio FROM d GROUP BY store_id""",
        )
    out["period_summary"] = _summary(STD)
    out["period_summary_ref1996"] = _summary(STD, EARLY)
    out["period_summary_guests"] = _summary(guests, EARLY)
    out["period_summary_returns"] = _summary(returns, EARLY)
    out["period_summary_by_store"] = _summary(by)
    out["period_comparison"] = _comparison(STD, EARLY)
    out["period_block"] = _block(STD)
    out["period_block_by_store_ref1996"] = _block(by, EARLY)
    out["drivers"] = _paired(STD, f"period, {r('c_revenue - p_revenue')} AS revenue_delta," + DRIVER_SQL)
    out["monthly_trend"] = _trend(STD)
    out["monthly_trend_by_store"] = _trend(by)
    out["monthly_trend_ref1996"] = _trend(guests, EARLY)

    # Revenue KPIs
    out["monthly_revenue"] = _one(
        STD, [MONTHS],
        f"month, {r('revenue')} AS revenue, orders, {r('revenue / nullif(orders, 0)')} AS aov, days_with_data, days_in_month FROM months",
    )
    growth = f"""month, {r('revenue')} AS revenue, {r('revenue / nullif(prev, 0) - 1')} AS mom_growth
        FROM (SELECT *, lag(revenue) OVER (PARTITION BY store_id ORDER BY month) AS prev FROM months)"""
    out["mom_growth"] = _one(STD, [MONTHS], growth)
    out["mom_growth_by_store"] = _one(by, [MONTHS], growth)
    latest = f"""months, last_month, last_month_days, partial_last_month, {r('mom_growth_latest')} AS mom_growth_latest,
        {r('aov_change')} AS aov_change, {r('order_count_change')} AS order_count_change FROM latest"""
    out["latest_months"] = _one(STD, [MONTHS, LATEST], latest)
    out["latest_months_by_store"] = _one(by, [MONTHS, LATEST], latest)
    repeat = f"""{r('total_revenue')} AS total_revenue, {r('repeat_revenue')} AS repeat_revenue,
        {r('repeat_revenue_share')} AS repeat_revenue_share FROM repeats"""
    out["repeat_revenue_share"] = _one(STD, [CUSTOMER_FIRST, k.REPEATS], repeat)
    out["repeat_revenue_share_guests"] = _one(guests, [CUSTOMER_FIRST, k.REPEATS], repeat)
    out["repeat_revenue_share_by_store"] = _one(by, [CUSTOMER_FIRST, k.REPEATS], repeat)
    out["avg_discount_rate"] = _one(
        STD, [],
        f"""{r('coalesce(sum(discount), 0)')} AS discount,
        {r('coalesce(CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount + discount) AS DOUBLE), 0), 0)')} AS avg_discount_rate
        FROM o GROUP BY store_id""",
    )
    out["top_decile_share"] = _top_customers(STD, 0.1)
    out["top_decile_share_guests_by_store"] = _top_customers(by_guests, 0.1)
    out["top5pct_customer_share"] = _top_customers(STD, 0.05)
    cv = f"days, {r('mean_revenue')} AS mean_revenue, {r('daily_revenue_cv')} AS daily_revenue_cv FROM daily"
    out["daily_cv"] = _one(STD, [k.DAILY], cv)
    out["daily_cv_returns"] = _one(returns, [k.DAILY], cv)
    out["stability_score"] = _one(
        STD, [CUSTOMER_FIRST, k.REPEATS, MONTHS],
        f"""{r('repeat_revenue_share')} AS repeat_revenue_share, {r('cv')} AS monthly_revenue_cv,
        {r('repeat_revenue_share * (1 - cv)')} AS stability_score
        FROM repeats JOIN (SELECT store_id, stddev_samp(revenue) / avg(revenue) AS cv FROM months GROUP BY 1) USING (store_id)""",
    )
    quarter = "left(month, 4) || '-Q' || CAST(((CAST(right(month, 2) AS INT) - 1) // 3) + 1 AS VARCHAR)"
    for name, grain, label in (("seasonal_share", "quarter", quarter), ("seasonal_share_months", "month", "month")):
        out[name] = _one(
            STD, [refs(), CUSTOMER_FIRST, TREND],
            f"""{grain}, {r('revenue')} AS revenue, CAST(orders AS BIGINT) AS orders, months, {r('revenue / nullif(year, 0)')} AS year_share,
            {r('revenue / nullif((year - revenue) / nullif(n - 1, 0), 0)')} AS vs_other_{grain}s
            FROM (SELECT *, sum(revenue) OVER (PARTITION BY store_id) AS year, count(*) OVER (PARTITION BY store_id) AS n FROM (
                SELECT store_id, {label} AS {grain}, CAST(sum(revenue) AS DOUBLE) AS revenue, sum(orders) AS orders, count(*) AS months
                FROM trend GROUP BY 1, 2))""",
        )

    # Customers
    out["cohort_month"] = _one(
        STD, [CUSTOMER_FIRST], "customer_id, strftime(date_trunc('month', fd), '%Y-%m-%d') AS cohort_month FROM firsts"
    )
    out["lines_with_cohort"] = _one(
        guests, [CUSTOMER_FIRST],
        f"""strftime(date_trunc('month', fd), '%Y-%m-%d') AS cohort_month, count(*) AS lines, {r('sum(amount)')} AS revenue
        FROM o LEFT JOIN firsts USING (store_id, customer_id) GROUP BY 1""",
    )
    rate = f"customers, repeat_customers, {r('repeat_purchase_rate')} AS repeat_purchase_rate FROM rates"
    out["repeat_purchase_rate"] = _one(STD, [k.RATES], rate)
    out["repeat_purchase_rate_by_store"] = _one(by, [k.RATES], rate)
    gap = f"customers_with_gaps, {r('avg_purchase_interval_days')} AS avg_purchase_interval_days FROM gaps"
    out["purchase_interval"] = _one(STD, [k.GAPS], gap)
    out["purchase_interval_short"] = _one(SHORT, [k.GAPS], gap)
    out["purchase_interval_by_store"] = _one(by_guests, [k.GAPS], gap)
    out["rfm_base"] = _one(
        STD, [k.RFM_BASE], f"customer_id, recency_days, frequency, {r('monetary')} AS monetary FROM rfm_base"
    )
    rfm = f"""customer_id, recency_days, frequency, {r('monetary')} AS monetary, r_score, f_score, m_score,
        r_score + f_score + m_score AS rfm_sum, segment FROM rfm"""
    out["rfm_scores"] = _one(STD, [k.RFM_BASE, k.RFM], rfm)
    out["rfm_scores_by_store"] = _one(by, [k.RFM_BASE, k.RFM], rfm)
    out["rfm_segment_share"] = _one(
        guests, [k.RFM_BASE, k.RFM],
        f"""segment, customers, {r('customers / CAST(sum(customers) OVER () AS DOUBLE)')} AS share
        FROM (SELECT segment, count(*) AS customers FROM rfm GROUP BY 1)""",
    )
    out["purchase_funnel"] = _one(
        STD, [],
        f"""n AS purchase_count, customers, CAST(reached AS BIGINT) AS reached,
        {r('(reached - customers) / CAST(reached AS DOUBLE)')} AS next_conversion, {r('mean_revenue')} AS mean_revenue,
        {r('mean_revenue / first_value(mean_revenue) OVER (PARTITION BY store_id ORDER BY n)')} AS relative_value
        FROM (SELECT *, sum(customers) OVER (PARTITION BY store_id ORDER BY n DESC) AS reached FROM (
            SELECT store_id, n, count(*) AS customers, CAST(sum(amount) AS DOUBLE) / count(*) AS mean_revenue
            FROM (SELECT store_id, customer_id, count(DISTINCT order_id) AS n, sum(amount) AS amount
                FROM o WHERE customer_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2))""",
    )
    out["lapsed_customers"] = _one(
        STD, [refs()],
        """customer_id, strftime(last_day, '%Y-%m-%d') AS last_day, CAST(ref - last_day AS BIGINT) AS days_since
        FROM (SELECT store_id, customer_id, max(day) AS last_day FROM o GROUP BY 1, 2) JOIN refs USING (store_id)
        WHERE ref - last_day BETWEEN 60 AND 120""",
    )

    # Products
    out["product_totals"] = _one(
        returns, [], f"sku AS product, {r('sum(amount)')} AS amount, count(*) AS lines, count(amount) AS priced_lines FROM o GROUP BY store_id, sku"
    )

    def abc(value: str) -> str:
        return f"""product, {r('v')} AS value, {r('cum')} AS cumulative_share,
            CASE WHEN round(cum, 12) <= 0.8 THEN 'A' WHEN round(cum, 12) <= 0.95 THEN 'B' ELSE 'C' END AS abc_rank,
            {r('v / total')} AS value_share
            FROM (SELECT *, CAST(sum(x) OVER (PARTITION BY store_id ORDER BY x DESC, product
                    ROWS UNBOUNDED PRECEDING) AS DOUBLE) / total AS cum
                FROM (SELECT *, CAST(sum(x) OVER (PARTITION BY store_id) AS DOUBLE) AS total, CAST(x AS DOUBLE) AS v FROM (
                    SELECT store_id, sku AS product, {value} AS x FROM o GROUP BY 1, 2)))"""

    out["abc_revenue"] = _one(STD, [], abc("sum(amount)"))
    out["abc_revenue_by_store"] = _one(by, [], abc("sum(amount)"))
    out["abc_lines"] = _one(STD, [], abc("count(*)"))
    top = f"products, top_products, {r('top_revenue')} AS top_revenue, {r('top_share')} AS top_share FROM topp WHERE total > 0"
    out["top20_share"] = _one(STD, [k.TOP_PRODUCTS], top)
    out["top20_share_by_store"] = _one(by_returns, [k.TOP_PRODUCTS], top)
    out["top_n_share"] = _one(
        STD, [],
        f"""count(*) FILTER (rk <= 5) AS top_n, {r('sum(v) FILTER (rk <= 5)')} AS top_revenue,
        {r('CAST(sum(v) FILTER (rk <= 5) AS DOUBLE) / CAST(sum(v) AS DOUBLE)')} AS top_share
        FROM (SELECT store_id, v, row_number() OVER (PARTITION BY store_id ORDER BY v DESC) AS rk
            FROM (SELECT store_id, sku, sum(amount) AS v FROM o GROUP BY 1, 2)) GROUP BY store_id""",
    )
    out["converting_sku_rate"] = _one(
        returns, [k.CONVERTING], f"products, converting, {r('converting_rate')} AS converting_rate FROM conv"
    )
    multi = f"orders, multi_item_orders, {r('multi_item_rate')} AS multi_item_rate FROM multi"
    out["multi_item_rate"] = _one(STD, [k.MULTI], multi)
    out["multi_item_rate_by_store"] = _one(by, [k.MULTI], multi)
    out["product_kpis"] = _one(
        STD, [k.TOP_PRODUCTS],
        f"""(SELECT count(DISTINCT p_partkey) FROM part) AS total_skus,
        {r('top_revenue / CAST((SELECT sum(amount) FROM o) AS DOUBLE)')} AS top20_revenue_share,
        {r('(SELECT avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) FROM (SELECT order_id, count(*) AS n FROM o GROUP BY 1))')}
            AS multi_item_order_rate FROM topp""",
    )
    out["product_months"] = _one(
        STD, [],
        f"sku AS product, strftime(date_trunc('month', day), '%Y-%m-%d') AS month, {r('sum(amount)')} AS amount FROM o GROUP BY store_id, 1, 2",
    )
    cycle = f"product, {r('total_revenue')} AS total_revenue, months_active, lifecycle_stage FROM stages"
    out["product_lifecycle"] = _one(STD, [k.STAGES], cycle)
    out["product_lifecycle_returns"] = _one(returns, [k.STAGES], cycle)
    stage = ", ".join(
        f"{r(f'''avg(CASE WHEN lifecycle_stage = '{s}' THEN 1.0 ELSE 0.0 END)''')} AS {s.lower()}_share"
        for s in ("Launch", "Growth", "Mature", "Decline")
    )
    out["stage_shares_by_store"] = _one(by, [k.STAGES], f"count(*) AS products, {stage} FROM stages GROUP BY store_id")
    out["price_tiers"] = _one(STD, [k.TIERS], "products, price_tiers FROM tiers")
    out["price_tiers_by_store"] = _one(by, [k.TIERS], "products, price_tiers FROM tiers")
    out["category_performance"] = _one(
        parts, [],
        f"""category, {r('revenue')} AS revenue, orders, {r('revenue / n')} AS avg_price,
        {r('revenue / sum(revenue) OVER (PARTITION BY store_id)')} AS revenue_share
        FROM (SELECT store_id, category, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders, count(amount) AS n
            FROM o GROUP BY 1, 2)""",
    )
    pair = f"product_a, product_b, {r('support')} AS support, {r('lift')} AS lift, count FROM pairs"
    low = k.pairs(0.0001)
    out["cross_sell_pairs"] = _one(STD, [low], pair)
    out["cross_sell_pairs_default"] = _one(STD, [k.pairs(0.01)], pair)
    out["cross_sell_pairs_blocked"] = _one(STD, [low], pair)
    out["cross_sell_pairs_by_store"] = _one(by, [low], pair)
    catalogue = "p_partkey AS product_id, p_name AS name, p_retailprice AS price, p_type AS category"
    sold = """sold AS (SELECT store_id, sku, min(day) AS first_sale, max(day) AS last_sale FROM o GROUP BY 1, 2)"""
    out["dormant_products"] = _one(
        STD, [refs(), sold],
        f"""{catalogue}, strftime(last_sale, '%Y-%m-%d') AS last_sale
        FROM part LEFT JOIN sold ON sku = CAST(p_partkey AS VARCHAR), (SELECT max(ref) AS ref FROM refs) AS f
        WHERE last_sale IS NULL OR ref - last_sale >= 30""",
    )
    offered = "part JOIN nation ON n_nationkey = p_partkey % 25"
    out["dormant_products_by_store"] = _one(
        by, [refs(), sold],
        f"""{catalogue}, strftime(last_sale, '%Y-%m-%d') AS last_sale
        FROM (SELECT p_partkey, p_name, p_retailprice, p_type, n_name AS store_id FROM {offered}) AS p JOIN refs USING (store_id)
        LEFT JOIN sold ON sold.store_id = p.store_id AND sku = CAST(p_partkey AS VARCHAR)
        WHERE last_sale IS NULL OR ref - last_sale >= 90""",
    )
    launched = "DATE '1995-01-01' + CAST(p_partkey * 7 % 2400 AS INT) AS launch"
    dates = """strftime(launch, '%Y-%m-%d') AS launch_date, strftime(first_sale, '%Y-%m-%d') AS first_sale,
            strftime(last_sale, '%Y-%m-%d') AS last_sale"""
    untimely = "NOT EXISTS (SELECT 1 FROM o WHERE {store}o.sku = CAST(p_partkey AS VARCHAR) AND o.day BETWEEN launch AND launch + 60)"
    out["unsold_launches"] = _one(
        STD, [refs(), sold],
        f"""{catalogue}, {dates}
        FROM (SELECT *, {launched} FROM part)
        LEFT JOIN sold ON sku = CAST(p_partkey AS VARCHAR), (SELECT max(ref) AS ref FROM refs) AS f
        WHERE launch + 60 <= ref AND {untimely.format(store='')}""",
    )
    out["unsold_launches_by_store"] = _one(
        by, [refs(), sold],
        f"""{catalogue}, {dates}
        FROM (SELECT p_partkey, p_name, p_retailprice, p_type, n_name AS store_id, {launched} FROM {offered}) AS p JOIN refs USING (store_id)
        LEFT JOIN sold ON sold.store_id = p.store_id AND sku = CAST(p_partkey AS VARCHAR)
        WHERE launch + 60 <= ref AND {untimely.format(store='o.store_id = p.store_id AND ')}""",
    )

    # Pricing and stock
    out["monthly_discount_rate"] = _one(STD, [k.RATES_BY_MONTH], f"month, {r('discount_rate')} AS discount_rate FROM drates")
    dep = f"""{r('avg_discount_rate')} AS avg_discount_rate, {r('discounted_line_ratio')} AS discounted_line_ratio,
        discount_rate_trend FROM dep"""
    out["discount_dependency"] = _one(STD, [k.RATES_BY_MONTH, k.DEPENDENCY], dep)
    out["discount_dependency_by_store"] = _one(by, [k.RATES_BY_MONTH, k.DEPENDENCY], dep)
    out["discount_dependency_none"] = _one(
        STD, [], "CAST(0 AS DOUBLE) AS avg_discount_rate, CAST(0 AS DOUBLE) AS discounted_line_ratio, 'stable' AS discount_rate_trend FROM o LIMIT 1"
    )
    out["margin_by_category"] = _one(
        parts, [k.MARGINS], f"category, {r('revenue')} AS revenue, {r('cost')} AS cost, {r('margin')} AS margin FROM margins"
    )
    out["margin_summary"] = _one(
        parts, [k.MARGINS],
        f"""{r('(sum(revenue) - sum(cost)) / nullif(sum(revenue), 0)')} AS overall_margin,
        count(*) AS categories, count(*) FILTER (margin < 0) AS negative_categories FROM margins GROUP BY store_id""",
    )
    ship = f"""orders, {r('current_aov')} AS current_aov, {r('median_order')} AS median_order,
        {r('suggested_threshold')} AS suggested_threshold, {r('below')} AS orders_below_threshold_pct,
        {r('lift')} AS potential_aov_lift FROM ship"""
    out["free_shipping_threshold"] = _one(STD, [k.SHIP], ship)
    out["free_shipping_threshold_by_store"] = _one(by, [k.SHIP], ship)
    out["large_order_share"] = _one(
        STD, [k.LARGE], f"{r('largest_order')} AS largest_order, {r('largest_order_share')} AS largest_order_share FROM large"
    )
    out["order_alerts"] = _one(
        by, [refs()],
        f"""{r('max(total)')} AS window_revenue, count(*) FILTER (v > total * 0.05) AS orders_over_limit,
        {r('CAST(sum(v) FILTER (rk <= 3) AS DOUBLE) / CAST(max(total) AS DOUBLE)')} AS top3_share,
        CAST(sum(v) FILTER (rk <= 3) AS DOUBLE) / CAST(max(total) AS DOUBLE) > 0.15 AS top3_alert
        FROM (SELECT store_id, v, sum(v) OVER (PARTITION BY store_id) AS total,
                row_number() OVER (PARTITION BY store_id ORDER BY v DESC) AS rk
            FROM (SELECT store_id, order_id, sum(amount) AS v FROM o JOIN refs USING (store_id)
                WHERE day BETWEEN ref - 29 AND ref GROUP BY 1, 2)) GROUP BY store_id""",
    )
    out["inventory_kpis"] = f"""SELECT count(DISTINCT p_partkey) AS total_skus, count(*) FILTER (p_size <= 10) AS stockout_skus,
        {r('count(*) FILTER (p_size <= 10) / CAST(count(DISTINCT p_partkey) AS DOUBLE)')} AS stockout_rate,
        count(*) FILTER (p_partkey * 7 % 180 > 90) AS overstock_skus,
        {r('sum((p_size - 10) * CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.6 AS DECIMAL(18,4)))')} AS total_inventory_value FROM part"""

    # Health checks and what follows from them
    out |= k.check_queries(parts, by_parts)
    out["review_document"] = _document(parts)
    out["review_document_by_store"] = _document(by_parts)
    out["review_document_90d"] = _document(parts, "90d")
    recent = f"""all_lines AS ({parts.cte.removeprefix('o AS (')},
    o AS (SELECT * FROM all_lines WHERE day BETWEEN DATE '{EARLY}' - 59 AND DATE '{EARLY}')"""
    out["review_document_short"] = _document(Source(recent, ""))
    out["trajectory"] = _paired(
        by,
        f"""period, {r(chg('revenue'))} AS revenue_change,
        CASE WHEN {chg('revenue')} > 0.1 THEN 'strong' WHEN {chg('revenue')} >= -0.05 THEN 'stable'
            WHEN {chg('revenue')} < -0.05 THEN 'declining' END AS trajectory""",
    )
    board = ", ".join(
        f"{r(f'''max(CASE WHEN period = '{p}' THEN {m} END)''')} AS {m}_{p}" for p in ("30d", "90d", "365d") for m in ("value", "change")
    )
    rows = " UNION ALL ".join(
        f"SELECT store_id, period, '{x}' AS kpi, c_{x} AS value, {chg(x)} AS change FROM paired"
        for x in ("revenue", "orders", "aov", "customers")
    )
    out["scoreboard"] = query(
        STD, [refs(), windows(), CUSTOMER_FIRST, summary(), PAIRED], f"SELECT kpi, {board} FROM ({rows}) GROUP BY store_id, kpi"
    )
    band = "CASE WHEN {v} IS NULL THEN NULL WHEN {hi} THEN 'high' WHEN {mid} THEN 'medium' ELSE 'low' END"
    down = f"(CASE WHEN {chg('revenue')} < 0 THEN 1 ELSE 0 END + CASE WHEN {chg('customers')} < 0 THEN 1 ELSE 0 END)"
    factors = [
        ("Revenue Concentration", "best_share", "best_share > 0.5", "best_share >= 0.3"),
        ("Acquisition Dependency", share("returning_customer_revenue"), f"{share('returning_customer_revenue')} < 0.3", f"{share('returning_customer_revenue')} <= 0.4"),
        ("Discount Dependency", "avg_discount_rate", "avg_discount_rate > 0.25 OR discount_rate_trend = 'increasing'", "avg_discount_rate >= 0.15"),
        ("Product Lifecycle", "decline_share", "decline_share > 0.5", "decline_share >= 0.3"),
        ("Growth Sustainability", down, f"{down} = 2", f"{down} = 1"),
        ("Revenue Volatility", "daily_revenue_cv", "daily_revenue_cv > 0.8", "daily_revenue_cv >= 0.5"),
    ]
    risk_rows = " UNION ALL ".join(
        f"SELECT {by.key} '{n}' AS risk_factor, {r(v)} AS value, {band.format(v=v, hi=hi, mid=mid)} AS severity FROM facts"
        for n, v, hi, mid in factors
    )
    facts = """facts AS (SELECT * FROM paired
        JOIN (SELECT store_id, max(CAST(v AS DOUBLE)) / sum(CAST(v AS DOUBLE)) AS best_share
            FROM (SELECT store_id, sku, sum(amount) AS v FROM o GROUP BY 1, 2) GROUP BY 1) USING (store_id)
        JOIN (SELECT store_id, avg(CASE WHEN lifecycle_stage = 'Decline' THEN 1.0 ELSE 0.0 END) AS decline_share FROM stages GROUP BY 1)
            USING (store_id)
        JOIN dep USING (store_id) JOIN daily USING (store_id) WHERE period = '365d')"""
    out["risk_rubric"] = query(
        by, [refs(), windows(), CUSTOMER_FIRST, summary(), PAIRED, k.STAGES, k.RATES_BY_MONTH, k.DEPENDENCY, k.DAILY, facts], risk_rows
    )
    out["benchmark_grades"] = k.benchmark_query(parts)
    out["impact_models"] = query(
        by_parts,
        [refs(), windows(), CUSTOMER_FIRST, summary(), PAIRED, k.REPEATS, k.RATES, k.MARGINS],
        f"""SELECT store_id, {r('c_new_customers * (rate * 0.05 * (per_rep - 1.0) * c_returning_customer_aov)')} AS repeat_rate_uplift,
        {r('moved')} AS delta_repeat_revenue, {r('moved / nullif(c_new_customer_aov, 0)')} AS fewer_new_orders,
        {r('moved / nullif(c_new_customer_aov, 0) * 35.0')} AS net_savings,
        {r('(p + p0 * 0.01) * kept - p * c_orders')} AS delta_revenue,
        {r('(p + p0 * 0.01 - unit) * kept - (p - unit) * c_orders')} AS delta_gross_profit,
        {r('c_revenue / (1 - c_avg_discount_rate) * 0.01')} AS constant_volume_recovery
        FROM (SELECT *, c_orders * (1 + -1.5 * ((p + p0 * 0.01) / p - 1.0)) AS kept FROM (
            SELECT paired.*, repeat_purchase_rate AS rate, per_rep, c_revenue * 0.05 AS moved,
                c_aov / (1 - c_avg_discount_rate) AS p0, c_aov AS p, c_aov * (1 - margin) AS unit
            FROM paired JOIN rates USING (store_id)
            JOIN (SELECT store_id, avg(n) FILTER (n >= 2) AS per_rep FROM (SELECT store_id, customer_id,
                CAST(count(DISTINCT order_id) AS DOUBLE) AS n FROM o GROUP BY 1, 2) GROUP BY 1) USING (store_id)
            JOIN (SELECT store_id, (sum(revenue) - sum(cost)) / sum(revenue) AS margin FROM margins GROUP BY 1) USING (store_id)
            WHERE period = '365d'))""",
    )

    # Sources
    out["retail_normalise"] = f"""SELECT 'C-' || CAST(o_custkey AS VARCHAR) AS customer_id, count(DISTINCT o_orderkey) AS orders,
        {r('sum(CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(12,2)))')} AS revenue,
        strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_order, max(CAST(l_partkey AS VARCHAR)) AS last_sku
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1"""
    sold = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    out["load_orders_lines"] = f"""SELECT 'C-' || CAST(o_custkey AS VARCHAR) AS customer_id, count(DISTINCT o_orderkey) AS orders,
        {r('sum(CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(12,2)))')} AS revenue,
        strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_order, max(p_name || ', "new"') AS last_name
        FROM {sold} WHERE o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 GROUP BY 1"""
    text = f"""'INV' || o_orderkey || ',' || l_partkey || ',"' || p_name || ', {QUOTED},' || CAST(l_quantity AS INT) || ','
        || CASE WHEN o_orderkey % 89 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%-m/%-d/%Y %-H:%M') END || ',' || CAST(p_retailprice AS DECIMAL(12,2))
        || CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE ',C-' || o_custkey END"""
    out["load_orders_rejected"] = f"""SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'width' ELSE 'order_date' END AS reason, count(*) AS lines,
        max({text}) AS last_line FROM {sold} WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 GROUP BY 1"""
    out["load_products_lines"] = f"""SELECT 'p-' || p_partkey AS product_id, p_name || ', "boxed"' AS name,
            CASE WHEN p_partkey % 13 <> 0 THEN {r('CAST(p_retailprice AS DECIMAL(12,2))')} END AS price, p_type AS category, p_brand AS vendor,
            CAST(NULL AS VARCHAR) AS rejected FROM part WHERE p_partkey % 31 <> 0
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'width: p-' || p_partkey || ',"' || p_name || ', {BOXED},'
            || CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END || ',' || p_type
            FROM part WHERE p_partkey % 31 = 0"""
    known = "p_partkey % 11 <> 0"
    out["load_inventory_lines"] = f"""SELECT count(DISTINCT p_partkey) FILTER (p_partkey % 37 <> 0) AS total_skus,
        count(*) FILTER (p_size <= 10 AND {known} AND p_partkey % 37 <> 0) AS stockout_skus,
        {r(f'count(*) FILTER (p_size <= 10 AND {known} AND p_partkey % 37 <> 0) / CAST(count(DISTINCT p_partkey) FILTER (p_partkey % 37 <> 0) AS DOUBLE)')} AS stockout_rate,
        count(*) FILTER (p_partkey * 7 % 180 > 90 AND p_partkey % 37 <> 0) AS overstock_skus,
        {r(f'sum((p_size - 10) * CAST(CAST(p_retailprice AS DECIMAL(12,2)) * 0.6 AS DECIMAL(18,4))) FILTER ({known} AND p_partkey % 37 <> 0)')} AS total_inventory_value,
        count(*) FILTER (p_partkey % 37 = 0) AS rejected FROM part"""
    out["shop_normalise"] = f"""SELECT o_orderstatus AS financial_status, count(*) AS orders,
        {r('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS revenue,
        {r("sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.5 ELSE 0 END)")} AS discount,
        strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_order, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1"""
    out["fuzzy_normalise"] = f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, {r('sum(CAST(o_totalprice AS DECIMAL(18,2)))')} AS revenue,
        count(*) AS orders FROM orders GROUP BY 1"""
    out["quality_report"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, CAST(0 AS BIGINT) AS nulls,
        {"count(*) FILTER (o_orderpriority <> '1-URGENT')" if c == 'discount' else 'CAST(0 AS BIGINT)'} AS unparsable FROM orders"""
        for c in ("order_id", "order_date", "financial_status", "amount", "customer_id", "discount")
    )
    # What the retail export's columns hold, and what its headers should be called.
    retail = {
        "Invoice": ("'INV' || o_orderkey", "order_id"),
        "StockCode": ("CAST(l_partkey AS VARCHAR)", "sku"),
        "Description": ("p_name", "product_name"),
        "Quantity": ("CAST(CAST(l_quantity AS INT) AS VARCHAR)", "quantity"),
        "InvoiceDate": ("strftime(o_orderdate, '%-m/%-d/%Y %-H:%M')", "order_date"),
        "Price": ("CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)", "item_price"),
        "Customer ID": ("'C-' || o_custkey", "customer_id"),
    }
    sold = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
    is_number, is_date = "regexp_full_match(v, '[0-9.]+')", "try_strptime(v, '%-m/%-d/%Y %-H:%M') IS NOT NULL"
    sort = {"StockCode": "currency", "Quantity": "currency", "Price": "currency", "InvoiceDate": "date"}
    out["column_profile"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS rows, count(v) AS filled, {r(f'count(*) FILTER ({is_number}) / count(v)')} AS numeric_rate,
        {r(f'count(*) FILTER (NOT {is_number} AND {is_date}) / count(v)')} AS date_rate, CAST(NULL AS DOUBLE) AS distinct_rate,
        false AS distinct_exact, '{sort.get(name, 'unknown')}' AS inferred_type FROM (SELECT {value} AS v FROM {sold})"""
        for name, (value, _) in retail.items()
    )
    batch = "'B' || floor(o_orderkey * {} / 100)::BIGINT"
    # Name, value, shares of numbers and dates, whether counted exactly, type.
    tickets = [
        ("ticket", "'T' || o_orderkey", "0", "0", False, "'id'"),
        ("batch79", batch.format(79), "0", "0", True, "CASE WHEN count(DISTINCT v) / count(*) > 0.8 THEN 'id' ELSE 'unknown' END"),
        ("batch82", batch.format(82), "0", "0", True, "CASE WHEN count(DISTINCT v) / count(*) > 0.8 THEN 'id' ELSE 'unknown' END"),
        ("client", "'C' || o_custkey", "0", "0", False, "'unknown'"),
        ("note", "NULL::VARCHAR", "NULL", "NULL", False, "'unknown'"),
        ("day", "strftime(o_orderdate, '%-d.%-m.%Y')", "0", "1", False, "'date'"),
        ("fee", "CASE WHEN o_orderkey % 5 < 4 THEN '$' || o_custkey ELSE 'none' END", "count(*) FILTER (v <> 'none') / count(*)", "0", False,
         "CASE WHEN count(*) FILTER (v <> 'none') / count(*) > 0.8 THEN 'currency' ELSE 'unknown' END"),
    ]
    out["column_profile_at_limits"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS rows, count(v) AS filled, {r(number)} AS numeric_rate, {r(dated)} AS date_rate,
        {r('count(DISTINCT v) / count(*)') if exact else 'CAST(NULL AS DOUBLE)'} AS distinct_rate, {str(exact).lower()} AS distinct_exact,
        {kind} AS inferred_type FROM (SELECT *, {value} AS v FROM orders)"""
        for name, value, number, dated, exact, kind in tickets
    )
    out["mapping_report_exact"] = " UNION ALL ".join(
        [
            f"SELECT '{name}' AS source_col, '{canonical}' AS canonical, 1 AS tier, CAST(1 AS DOUBLE) AS score, count(*) AS rows, count({value}) AS filled, '{sort.get(name, 'unknown')}' AS inferred_type FROM {sold}"
            for name, (value, canonical) in retail.items()
        ]
        + ["SELECT NULL, 'amount', NULL, NULL, NULL, NULL, NULL"]
    )
    # Two of three words agree, and a fitting value type adds a fifth.
    fits = [
        ("Order Id Number", "'order_id'", "2", "round(2.0 / 3 + 0.2, 6)", "o_orderkey", "id"),
        ("order_day_date", "'order_date'", "2", "round(2.0 / 3 + 0.2, 6)", "o_orderdate", "date"),
        ("amount", "'amount'", "0", "1.0", "o_totalprice", "currency"),
        ("customer id", "'customer_id'", "1", "1.0", "o_custkey", "unknown"),
        ("priority", "NULL", "NULL", "NULL", "o_orderpriority", "unknown"),
    ]
    out["mapping_report_fuzzy"] = " UNION ALL ".join(
        f"SELECT '{name}' AS source_col, {canonical} AS canonical, CAST({tier} AS INT) AS tier, CAST({score} AS DOUBLE) AS score, count(*) AS rows, count({value}) AS filled, '{kind}' AS inferred_type FROM orders"
        for name, canonical, tier, score, value, kind in fits
    )
    out |= _edges()
    return out
