"""The 23 health checks: one KPI row per store, turned into graded check rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import durable, gather, side_by_side
from tallybrook.functions.scalars import fixed, percent
from tallybrook.ledger import Ledger
from tallybrook.operators import baskets, customers, pricing, products, revenue
from tallybrook.plans import rules


def kpi_row(orders, by=(), pair_support: float = rules.PAIR_SUPPORT) -> DataFrame:
    """All whole-history KPIs the checks need, one row per store."""
    led = Ledger.of(orders, by)
    by = led.by
    def segments() -> DataFrame:
        label = F.col("segment")
        return customers.rfm_segments(led).groupBy(*by).agg(
            F.avg(label.isin(customers.CHAMPIONS, customers.LOYAL).cast("double")).alias("champions_loyal"),
            F.avg((label == customers.AT_RISK).cast("double")).alias("at_risk"),
            F.avg((label == customers.LOST).cast("double")).alias("lost"),
        )

    def lifted() -> DataFrame:
        pairs = baskets.cross_sell_pairs(led, min_support=pair_support)
        return pairs.groupBy(*by).agg(F.count_if(F.col("lift") > rules.PAIR_LIFT).alias("lifted_pairs"))

    def part(operator: Callable, *columns: str, **renamed: str) -> Callable[[], DataFrame]:
        return lambda: operator(led).select(*by, *columns, *[F.col(c).alias(n) for n, c in renamed.items()])

    tasks = [segments]
    if led.product_key:
        tasks += [
            lifted,
            part(products.price_tiers, "price_tiers"),
            part(products.top_product_share, top_product_share="top_share"),
            part(products.stage_shares, "decline_share"),
            part(products.converting_rate, "products", "converting", "converting_rate"),
            part(products.multi_item_rate, "multi_item_rate"),
        ]
    tasks += [
        part(pricing.free_shipping_threshold, "suggested_threshold", "current_aov", "potential_aov_lift"),
        part(revenue.top_customer_share, top_customer_share="top_share"),
        part(pricing.discount_dependency, "avg_discount_rate", "discounted_line_ratio", "discount_rate_trend"),
        part(revenue.latest_months, "partial_last_month", "mom_growth_latest", "aov_change", "order_count_change"),
        part(revenue.repeat_revenue_share, "total_revenue", "repeat_revenue_share"),
        part(revenue.daily_revenue_cv, "daily_revenue_cv"),
        part(pricing.large_order_share, "largest_order_share"),
        part(customers.repeat_purchase_rate, "customers", "repeat_purchase_rate"),
        part(customers.purchase_interval, "avg_purchase_interval_days"),
    ]
    if led.has("cost"):
        tasks.append(part(pricing.margin_summary, "negative_categories"))
    return gather(side_by_side(tasks), by)


@dataclass
class _Entry:
    """What a check shows: ``style`` tells how its value is written in the message."""

    value: Column | None
    label: str
    style: str = "percent"
    text: Column | None = None
    suffix: Column | None = None
    present: Column | None = None
    na_message: Column | None = None
    grade: Column | None = None


def _entries(led: Ledger) -> dict[str, _Entry]:
    c = F.col
    partial = F.when(c("partial_last_month"), " (partial month excluded)")
    no_revenue = c("total_revenue") == 0
    repeat, interval = F.coalesce("repeat_purchase_rate", F.lit(0.0)), c("avg_purchase_interval_days")
    odd = (c("repeat_revenue_share") == 0) & (repeat > rules.CONTRADICTING_REPEAT_RATE)
    doubt = F.concat(F.lit(" (data quality issue: repeat purchase rate="), percent(repeat), F.lit(")"))
    no_threshold = F.coalesce((c("suggested_threshold") == 0) | (c("current_aov") == 0), F.lit(True))
    known = c("customers") > 0

    # Labels and messages of the checks.
    out = {
        "monthly_revenue_trend": _Entry(
            c("mom_growth_latest"),
            "MoM revenue growth",
            suffix=partial,
            na_message=F.when(c("mom_growth_latest").isNull(), "Insufficient data for MoM growth (<2 months)"),
        ),
        "aov_trend": _Entry(c("aov_change"), "AOV MoM change", suffix=partial, present=c("aov_change").isNotNull()),
        "order_count_trend": _Entry(
            c("order_count_change"), "MoM order count change", suffix=partial, present=c("order_count_change").isNotNull()
        ),
        "repeat_customer_revenue_share": _Entry(
            c("repeat_revenue_share"), "Repeat customer revenue share", suffix=F.when(odd, doubt), grade=F.when(odd, "watch")
        ),
        "revenue_concentration_top10": _Entry(
            c("top_customer_share"),
            "Top 10% customer revenue share",
            na_message=F.when(no_revenue, "No revenue data for concentration analysis"),
        ),
        "avg_discount_rate_trend": _Entry(
            c("avg_discount_rate"),
            "Average discount rate",
            na_message=None if led.has("discount") else F.lit("No discount data available"),
        ),
        "daily_revenue_volatility": _Entry(
            c("daily_revenue_cv"),
            "Daily revenue coefficient of variation",
            "two places",
            na_message=F.when(c("daily_revenue_cv").isNull(), "Insufficient daily data for CV calculation").when(
                no_revenue, "No revenue data for CV calculation"
            ),
        ),
        "large_order_dependency": _Entry(
            c("largest_order_share"), "Largest order share of revenue", present=c("total_revenue") > 0
        ),
        "free_shipping_threshold_effectiveness": _Entry(
            c("potential_aov_lift"),
            "Free-shipping threshold AOV lift potential",
            suffix=F.format_string(" (suggested: %,.0f)", "suggested_threshold"),
            na_message=F.when(no_threshold, "Insufficient order data for free-shipping threshold analysis"),
        ),
        "repeat_purchase_rate": _Entry(repeat, "Repeat purchase rate"),
        "days_to_second_purchase": _Entry(
            interval,
            "Avg days to 2nd purchase",
            "whole",
            na_message=F.when(interval.isNull(), "Insufficient data for purchase interval calculation"),
        ),
        "champions_loyal_share": _Entry(c("champions_loyal"), "Champions + Loyal segment share", present=known),
        "at_risk_segment_share": _Entry(c("at_risk"), "At-Risk segment share", present=known),
        "lost_segment_share": _Entry(c("lost"), "Lost segment share", present=known),
    }
    if led.has("discount"):
        trend = c("discount_rate_trend")
        out["discounted_order_ratio"] = _Entry(c("discounted_line_ratio"), "Discounted order ratio")
        out["discount_depth_trend"] = _Entry(
            None,
            "Discount depth trend",
            "text",
            text=trend,
            grade=F.when(trend.isin("stable", "decreasing"), "pass").otherwise("watch"),
        )
    if led.has("cost"):
        out["category_margin_variance"] = _Entry(c("negative_categories"), "Categories with negative margin", "whole")
    if led.product_key:
        out |= _product_entries()
    return out


def _product_entries() -> dict[str, _Entry]:
    c = F.col
    none_sold = F.coalesce(c("products") == 0, F.lit(True))
    top, (low, high) = c("top_product_share"), rules.TOP20_PASS_BAND
    # Labels and messages of the checks.
    return {
        "top20_revenue_concentration": _Entry(
            top,
            "Top 20% SKU revenue concentration",
            present=top.isNotNull(),
            grade=F.when(top.between(low, high), "pass").when(top <= rules.TOP20_WATCH_TO, "watch").otherwise("fail"),
        ),
        "converting_sku_rate": _Entry(
            c("converting_rate"),
            "Converting SKU rate",
            suffix=F.format_string(" (%d/%d)", "converting", "products"),
            na_message=F.when(none_sold, "No SKU/product data available for conversion analysis"),
        ),
        "multi_item_order_rate": _Entry(F.coalesce("multi_item_rate", F.lit(0.0)), "Multi-item order rate"),
        "cross_sell_pair_lift": _Entry(
            F.coalesce("lifted_pairs", F.lit(0)), "Cross-sell pairs with lift > 2.0", "whole"
        ),
        "lifecycle_stage_distribution": _Entry(
            c("decline_share"), "Decline-stage products", present=c("decline_share").isNotNull()
        ),
        "price_tier_distribution": _Entry(
            F.coalesce("price_tiers", F.lit(1)),
            "Distinct price tiers",
            "whole",
            na_message=F.when(none_sold, "No price data available for tier analysis"),
        ),
    }


def graded(value: Column, op: Column | str, pass_at: Column | float, watch_at: Column | float) -> Column:
    """pass / watch / fail of a value; null stays null."""
    op, pass_at, watch_at = (x if isinstance(x, Column) else F.lit(x) for x in (op, pass_at, watch_at))

    def meets(limit: Column) -> Column:
        ways = {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit}
        return reduce(lambda a, b: a | b, [(op == o) & way for o, way in ways.items()])

    good = F.when(meets(pass_at), "pass").when(meets(watch_at), "watch").otherwise("fail")
    return F.when(value.isNotNull() & op.isNotNull(), good)


def check_rows(kpis: DataFrame, led: Ledger) -> DataFrame:
    """Graded rows from a KPI row; checks without their input are left out or ``na``.

    The row is unfolded first; messages and grades are then one expression for all checks.
    """

    no_text, no_number, always = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(True)
    entries, structs, facts = _entries(led), [], []
    for place, (check_id, category, severity, threshold) in enumerate(rules.CHECKS, start=1):
        e = entries.get(check_id)
        if e is None:
            continue
        limit = (None, threshold) if isinstance(threshold, str) else (float(threshold), None)
        facts.append((place, check_id, category, severity, e.label, e.style, *rules.GRADES.get(check_id, (None,) * 3), *limit))
        structs.append(
            F.struct(
                F.lit(place).alias("ord"),
                (no_number if e.value is None else e.value.cast("double")).alias("number"),
                (no_text if e.text is None else e.text).alias("text"),
                (no_text if e.suffix is None else e.suffix).alias("suffix"),
                (no_text if e.na_message is None else e.na_message).alias("na"),
                (no_text if e.grade is None else e.grade).alias("grade"),
                (always if e.present is None else e.present).alias("present"),
            )
        )
    fixed_facts = (
        "ord int, check_id string, category string, severity string, label string, style string, "
        "op string, pass_at double, watch_at double, threshold double, threshold_text string"
    )
    table = kpis.sparkSession.createDataFrame(facts, fixed_facts)
    rows = kpis.select(*led.by, F.inline(F.array(*structs))).filter("present")
    rows = rows.join(F.broadcast(table), "ord")  # one row per check
    known = F.col("na").isNull()
    shown = (
        F.when(F.col("style") == "percent", percent("number"))
        .when(F.col("style") == "two places", fixed("number", 2))
        .when(F.col("style") == "whole", fixed("number", 0))
        .otherwise(F.col("text"))
    )
    message = F.concat("label", F.lit(": "), shown, F.coalesce("suffix", F.lit("")))
    grade = F.coalesce("grade", graded(F.col("number"), F.col("op"), F.col("pass_at"), F.col("watch_at")))
    return rows.select(
        *led.by,
        "ord",
        "check_id",
        "category",
        "severity",
        F.when(known, grade).otherwise("na").alias("result"),
        F.coalesce("na", message).alias("message"),
        F.when(known, F.col("number")).alias("value"),
        F.when(known, F.col("text")).alias("value_text"),
        "threshold",
        "threshold_text",
    )


def health_checks(orders, by=(), pair_support: float = rules.PAIR_SUPPORT) -> DataFrame:
    """by, ord, check_id, category, severity, result, message, value(_text), threshold(_text).

    The rollups are shared by all KPIs and released afterwards, so the at most 23
    rows per store are written before they are handed out.
    """
    own = not isinstance(orders, Ledger)
    led = Ledger.of(orders, by)
    if own:
        led.keep()
    rows = durable(check_rows(kpi_row(led, pair_support=pair_support), led))
    if own:
        led.release()
    return rows
