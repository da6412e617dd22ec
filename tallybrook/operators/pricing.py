"""Discount, margin, order value and free-shipping analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, group_window
from tallybrook.functions.ordering import quantiles, top_n_sum
from tallybrook.functions.scalars import MONEY, month_label, num, ratio, total
from tallybrook.ledger import Ledger

# Fixed value: monthly slope of the discount rate that counts as a trend.
TREND_SLOPE = 0.005
# threshold = 1.2 × median order, "near" starts at 80 % of it.
THRESHOLD_FACTOR = 1.2
NEAR_FACTOR = 0.8


def monthly_discount_rate(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    months = (
        led.daily.filter(F.col("day").isNotNull())
        .groupBy(*led.by, F.trunc("day", "month").alias("month_start"))
        .agg(total("discount").alias("_d"), total("gross").alias("_g"))
    )
    return months.select(*led.by, month_label("month_start").alias("month"), ratio("_d", "_g").alias("discount_rate"))


def discount_dependency(orders, by=()) -> DataFrame:
    """Average rate, share of discounted lines and trend of the monthly rate.

    Without a discount column: zeros and "stable".
    """
    led = Ledger.of(orders, by)
    whole = led.daily.groupBy(*led.by).agg(
        total("discount").alias("_d"),
        total("gross").alias("_g"),
        F.sum("discounted_lines").alias("_dl"),
        F.sum("lines").alias("_l"),
    )
    step = F.row_number().over(group_window(led.by).orderBy("month")) - 1
    months = monthly_discount_rate(led).withColumn("_i", step.cast("double"))
    slope = months.groupBy(*led.by).agg(
        F.count(F.lit(1)).alias("months"), F.regr_slope("discount_rate", "_i").alias("rate_slope")
    )
    trend = (
        F.when(F.col("months") < 3, "stable")
        .when(F.col("rate_slope") > TREND_SLOPE, "increasing")
        .when(F.col("rate_slope") < -TREND_SLOPE, "decreasing")
        .otherwise("stable")
    )
    return attach(whole, slope, led.by).select(
        *led.by,
        ratio("_d", "_g").alias("avg_discount_rate"),
        ratio("_dl", "_l").alias("discounted_line_ratio"),
        F.coalesce(trend, F.lit("stable")).alias("discount_rate_trend"),
    )


def discounted_orders(orders, by=()) -> DataFrame:
    """Share of orders with a discounted line, where ``discounted_line_ratio`` counts lines."""
    led = Ledger.of(orders, by)
    keyed = led.sales.filter(F.col("order_id").isNotNull())
    each = keyed.groupBy(*led.by, "order_id").agg(F.max(F.col("discounted_lines") > 0).alias("any"))
    sums = each.groupBy(*led.by).agg(F.count(F.lit(1)).alias("orders"), F.count_if("any").alias("discounted_orders"))
    return sums.withColumn("discounted_order_ratio", ratio("discounted_orders", "orders"))


def _category_sums(led: Ledger, cost_col: str) -> DataFrame:
    """Revenue and cost per category, null included."""
    lines = led.lines_with("category", "amount", cost_col)
    return lines.groupBy(*led.by, F.col("category").cast("string").alias("category")).agg(
        total(F.col("amount").cast(MONEY)).alias("_r"), total(F.col(cost_col).cast(MONEY)).alias("_c")
    )


def category_margins(orders, by=(), cost_col: str = "cost") -> DataFrame:
    """(revenue − cost) ÷ revenue per category; 0 without revenue."""
    led = Ledger.of(orders, by)
    sums = _category_sums(led, cost_col).filter(F.col("category").isNotNull())
    return sums.select(
        *led.by,
        "category",
        num("_r").alias("revenue"),
        num("_c").alias("cost"),
        ratio(F.col("_r") - F.col("_c"), "_r").alias("margin"),
    )


def margin_summary(orders, by=(), cost_col: str = "cost") -> DataFrame:
    """Overall margin and the number of categories with a negative one.

    Without a cost column the margin is null.
    """
    led = Ledger.of(orders, by)
    if not led.has(cost_col):
        stores = led.daily.groupBy(*led.by).agg(F.count(F.lit(1)).alias("_n"))
        return stores.select(
            *led.by,
            F.lit(None).cast("double").alias("overall_margin"),
            F.lit(0).cast("long").alias("categories"),
            F.lit(0).cast("long").alias("negative_categories"),
        )
    if not led.has("category"):
        whole = led.lines_with("amount", cost_col).groupBy(*led.by).agg(
            total(F.col("amount").cast(MONEY)).alias("_r"), total(F.col(cost_col).cast(MONEY)).alias("_c")
        )
        out = whole.select(*led.by, ratio(F.col("_r") - F.col("_c"), "_r").alias("overall_margin"))
        return out.withColumn("categories", F.lit(0).cast("long")).withColumn("negative_categories", F.lit(0).cast("long"))
    # Categories add up to the whole, so the lines are read once.
    named, loss = F.col("category").isNotNull(), ratio(F.col("_r") - F.col("_c"), "_r") < 0
    sums = _category_sums(led, cost_col).groupBy(*led.by).agg(
        total("_r").alias("_r"), total("_c").alias("_c"), F.count_if(named).alias("categories"), F.count_if(named & loss).alias("negative_categories")
    )
    return sums.select(*led.by, ratio(F.col("_r") - F.col("_c"), "_r").alias("overall_margin"), "categories", "negative_categories")


def order_totals(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    if led.kept_rollup("placed") is not None:
        return led.placed.select(*led.by, "order_id", "order_total")
    keyed = led.sales.filter(F.col("order_id").isNotNull())
    return keyed.groupBy(*led.by, "order_id").agg(total("amount").alias("order_total"))


def free_shipping_threshold(orders, by=()) -> DataFrame:
    """Suggested threshold, share of orders below it, AOV lift of the orders just below it.

    The exact median is selected among the order totals, which are not sorted as a whole.
    """
    led = Ledger.of(orders, by)
    totals = order_totals(led)
    middle = quantiles(totals, led.by, "order_total", {"median_order": 0.5}, few=led.few)
    suggested = F.bround(F.col("median_order") * THRESHOLD_FACTOR, -2)
    limits = led.few(middle.select(*led.by, "median_order", suggested.alias("t")))
    value, money = num("order_total"), F.col("order_total")
    near = (value >= F.col("t") * NEAR_FACTOR) & (value < F.col("t"))
    sums = attach(totals, limits, led.by).groupBy(*led.by, "median_order", "t").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(money).alias("mass"),
        F.count_if(value < F.col("t")).alias("below"),
        F.count_if(near).alias("near_n"),
        F.sum(F.when(near, money)).alias("near_mass"),
    )
    aov = F.try_divide(num("mass"), num("n"))
    lift = F.when(
        F.col("near_n") > 0, F.try_divide(F.col("t") - num("near_mass") / F.col("near_n"), aov)
    ).otherwise(F.lit(0.0))
    return sums.select(
        *led.by,
        F.col("n").alias("orders"),
        aov.alias("current_aov"),
        "median_order",
        F.col("t").alias("suggested_threshold"),
        ratio("below", "n").alias("orders_below_threshold_pct"),
        lift.alias("potential_aov_lift"),
    )


def large_order_share(orders, by=()) -> DataFrame:
    """Largest order total ÷ all revenue; no row without positive revenue."""
    led = Ledger.of(orders, by)
    biggest = order_totals(led).groupBy(*led.by).agg(F.max("order_total").alias("_max"))
    whole = led.daily.groupBy(*led.by).agg(total("amount").alias("_all"))
    joined = attach(whole, biggest, led.by).filter(F.col("_all") > 0)
    return joined.select(
        *led.by, num("_max").alias("largest_order"), F.try_divide(num("_max"), num("_all")).alias("largest_order_share")
    )


def order_alerts(orders, by=(), ref_date=None, days: int = 30, single: float = 0.05, top3: float = 0.15) -> DataFrame:
    """Concentration of the trailing window: largest order and top three orders vs limits."""
    led = Ledger.of(orders, by, ref_date)
    recent = led.recent(days - 1)
    totals = (
        recent.filter(F.col("order_id").isNotNull())
        .groupBy(*led.by, "order_id")
        .agg(total("amount").alias("order_total"))
    )
    whole = recent.groupBy(*led.by).agg(total("amount").alias("_all"))
    over = attach(totals, whole, led.by).filter(F.col("order_total") > F.col("_all") * F.lit(single).cast("decimal(4,2)"))
    flagged = over.groupBy(*led.by).agg(F.count(F.lit(1)).alias("orders_over_limit"))
    best = top_n_sum(totals, led.by, "order_total", 3)
    joined = attach(attach(whole, best, led.by), flagged, led.by)
    share = F.try_divide(num("top_total"), num("_all"))
    return joined.select(
        *led.by,
        num("_all").alias("window_revenue"),
        F.coalesce("orders_over_limit", F.lit(0)).alias("orders_over_limit"),
        share.alias("top3_share"),
        F.coalesce(share > top3, F.lit(False)).alias("top3_alert"),
    )
