"""Revenue KPIs over the whole history: months, growth, repeat share, concentration, volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, group_window, match, stored
from tallybrook.functions.ordering import top_share_sum
from tallybrook.functions.scalars import change, month_label, month_length, num, ratio, total
from tallybrook.ledger import Ledger


def monthly_revenue(orders, by=()) -> DataFrame:
    """by, month, revenue, orders, aov, days_with_data, days_in_month."""
    led = Ledger.of(orders, by)
    keys = [*led.by, "month_start"]
    if led.kept:  # a day is a single row, and an order of a month too, so nothing is expanded to count them
        dates = led.daily.filter(F.col("day").isNotNull()).groupBy(*led.by, F.trunc("day", "month").alias("month_start")).agg(
            total("amount").alias("_rev"), F.count(F.lit(1)).alias("days_with_data")
        )
        months = match(dates, _orders_by_month(led), keys, "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    else:
        months = (
            led.order_days(led.sales)
            .withColumn("month_start", F.trunc("day", "month"))
            .groupBy(*keys)
            .agg(
                total("amount").alias("_rev"),
                F.countDistinct("order_id").alias("orders"),
                F.countDistinct("day").alias("days_with_data"),
            )
            .filter(F.col("month_start").isNotNull())
        )
    return months.select(
        *led.by,
        month_label("month_start").alias("month"),
        num("_rev").alias("revenue"),
        "orders",
        F.try_divide(num("_rev"), num("orders")).alias("aov"),
        "days_with_data",
        month_length("month_start").alias("days_in_month"),
    )


def _orders_by_month(led: Ledger) -> DataFrame:
    """Orders with a line in a month, from the written views.

    Most orders have one month, which is in their rollup; those with more are looked up by day.
    """
    keys, order = [*led.by, "month_start"], [*led.by, "order_id"]

    def looked_up(sales: DataFrame) -> DataFrame:
        pairs = sales.filter(F.col("day").isNotNull() & F.col("order_id").isNotNull())
        pairs = pairs.select(*order, F.trunc("day", "month").alias("month_start")).distinct()
        return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"))

    if led.kept_rollup("placed") is None:
        return looked_up(led.sales)
    first, last = F.col("first_month"), F.col("last_month")
    once = led.placed.filter(first == last).groupBy(*led.by, first.alias("month_start")).agg(F.count(F.lit(1)).alias("orders"))
    several = stored(led.placed.filter(first < last).select(*order))  # so that the planner sees how few they are
    if several.isEmpty():
        return once
    both = once.unionByName(looked_up(match(led.sales, several, order, "left_semi")))
    return both.groupBy(*keys).agg(F.sum("orders").alias("orders"))


def mom_growth(orders, by=()) -> DataFrame:
    """Revenue growth over the previous month with data; null from a zero month."""
    led = Ledger.of(orders, by)
    before = group_window(led.by).orderBy("month")
    months = monthly_revenue(led).select(*led.by, "month", "revenue", F.lag("revenue").over(before).alias("_prev"))
    growth = F.when(F.col("_prev") != 0, F.col("revenue") / F.col("_prev") - 1)
    return months.select(*led.by, "month", "revenue", growth.alias("mom_growth"))


def latest_months(orders, by=()) -> DataFrame:
    """Partial-month detection and changes of the latest complete month, one row per store.

    When the last month has data on fewer than half of its days it is skipped; a
    change then needs three months, otherwise two.
    """
    led = Ledger.of(orders, by)
    recent = group_window(led.by).orderBy(F.desc("month"))
    numbered = monthly_revenue(led).withColumn("_back", F.row_number().over(recent))
    entry = F.struct("month", "revenue", "orders", "aov", "days_with_data", "days_in_month")

    def back(n: int) -> Column:
        return F.max(F.when(F.col("_back") == n, entry)).alias(f"m{n}")

    wide = numbered.groupBy(*led.by).agg(F.count(F.lit(1)).alias("months"), back(1), back(2), back(3))
    partial = F.col("m1.days_with_data") < F.col("m1.days_in_month") / 2
    ready = F.col("months") >= F.when(F.col("partial_last_month"), 3).otherwise(2)

    def moved(k: str) -> tuple[Column, Column]:
        skip = F.col("partial_last_month")
        return (
            F.when(skip, num(f"m2.{k}")).otherwise(num(f"m1.{k}")),
            F.when(skip, num(f"m3.{k}")).otherwise(num(f"m2.{k}")),
        )

    def against_zero_is_zero(k: str) -> Column:
        cur, prev = moved(k)
        return F.when(ready, F.coalesce(F.try_divide(cur - prev, prev), F.lit(0.0)))

    cur_rev, prev_rev = moved("revenue")
    return wide.withColumn("partial_last_month", partial).select(
        *led.by,
        "months",
        F.col("m1.month").alias("last_month"),
        F.col("m1.days_with_data").alias("last_month_days"),
        "partial_last_month",
        F.when(ready & (prev_rev != 0), cur_rev / prev_rev - 1).alias("mom_growth_latest"),
        against_zero_is_zero("aov").alias("aov_change"),
        against_zero_is_zero("orders").alias("order_count_change"),
    )


def repeat_revenue_share(orders, by=()) -> DataFrame:
    """Revenue outside the customers' first order days ÷ all revenue; guests repeat.

    First-day revenue is the amount of each customer's earliest day, found by two
    aggregations: (customer, day), then customer.  No join back to the lines.
    """
    led = Ledger.of(orders, by)
    if led.kept_rollup("clients") is not None:
        first = led.clients.filter(F.col("first_day").isNotNull()).select(*led.by, F.col("first_revenue").alias("amount"))
    else:
        days = (
            led.sales.filter(F.col("customer_id").isNotNull() & F.col("day").isNotNull())
            .groupBy(*led.by, "customer_id", "day")
            .agg(total("amount").alias("amount"))
        )
        first = days.groupBy(*led.by, "customer_id").agg(F.min_by("amount", "day").alias("amount"))
    fresh = first.groupBy(*led.by).agg(total("amount").alias("_first"))
    whole = led.daily.groupBy(*led.by).agg(total("amount").alias("_all"))
    joined = attach(whole, fresh, led.by)
    repeat = F.col("_all") - F.coalesce(F.col("_first"), F.lit(0))
    return joined.select(
        *led.by,
        num("_all").alias("total_revenue"),
        num(repeat).alias("repeat_revenue"),
        ratio(repeat, "_all").alias("repeat_revenue_share"),
    )


def avg_discount_rate(orders, by=()) -> DataFrame:
    """Discount ÷ (amount + discount); 0 without discounts."""
    led = Ledger.of(orders, by)
    sums = led.daily.groupBy(*led.by).agg(total("discount").alias("_d"), total("gross").alias("_g"))
    return sums.select(*led.by, num("_d").alias("discount"), ratio("_d", "_g").alias("avg_discount_rate"))


def customer_revenue(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    if led.kept_rollup("clients") is not None:
        return led.clients.select(*led.by, "customer_id", "revenue")
    known = led.sales.filter(F.col("customer_id").isNotNull())
    return known.groupBy(*led.by, "customer_id").agg(total("amount").alias("revenue"))


def top_customer_share(orders, by=(), fraction: float = 0.1) -> DataFrame:
    """Share of all revenue (guests included) from the top ``fraction`` of customers."""
    led = Ledger.of(orders, by)
    top = top_share_sum(customer_revenue(led), led.by, "revenue", fraction, led.few)
    whole = led.daily.groupBy(*led.by).agg(total("amount").alias("_all"))
    return attach(whole, top, led.by).select(
        *led.by,
        F.coalesce("group_rows", F.lit(0)).alias("customers"),
        F.col("top_k").alias("top_customers"),
        num("top_total").alias("top_revenue"),
        ratio("top_total", "_all").alias("top_share"),
    )


def daily_revenue_cv(orders, by=()) -> DataFrame:
    """Sample standard deviation ÷ mean of revenue over days with data; null below two days."""
    led = Ledger.of(orders, by)
    days = (
        led.daily.filter(F.col("day").isNotNull())
        .groupBy(*led.by, "day")
        .agg(num(total("amount")).alias("revenue"))
    )
    stats = days.groupBy(*led.by).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("revenue").alias("mean_revenue"),
        F.try_divide(F.stddev_samp("revenue"), F.avg("revenue")).alias("daily_revenue_cv"),
    )
    return stats


def monthly_revenue_cv(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    return monthly_revenue(led).groupBy(*led.by).agg(
        F.try_divide(F.stddev_samp("revenue"), F.avg("revenue")).alias("monthly_revenue_cv")
    )


def stability_score(orders, by=()) -> DataFrame:
    """Repeat revenue share × (1 − CV of monthly revenue)."""
    led = Ledger.of(orders, by)
    both = attach(repeat_revenue_share(led), monthly_revenue_cv(led), led.by)
    return both.select(
        *led.by,
        "repeat_revenue_share",
        "monthly_revenue_cv",
        (F.col("repeat_revenue_share") * (1 - F.col("monthly_revenue_cv"))).alias("stability_score"),
    )


def seasonal_share(orders, by=(), ref_date=None, grain: str = "quarter") -> DataFrame:
    """Quarters or months of the trailing year: value, share of the year, ratio to the mean of
    the others."""
    from tallybrook.operators.kpis import monthly_trend

    led = Ledger.of(orders, by, ref_date)
    start = F.to_date(F.concat("month", F.lit("-01")))
    labels = {
        "quarter": F.concat_ws("-Q", F.year(start).cast("string"), F.quarter(start).cast("string")),
        "month": F.col("month"),
    }
    quarters = (
        monthly_trend(led)
        .groupBy(*led.by, labels[grain].alias(grain))
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("months"))
    )
    year, n = F.sum("revenue").over(group_window(led.by)), F.count(F.lit(1)).over(group_window(led.by))
    rest = F.try_divide(year - F.col("revenue"), n - 1)
    return quarters.select(
        *led.by,
        grain,
        "revenue",
        "orders",
        "months",
        F.try_divide(F.col("revenue"), year).alias("year_share"),
        F.try_divide(F.col("revenue"), rest).alias(f"vs_other_{grain}s"),
    )
