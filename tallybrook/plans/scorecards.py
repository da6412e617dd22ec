"""Rule tables on top of the KPIs: trajectory, scoreboard, risks, benchmarks, impact models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import durable, gather
from tallybrook.functions.impact import constant_volume_recovery, discount_recovery, repeat_rate_uplift, repeat_share_shift
from tallybrook.functions.scalars import num
from tallybrook.ledger import Ledger
from tallybrook.operators import customers, kpis, periods, pricing, products, revenue
from tallybrook.plans import rules
from tallybrook.plans.checks import graded


def trajectory(orders, by=(), ref_date=None) -> DataFrame:
    """Label of each period's revenue change."""
    led = Ledger.of(orders, by, ref_date)
    moved = F.col("revenue_change")
    label = F.when(moved > rules.STRONG_GROWTH, "strong").when(moved >= rules.DECLINE, "stable").when(
        moved < rules.DECLINE, "declining"
    )
    return kpis.period_blocks(led).select(*led.by, "period", "revenue_change", label.alias("trajectory"))


def scoreboard(orders, by=(), ref_date=None) -> DataFrame:
    """Value and change of the four headline KPIs, one column pair per window."""
    led = Ledger.of(orders, by, ref_date)
    rows = kpis.period_comparison(led).filter(F.col("kpi").isin("revenue", "orders", "aov", "customers"))
    windows = list(periods.PERIOD_DAYS)
    wide = rows.groupBy(*led.by, "kpi").pivot("period", windows).agg(
        F.first("current").alias("value"), F.first("change").alias("change")
    )
    return wide.select(*led.by, "kpi", *[F.col(f"{p}_{m}").alias(f"{m}_{p}") for p in windows for m in ("value", "change")])


def _bands(value: Column, high: Column, medium: Column) -> Column:
    return F.when(value.isNull(), F.lit(None)).when(high, "high").when(medium, "medium").otherwise("low")


def risk_rubric(orders, by=(), ref_date=None, period: str = "365d") -> DataFrame:
    """Six risk factors with their value and severity.

    Rollups that were not kept before are shared by all factors and released afterwards.
    """
    led = Ledger.of(orders, by, ref_date)
    own = not led.kept
    if own:
        led.keep("goods")
    parts = [
        kpis.period_blocks(led)
        .filter(F.col("period") == period)
        .select(*led.by, "returning_customer_revenue_share", "revenue_change", "customers_change"),
        pricing.discount_dependency(led),
        revenue.daily_revenue_cv(led).select(*led.by, "daily_revenue_cv"),
    ]
    if led.product_key:
        parts += [
            products.top_n_share(led, n=1).select(*led.by, "top_share"),
            products.stage_shares(led).select(*led.by, "decline_share"),
        ]
    wide = gather(parts, led.by)
    if not led.product_key:
        wide = wide.withColumns({c: F.lit(None).cast("double") for c in ("top_share", "decline_share")})
    c = F.col
    declines = F.coalesce((c("revenue_change") < 0).cast("int"), F.lit(0)) + F.coalesce(
        (c("customers_change") < 0).cast("int"), F.lit(0)
    )
    rising = c("discount_rate_trend") == "increasing"
    factors = {
        "Revenue Concentration": (c("top_share"), c("top_share") > 0.5, c("top_share") >= 0.3),
        "Acquisition Dependency": (
            c("returning_customer_revenue_share"),
            c("returning_customer_revenue_share") < 0.3,
            c("returning_customer_revenue_share") <= 0.4,
        ),
        "Discount Dependency": (
            c("avg_discount_rate"),
            (c("avg_discount_rate") > 0.25) | rising,
            c("avg_discount_rate") >= 0.15,
        ),
        "Product Lifecycle": (c("decline_share"), c("decline_share") > 0.5, c("decline_share") >= 0.3),
        "Growth Sustainability": (num(declines), declines == 2, declines == 1),
        "Revenue Volatility": (c("daily_revenue_cv"), c("daily_revenue_cv") > 0.8, c("daily_revenue_cv") >= 0.5),
    }
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("risk_factor"), v.alias("value"), _bands(v, hi, mid).alias("severity"))
            for name, (v, hi, mid) in factors.items()
        ]
    )
    found = wide.select(*led.by, F.inline(rows)).filter(F.col("severity").isNotNull())
    if not own:
        return found
    found = durable(found)
    led.release()
    return found


def benchmark_grades(orders, by=()) -> DataFrame:
    """Repeat rate, AOV, discount rate and gross margin graded against each vertical."""
    led = Ledger.of(orders, by)
    parts = [
        periods.metadata(led).select(*led.by, F.try_divide("total_revenue", num("total_orders")).alias("aov")),
        customers.repeat_purchase_rate(led).select(*led.by, "repeat_purchase_rate"),
        pricing.margin_summary(led).select(*led.by, F.col("overall_margin").alias("gross_margin")),
        revenue.avg_discount_rate(led).select(*led.by, "avg_discount_rate"),
    ]
    wide = gather(parts, led.by)
    values = {
        "repeat_purchase_rate": F.col("repeat_purchase_rate"),
        "aov": F.col("aov"),
        "discount_rate": F.col("avg_discount_rate") if led.has("discount") else F.lit(None).cast("double"),
        "gross_margin": F.col("gross_margin"),
    }
    grades = F.array(
        *[
            F.struct(
                F.lit(vertical).alias("vertical"),
                F.lit(kpi).alias("kpi"),
                values[kpi].alias("value"),
                graded(values[kpi], op, good, fair).alias("result"),
            )
            for vertical, kpi, op, good, fair in rules.BENCHMARKS
        ]
    )
    return wide.select(*led.by, F.inline(grades)).filter(F.col("value").isNotNull())


def impact_models(
    orders,
    by=(),
    ref_date=None,
    relative_uplift: float = 0.05,
    share_step: float = 0.05,
    acquisition_cost: float = 40.0,
    retention_cost: float = 5.0,
    reduction: float = 0.01,
    elasticity: float = -1.5,
) -> DataFrame:
    """The impact models fed with the store's own KPIs of the trailing year."""
    led = Ledger.of(orders, by, ref_date)
    year = kpis.period_summary(led).filter((F.col("period") == "365d") & (F.col("side") == "current"))
    per_customer = customers.orders_per_customer(led).filter(F.col("orders") >= 2)
    loyal = per_customer.groupBy(*led.by).agg(F.avg(num("orders")).alias("orders_per_repeater"))
    parts = [
        year.drop("period", "side", "label", "period_start", "period_end"),
        loyal,
        customers.repeat_purchase_rate(led).select(*led.by, "repeat_purchase_rate"),
        revenue.repeat_revenue_share(led).select(*led.by, "repeat_revenue_share"),
        pricing.margin_summary(led).select(*led.by, "overall_margin"),
    ]
    wide = gather(parts, led.by)
    list_price = F.try_divide(num("aov"), 1 - F.col("avg_discount_rate"))
    unit_cost = num("aov") * (1 - F.coalesce("overall_margin", F.lit(1.0)))
    shift = repeat_share_shift(
        "revenue", share_step, "new_customer_aov", acquisition_cost, retention_cost,
    )
    saved = discount_recovery(list_price, unit_cost, "avg_discount_rate", reduction, elasticity, "orders")
    return wide.select(
        *led.by,
        repeat_rate_uplift(
            "new_customers", "repeat_purchase_rate", relative_uplift, "orders_per_repeater", "returning_customer_aov"
        ).alias("repeat_rate_uplift"),
        *[c.alias(name) for name, c in (shift | saved).items()],
        constant_volume_recovery("revenue", "avg_discount_rate", reduction).alias("constant_volume_recovery"),
    )
