"""Calendar windows, data coverage and dataset metadata."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach
from tallybrook.functions.scalars import month_label, num, total, whole_days
from tallybrook.ledger import Ledger

# Window length and the data span a window needs, in days.
PERIOD_DAYS = {"30d": 30, "90d": 90, "365d": 365}
COVERAGE_DAYS = {"30d": 45, "90d": 120, "365d": 400}

# Fixed values of the metadata block.
CURRENCY = "USD"
REVENUE_DEFINITION = "Net sales after discounts, before tax and shipping"


def trailing_window(ref: date, days: int) -> tuple[str, date, date]:
    """(label, start, end) of the ``days`` days ending at ``ref``, both inclusive."""
    return f"Past {days} Days", ref - timedelta(days=days - 1), ref


def prior_trailing_window(ref: date, days: int) -> tuple[str, date, date]:
    """The equally long window that ends the day before the trailing one starts."""
    return f"Prior {days} Days", ref - timedelta(days=2 * days - 1), ref - timedelta(days=days)


def window_rules() -> list[tuple[str, str, str, int, int]]:
    """(period, side, label, newest, oldest) with bounds as days before the reference date."""
    rules = []
    for period, days in PERIOD_DAYS.items():
        rules.append((period, "current", f"Past {days} Days", 0, days - 1))
        rules.append((period, "prior", f"Prior {days} Days", days, 2 * days - 1))
    return rules


def period_windows(orders, by=(), ref_date=None) -> DataFrame:
    """by, period, side, label, period_start, period_end: six rows per store."""
    led = Ledger.of(orders, by, ref_date)
    rule = F.array(
        *[
            F.struct(
                F.lit(p).alias("period"),
                F.lit(s).alias("side"),
                F.lit(label).alias("label"),
                F.date_sub("ref", old).alias("period_start"),
                F.date_sub("ref", new).alias("period_end"),
            )
            for p, s, label, new, old in window_rules()
        ]
    )
    return led.reference.select(*led.by, F.inline(rule))


def month_slices(orders, by=(), ref_date=None, days: int = 365) -> DataFrame:
    """Calendar months of the trailing window, each clipped to it."""
    led = Ledger.of(orders, by, ref_date)
    start = F.date_sub("ref", days - 1)
    first = F.explode(F.sequence(F.trunc(start, "month"), F.col("ref"), F.expr("interval 1 month")))
    months = led.reference.select(*led.by, "ref", first.alias("first"))
    return months.select(
        *led.by,
        month_label("first").alias("month"),
        F.greatest("first", start).alias("period_start"),
        F.least(F.last_day("first"), "ref").alias("period_end"),
    )


def metadata(orders, by=()) -> DataFrame:
    """Data range, distinct orders and customers, total revenue."""
    led = Ledger.of(orders, by)
    return led.order_days(led.sales).groupBy(*led.by).agg(
        F.min("day").alias("data_start"),
        F.max("day").alias("data_end"),
        F.countDistinct("order_id").alias("total_orders"),
        F.countDistinct("customer_id").alias("total_customers"),
        num(total("amount")).alias("total_revenue"),
        F.lit(CURRENCY).alias("currency"),
        F.lit(REVENUE_DEFINITION).alias("revenue_definition"),
    )


def data_span(orders, by=()) -> DataFrame:
    """Whole days between the first and the last order timestamp."""
    led = Ledger.of(orders, by)
    ends = led.daily.groupBy(*led.by).agg(F.min("first_ts").alias("a"), F.max("last_ts").alias("b"))
    return ends.select(*led.by, F.col("a").alias("first_ts"), F.col("b").alias("last_ts"), whole_days("a", "b").alias("span_days"))


def data_coverage(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    return data_span(led).select(
        *led.by,
        "span_days",
        *[(F.col("span_days") >= need).alias(f"covered_{p}") for p, need in COVERAGE_DAYS.items()],
    )


def annual_revenue(orders, by=()) -> DataFrame:
    """Revenue scaled to 365 days when the data is shorter; never below 0.

    The whole total is kept for longer histories; see ``trailing_year_revenue``.
    """
    led = Ledger.of(orders, by)
    ends = led.daily.groupBy(*led.by).agg(
        whole_days(F.min("first_ts"), F.max("last_ts")).alias("span_days"),
        num(total("amount")).alias("total_revenue"),
    )
    short = (F.col("span_days") > 0) & (F.col("span_days") < 365)
    scaled = F.when(short, F.col("total_revenue") * (F.lit(365.0) / F.col("span_days"))).otherwise(F.col("total_revenue"))
    return ends.withColumn("annual_revenue", F.greatest(scaled, F.lit(0.0)))


def trailing_year_revenue(orders, by=(), ref_date=None, days: int = 365) -> DataFrame:
    """Revenue of the last ``days`` days up to the reference date; 0 without sales in them."""
    led = Ledger.of(orders, by, ref_date)
    sums = led.recent_sales(days - 1).groupBy(*led.by).agg(total("amount").alias("_sum"))
    found = attach(led.reference, sums, led.by)
    return found.select(*led.by, F.col("ref").alias("until"), num(F.coalesce("_sum", F.lit(0))).alias("trailing_year_revenue"))
