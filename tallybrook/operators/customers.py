"""Customer operators: cohorts, repeat purchase, intervals, RFM, funnel, lapsed customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, durable, group_window
from tallybrook.functions.ordering import quantiles, ranked
from tallybrook.functions.scalars import num, total, whole_days
from tallybrook.ledger import Ledger

# Segment names.
CHAMPIONS = "Champions"
LOYAL = "Loyal"
NEW_CUSTOMERS = "New Customers"
AT_RISK = "At Risk"
LOST = "Lost"
POTENTIAL = "Potential"


def cohort_month(orders, by=()) -> DataFrame:
    """First order month of every known customer."""
    led = Ledger.of(orders, by)
    return led.first_days.select(*led.by, "customer_id", F.trunc("first_day", "month").alias("cohort_month"))


def with_cohort_month(orders, by=()) -> DataFrame:
    """Order lines with the customer's cohort month; null for guests."""
    led = Ledger.of(orders, by)
    return led.with_first_day(led.lines).withColumn("cohort_month", F.trunc("first_day", "month")).drop("first_day")


def orders_per_customer(orders, by=()) -> DataFrame:
    """Distinct orders of each known customer: two additive steps, no distinct set per customer."""
    led = Ledger.of(orders, by)
    if led.kept_rollup("clients") is not None:
        return led.clients.select(*led.by, "customer_id", "orders")
    known = led.sales.filter(F.col("customer_id").isNotNull())
    pairs = known.select(*led.by, "customer_id", "order_id").distinct()
    return pairs.groupBy(*led.by, "customer_id").agg(F.count("order_id").alias("orders"))


def repeat_purchase_rate(orders, by=()) -> DataFrame:
    """Share of known customers with at least two distinct orders; 0 without customers."""
    led = Ledger.of(orders, by)
    return orders_per_customer(led).groupBy(*led.by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("orders") >= 2).alias("repeat_customers"),
        F.coalesce(F.avg((F.col("orders") >= 2).cast("double")), F.lit(0.0)).alias("repeat_purchase_rate"),
    )


def purchase_interval(orders, by=()) -> DataFrame:
    """Mean over customers of the mean whole-day gap between consecutive order lines.

    The gaps are summed by customer in ``Ledger.client_days``, over days instead of lines.
    """
    led = Ledger.of(orders, by)
    each = led.client_days if led.kept_rollup("clients") is None else led.clients
    each = each.filter(F.col("dated_lines").isNotNull()).withColumnRenamed("dated_lines", "lines")
    mean_gap = F.when(F.col("lines") >= 2, F.col("gap") / (F.col("lines") - 1))
    return each.groupBy(*led.by).agg(
        F.count(mean_gap).alias("customers_with_gaps"), F.avg(mean_gap).alias("avg_purchase_interval_days")
    )


# Day numbers from 0001-01-01 on have so many binary digits.
DAY_DIGITS, DAY_ZERO = 22, 719162


def days_to_second_order(orders, by=()) -> DataFrame:
    """Whole days from a customer's first order to the next one at another time: count, mean
    and exact median over the customers that have one.

    An order counts with its earliest line.  The two earliest times come from one aggregation
    that combines before the shuffle, whatever a customer's orders are: the second day differs
    from the first in some binary digit of its number, and for each digit the earliest times
    with 0 and with 1 are kept.  A second time on the first day is no whole day away.
    """
    led = Ledger.of(orders, by)
    known = led.sales.filter(F.col("customer_id").isNotNull() & F.col("order_id").isNotNull() & F.col("first_ts").isNotNull())
    placed = known.groupBy(*led.by, "customer_id", "order_id").agg(F.min("first_ts").alias("t"))
    days = placed.groupBy(*led.by, "customer_id", F.to_date("t").alias("day")).agg(F.min("t").alias("t"), F.max("t").alias("latest"))
    digit = lambda day, i: F.getbit(F.unix_date(day) + DAY_ZERO, F.lit(i))
    cells = [(i, bit) for i in range(DAY_DIGITS) for bit in (0, 1)]
    each = days.groupBy(*led.by, "customer_id").agg(
        F.min("t").alias("first"),
        F.min_by("latest", "t").alias("latest"),
        *[F.min(F.when(digit("day", i) == bit, F.col("t"))).alias(f"t{i}_{bit}") for i, bit in cells],
    )
    other = [F.when(digit(F.to_date("first"), i) == 0, F.col(f"t{i}_1")).otherwise(F.col(f"t{i}_0")) for i in range(DAY_DIGITS)]
    gap = F.when(F.col("latest") > F.col("first"), 0).otherwise(whole_days("first", F.least(*other)))
    gaps = each.select(*led.by, gap.cast("long").alias("gap")).filter(F.col("gap").isNotNull())
    means = gaps.groupBy(*led.by).agg(F.count("gap").alias("customers"), F.avg("gap").alias("avg_days"))
    middle = quantiles(gaps, led.by, "gap", {"median_days": 0.5}, bounded=True)
    return attach(means, middle.select(*led.by, "median_days"), led.by)


def rfm_base(orders, by=()) -> DataFrame:
    """Recency in whole days before the newest order, distinct orders, revenue per customer."""
    led = Ledger.of(orders, by)
    newest = led.few(led.daily.groupBy(*led.by).agg(F.max("last_ts").alias("_now")))
    if led.kept_rollup("clients") is not None:
        base = led.clients.select(
            *led.by, "customer_id", F.col("last_ts").alias("_last"), F.col("orders").alias("frequency"), F.col("revenue").alias("monetary")
        )
    else:
        known = led.sales.filter(F.col("customer_id").isNotNull())
        per_order = known.groupBy(*led.by, "customer_id", "order_id").agg(
            F.max("last_ts").alias("last_ts"), F.sum("amount").alias("amount")
        )
        base = per_order.groupBy(*led.by, "customer_id").agg(
            F.max("last_ts").alias("_last"), F.count("order_id").alias("frequency"), total("amount").alias("monetary")
        )
    return attach(base, newest, led.by).select(
        *led.by, "customer_id", whole_days("_last", "_now").alias("recency_days"), "frequency", "monetary"
    )


def _rank_score(rank: Column, rows: Column, segments: int) -> Column:
    """Quantile bin 1..segments of a unique rank among ``rows`` ranks; null for a single row."""
    place = F.ceil(F.lit(float(segments)) * (rank - 1) / (rows - 1))
    return F.when(rows > 1, F.greatest(F.lit(1), place)).cast("long")


def _segment(r: Column, f: Column) -> Column:
    return (
        F.when((r >= 4) & (f >= 4), CHAMPIONS)
        .when((r >= 3) & (f >= 3), LOYAL)
        .when((r >= 4) & (f <= 2), NEW_CUSTOMERS)
        .when((r <= 2) & (f >= 3), AT_RISK)
        .when((r <= 2) & (f <= 2), LOST)
        .otherwise(POTENTIAL)
    )


def rfm_segments(orders, by=(), n_segments: int = 5) -> DataFrame:
    """R, F and M scores and the segment of every known customer.

    Recency is binned by value with repeated edges dropped, so low scores may be
    missing and all-equal recency has no score.  Frequency and revenue are binned
    by rank, ties in customer order.
    """
    led = Ledger.of(orders, by)
    by = led.by
    base = durable(rfm_base(led))
    steps = {f"e{i}": i / n_segments for i in range(n_segments + 1)}
    first = ranked(base, by, ["frequency", "customer_id"]).withColumnRenamed("rank", "_f_rank").drop("group_rows")
    both = ranked(first, by, ["monetary", "customer_id"]).withColumnRenamed("rank", "_m_rank")
    edges = quantiles(base, by, "recency_days", steps, bounded=True)
    edges = edges.select(*by, F.array_distinct(F.array(*[F.round(c, 9) for c in steps])).alias("_edges"))
    joined = attach(both, led.few(edges), by)

    below = F.size(F.filter("_edges", lambda e: e < F.col("recency_days")))
    r = F.when(F.size("_edges") >= 2, F.lit(n_segments) - F.greatest(below - 1, F.lit(0))).cast("long")
    f = _rank_score(F.col("_f_rank"), F.col("group_rows"), n_segments)
    m = _rank_score(F.col("_m_rank"), F.col("group_rows"), n_segments)
    return joined.select(
        *by,
        "customer_id",
        "recency_days",
        "frequency",
        num("monetary").alias("monetary"),
        r.alias("r_score"),
        f.alias("f_score"),
        m.alias("m_score"),
        (r + f + m).alias("rfm_sum"),
        _segment(r, f).alias("segment"),
    )


def segment_shares(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    counts = rfm_segments(led).groupBy(*led.by, "segment").agg(F.count(F.lit(1)).alias("customers"))
    whole = F.sum("customers").over(group_window(led.by))
    return counts.select(*led.by, "segment", "customers", (num("customers") / whole).alias("share"))


def purchase_funnel(orders, by=()) -> DataFrame:
    """For each order count n: customers with at least n orders, the share that
    places order n+1, and mean revenue relative to one-time buyers."""
    led = Ledger.of(orders, by)
    per_order = (
        led.sales.filter(F.col("customer_id").isNotNull())
        .groupBy(*led.by, "customer_id", "order_id")
        .agg(F.sum("amount").alias("amount"))
    )
    each = per_order.groupBy(*led.by, "customer_id").agg(
        F.count("order_id").alias("n"), total("amount").alias("amount")
    )
    steps = each.groupBy(*led.by, "n").agg(F.count(F.lit(1)).alias("customers"), F.sum("amount").alias("amount"))
    # One row per distinct order count, pre-aggregated over all customers.
    down = group_window(led.by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    up = group_window(led.by).orderBy("n")
    reached = steps.withColumn("reached", F.sum("customers").over(down))
    mean_value = num("amount") / F.col("customers")
    return reached.select(
        *led.by,
        F.col("n").alias("purchase_count"),
        "customers",
        "reached",
        F.try_divide(num(F.col("reached") - F.col("customers")), num("reached")).alias("next_conversion"),
        mean_value.alias("mean_revenue"),
        F.try_divide(mean_value, F.first(mean_value).over(up)).alias("relative_value"),
    )


def lapsed_customers(orders, by=(), ref_date=None, newest: int = 60, oldest: int = 120) -> DataFrame:
    """Customers whose last order lies ``newest``..``oldest`` days before the reference date."""
    led = Ledger.of(orders, by, ref_date)
    known = led.sales.filter(F.col("customer_id").isNotNull())
    if led.ref_date:
        known = known.filter(F.col("day") <= F.lit(led.ref_date))
    last = known.groupBy(*led.by, "customer_id").agg(F.max("day").alias("last_day"))
    aged = led.with_reference(last).withColumn("days_since", F.date_diff("ref", "last_day"))
    return aged.filter(F.col("days_since").between(newest, oldest)).drop("ref")
