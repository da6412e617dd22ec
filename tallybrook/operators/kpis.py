"""Period KPIs: summaries, comparisons, blocks with drivers, monthly trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach
from tallybrook.functions.scalars import cents, change, month_label, month_length, num, ratio, total
from tallybrook.ledger import Ledger
from tallybrook.operators.periods import period_windows, window_rules

# Names of the summary's fields.
SUMMARY = (
    "revenue",
    "orders",
    "aov",
    "customers",
    "new_customers",
    "returning_customers",
    "new_customer_revenue",
    "returning_customer_revenue",
    "new_customer_aov",
    "returning_customer_aov",
    "avg_discount_rate",
)


def _summarise(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """KPIs per key of rows that carry ``is_new`` (customer's first day inside the window).

    Rows are order days, so the distinct counts expand a frame much smaller than the lines.
    """
    new = F.col("is_new")
    sums = rows.groupBy(*keys).agg(
        total("amount").alias("_rev"),
        total(F.when(new, F.col("amount"))).alias("_new_rev"),
        total(F.when(~new, F.col("amount"))).alias("_ret_rev"),
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct(F.when(new, F.col("customer_id"))).alias("new_customers"),
        F.countDistinct(F.when(new, F.col("order_id"))).alias("_new_orders"),
        F.countDistinct(F.when(~new, F.col("order_id"))).alias("_ret_orders"),
        total("discount").alias("_disc"),
        total("gross").alias("_gross"),
        *more,
    )
    return _kpis(sums, keys, sums.columns[len(keys) + 10 :])


def _kpis(sums: DataFrame, keys: list[str], extra=()) -> DataFrame:
    """KPIs from the sums behind them."""
    return sums.select(
        *keys,
        num("_rev").alias("revenue"),
        "orders",
        ratio("_rev", "orders").alias("aov"),
        "customers",
        "new_customers",
        (F.col("customers") - F.col("new_customers")).alias("returning_customers"),
        num("_new_rev").alias("new_customer_revenue"),
        num("_ret_rev").alias("returning_customer_revenue"),
        ratio("_new_rev", "_new_orders").alias("new_customer_aov"),
        ratio("_ret_rev", "_ret_orders").alias("returning_customer_aov"),
        ratio("_disc", "_gross").alias("avg_discount_rate"),
        *extra,
    )


MEASURES = ("amount", "discount", "gross")
FACTS = ("_rev", "_new_rev", "_ret_rev", "orders", "customers", "new_customers", "_new_orders", "_ret_orders", "_disc", "_gross", "_guest_rev", "_guest_orders")


def _bands() -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Disjoint ranges of age in days (from, below), and those that make up each window."""
    windows = window_rules()
    edges = sorted({age for *_, newest, oldest in windows for age in (newest, oldest + 1)})
    bands = list(zip(edges, edges[1:]))
    return bands, [[b for b, (low, high) in enumerate(bands) if newest <= low and high <= oldest + 1] for *_, newest, oldest in windows]


def _band(age: Column, bands: list[tuple[int, int]]) -> Column:
    """Number of the band that an age lies in, null outside all of them."""
    out = F.when(age < bands[0][0], None)
    for b, (_, below) in enumerate(bands):
        out = out.when(age < below, b)
    return out


def _window_sums(led: Ledger) -> DataFrame:
    """by, period, side and the sums behind the KPIs of each window with order lines.

    Two branches: the lines of the windows, and over the whole history no more than each
    customer's first day.  Windows overlap, so lines are summed by disjoint bands of age, by
    order and customer and then by customer, as whole ten-thousandths.  A bit per band tells
    where an order or customer occurs.  Guests (null customer) are one sum that counts as
    returning and stay outside the join.
    """
    by, (bands, parts) = led.by, _bands()
    masks = [sum(1 << b for b in part) for part in parts]
    cells = [(m, b) for m in MEASURES for b in range(len(bands))]
    here = lambda i: F.col("mask").bitwiseAND(masks[i]) != 0
    found_in = range(len(parts))

    rows = led.recent_sales(bands[-1][1] - 1).withColumn("band", _band(F.date_diff("ref", "day"), bands))
    bit = F.call_function("shiftleft", F.lit(1), F.col("band"))
    whole = [F.sum(F.when(F.col("band") == b, (F.col(m) * 10000).cast("long"))).alias(f"{m}{b}") for m, b in cells]
    pairs = rows.groupBy(*by, "order_id", "customer_id").agg(F.bit_or(bit).alias("mask"), *whole)

    by_order = pairs.filter(F.col("order_id").isNotNull()).groupBy(*by, "order_id").agg(F.bit_or("mask").alias("mask"))
    orders = by_order.groupBy(*by).agg(*[F.count_if(here(i)).alias(f"orders{i}") for i in found_in])

    named = F.col("order_id").isNotNull()
    counts = [F.count_if(here(i) & named).alias(f"n{i}") for i in found_in]
    known = pairs.filter(F.col("customer_id").isNotNull())
    known = known.groupBy(*by, "customer_id").agg(F.bit_or("mask").alias("mask"), *counts, *[F.sum(f"{m}{b}").alias(f"{m}{b}") for m, b in cells])
    exact = "decimal(38,4)"
    money = [(F.col(f"{m}{b}").cast("decimal(23,0)") / 10000).cast(exact).alias(f"{m}{b}") for m, b in cells]
    known = led.with_reference(led.with_first_day(known))
    known = known.select(*by, F.lit(False).alias("guest"), "mask", *[f"n{i}" for i in found_in], *money, _band(F.date_diff("ref", "first_day"), bands).alias("first_band"))
    guests = pairs.filter(F.col("customer_id").isNull()).groupBy(*by).agg(
        F.lit(0).alias("mask"), *counts, *[F.sum(F.col(f"{m}{b}").cast("decimal(23,0)")).alias(f"{m}{b}") for m, b in cells]
    )
    guests = guests.select(*by, F.lit(True).alias("guest"), "mask", *[f"n{i}" for i in found_in], *money, F.lit(None).cast("int").alias("first_band"))
    sums = []
    for i, part in enumerate(parts):
        new = F.coalesce(F.col("first_band").isin(part), F.lit(False))
        inside = lambda m: sum((F.coalesce(F.col(f"{m}{b}"), F.lit(0).cast(exact)) for b in part[1:]), F.coalesce(F.col(f"{m}{part[0]}"), F.lit(0).cast(exact)))  # noqa: B023, E731
        amount, n = inside("amount"), F.col(f"n{i}")
        sums += [
            F.sum(amount).alias(f"_rev{i}"),
            F.sum(F.when(new, amount)).alias(f"_new_rev{i}"),
            F.sum(F.when(~new, amount)).alias(f"_ret_rev{i}"),
            F.count_if(here(i)).alias(f"customers{i}"),
            F.count_if(here(i) & new).alias(f"new_customers{i}"),
            F.sum(F.when(new, n).otherwise(0)).alias(f"_new_orders{i}"),
            F.sum(F.when(~new, n).otherwise(0)).alias(f"_ret_orders{i}"),
            F.sum(inside("discount")).alias(f"_disc{i}"),
            F.sum(inside("gross")).alias(f"_gross{i}"),
            F.sum(F.when(F.col("guest"), amount)).alias(f"_guest_rev{i}"),
            F.sum(F.when(F.col("guest"), n)).alias(f"_guest_orders{i}"),
        ]
    wide = attach(known.unionByName(guests).groupBy(*by).agg(*sums), orders, by)
    out = [
        F.struct(F.lit(period).alias("period"), F.lit(side).alias("side"), *[F.col(f"{n}{i}").alias(n) for n in FACTS])
        for i, (period, side, *_) in enumerate(window_rules())
    ]
    return wide.select(*by, F.inline(F.array(*out)))


def period_summary(orders, by=(), ref_date=None, guests: str = "returning") -> DataFrame:
    """KPIs of the current and prior 30/90/365-day windows; zeros for empty windows.

    A row's window follows from its age in days, so windows need neither a range join nor
    one pass each.  Guests (null customer) count as returning; with ``guests="separate"``
    they have columns of their own and are left out of the returning ones.
    """
    if guests not in ("returning", "separate"):
        raise ValueError("guests is 'returning' or 'separate'")
    led = Ledger.of(orders, by, ref_date)
    keys = [*led.by, "period", "side"]
    sums = _window_sums(led)
    extra: list[Column] = []
    if guests == "separate":
        zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
        money = dict(sums.dtypes)["_ret_rev"]
        sums = sums.withColumns(
            {
                "_ret_rev": F.col("_ret_rev") - zero("_guest_rev", money),
                "_ret_orders": F.col("_ret_orders") - zero("_guest_orders", "long"),
            }
        )
        extra = [num(zero("_guest_rev", money)).alias("guest_revenue"), zero("_guest_orders", "long").alias("guest_orders")]
    found = _kpis(sums, keys, extra)
    windows = period_windows(led)
    # Always null safe, also for stores: six windows per store on both sides.
    filled = attach(windows, found, keys)
    counts = ("orders", "customers", "new_customers", "returning_customers", "guest_orders")
    return filled.select(
        *windows.columns,
        *[F.coalesce(F.col(c), F.lit(0).cast("long") if c in counts else F.lit(0.0)).alias(c) for c in found.columns[len(keys) :]],
    )


def _pairs(summary: DataFrame, by: list[str]) -> DataFrame:
    """One row per period with structs ``cur`` and ``prev``."""
    kpis = F.struct(*SUMMARY)
    return summary.groupBy(*by, "period").agg(
        F.max(F.when(F.col("side") == "current", kpis)).alias("cur"),
        F.max(F.when(F.col("side") == "prior", kpis)).alias("prev"),
    )


def period_comparison(orders, by=(), ref_date=None) -> DataFrame:
    """Long form: by, period, kpi, current, prior, change."""
    led = Ledger.of(orders, by, ref_date)
    pairs = _pairs(period_summary(led), led.by)
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("kpi"),
                num(f"cur.{k}").alias("current"),
                num(f"prev.{k}").alias("prior"),
                change(f"cur.{k}", f"prev.{k}").alias("change"),
            )
            for k in SUMMARY
        ]
    )
    return pairs.select(*led.by, "period", F.inline(entries))


def _driver_columns() -> list[Column]:
    """Volume at prior AOV, AOV at current orders, rest; zeros without prior revenue."""
    cur, prev = (lambda k: num(f"cur.{k}")), (lambda k: num(f"prev.{k}"))
    volume = (cur("orders") - prev("orders")) * prev("aov")
    aov = (cur("aov") - prev("aov")) * cur("orders")
    mix = cur("revenue") - prev("revenue") - volume - aov
    based = prev("revenue") != 0
    return [
        F.when(based, cents(c)).otherwise(F.lit(0.0)).alias(name)
        for name, c in (("aov_effect", aov), ("volume_effect", volume), ("mix_effect", mix))
    ]


def period_blocks(orders, by=(), ref_date=None) -> DataFrame:
    """Summary with changes, KPI tree and drivers: one row per period."""
    led = Ledger.of(orders, by, ref_date)
    return blocks_of(period_summary(led), led.by)


def blocks_of(summary: DataFrame, by: list[str]) -> DataFrame:
    cols: list[Column] = []
    for k in ("revenue", "orders", "aov", "customers"):
        cols += [F.col(f"cur.{k}").alias(k), change(f"cur.{k}", f"prev.{k}").alias(f"{k}_change")]
    for side in ("new", "returning"):
        cols += [
            F.col(f"cur.{side}_customer_revenue").alias(f"{side}_customer_revenue"),
            ratio(f"cur.{side}_customer_revenue", "cur.revenue").alias(f"{side}_customer_revenue_share"),
            F.col(f"cur.{side}_customers").alias(f"{side}_customers"),
            change(f"cur.{side}_customers", f"prev.{side}_customers").alias(f"{side}_customers_change"),
            F.col(f"cur.{side}_customer_aov").alias(f"{side}_customer_aov"),
        ]
    return _pairs(summary, by).select(*by, "period", *cols, *_driver_columns())


def drivers(orders, by=(), ref_date=None) -> DataFrame:
    """Revenue change split into AOV, volume and mix effect per period."""
    led = Ledger.of(orders, by, ref_date)
    pairs = _pairs(period_summary(led), led.by)
    return pairs.select(
        *led.by,
        "period",
        (F.col("cur.revenue") - F.col("prev.revenue")).alias("revenue_delta"),
        *_driver_columns(),
    )


def drivers_mix(orders, by=(), ref_date=None) -> DataFrame:
    """Revenue change split exactly into volume, mix of new and returning orders, and AOV.

    Volume is the change in orders at the prior AOV, mix the shift between new and returning
    orders at their prior AOVs, and the AOV effect the change of both AOVs at the current
    orders, so that the three add up to the change.  A side without prior orders has a prior
    AOV of 0.  Periods without prior orders have no split: effects are null.
    """
    led = Ledger.of(orders, by, ref_date)
    keys = [*led.by, "period", "side"]
    sums = attach(period_windows(led).select(*keys), _window_sums(led), keys)
    zero = lambda c: F.coalesce(num(c), F.lit(0.0))
    sides = F.struct(
        *[zero(c).alias(n) for n, c in (("new_orders", "_new_orders"), ("ret_orders", "_ret_orders"), ("new_rev", "_new_rev"), ("ret_rev", "_ret_rev"))]
    )
    pairs = sums.groupBy(*led.by, "period").agg(
        F.max(F.when(F.col("side") == "current", sides)).alias("cur"), F.max(F.when(F.col("side") == "prior", sides)).alias("prev")
    )

    def side(when: str, name: str) -> tuple[Column, Column, Column]:
        """Orders, share of all orders and AOV of a side."""
        orders = F.col(f"{when}.{name}_orders")
        total_orders = F.col(f"{when}.new_orders") + F.col(f"{when}.ret_orders")
        return orders, ratio(orders, total_orders), ratio(F.col(f"{when}.{name}_rev"), orders)

    n0, n1 = (F.col(f"{w}.new_orders") + F.col(f"{w}.ret_orders") for w in ("prev", "cur"))
    revenue = lambda w: F.col(f"{w}.new_rev") + F.col(f"{w}.ret_rev")
    mix, aov = F.lit(0.0), F.lit(0.0)
    for name in ("new", "ret"):
        (_, share0, aov0), (orders1, share1, aov1) = side("prev", name), side("cur", name)
        mix = mix + n1 * (share1 - share0) * aov0
        aov = aov + orders1 * (aov1 - aov0)
    split = (("volume_effect", (n1 - n0) * ratio(revenue("prev"), n0)), ("mix_effect", mix), ("aov_effect", aov))
    return pairs.select(
        *led.by,
        "period",
        (revenue("cur") - revenue("prev")).alias("revenue_delta"),
        *[F.when((n0 > 0) & (n1 > 0), c).alias(n) for n, c in split],
    )


def monthly_trend(orders, by=(), ref_date=None, days: int = 365) -> DataFrame:
    """KPIs per calendar month of the trailing window, months clipped to it.

    ``partial`` marks months with data on fewer than half of their days.
    """
    led = Ledger.of(orders, by, ref_date)
    rows = led.with_first_day(led.recent(days - 1))
    first = F.trunc("day", "month")
    start = F.greatest(first, F.date_sub("ref", days - 1))
    end = F.least(F.last_day("day"), F.col("ref"))
    rows = rows.withColumn("month_start", first).withColumn(
        "is_new", F.coalesce(F.col("first_day").between(start, end), F.lit(False))
    )
    found = _summarise(rows, [*led.by, "month_start"], F.countDistinct("day").alias("days_with_data"))
    kept = found.filter(~((F.col("orders") == 0) & (F.col("revenue") == 0)))
    return kept.select(
        *led.by,
        month_label("month_start").alias("month"),
        "revenue",
        "orders",
        "aov",
        "customers",
        "new_customers",
        "returning_customers",
        "days_with_data",
        (F.col("days_with_data") < month_length("month_start") / 2).alias("partial"),
    )
