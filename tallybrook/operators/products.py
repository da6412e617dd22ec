"""Product operators: ABC, concentration, conversion, lifecycle, price tiers, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, group_window, match, stored
from tallybrook.functions.ordering import ordered_prefix, quantiles, top_n_sum, top_share_sum
from tallybrook.functions.scalars import MONEY, num, ratio, total
from tallybrook.ledger import Ledger

# Cumulative share limits of the classes A and B.
ABC_LIMITS = (0.80, 0.95)
# Fixed value: relative slope that separates growth and decline from mature.
STAGE_SLOPE = 0.10


def product_totals(orders, by=()) -> DataFrame:
    """by, product, amount, lines, priced_lines: one row per product key."""
    led = Ledger.of(orders, by)
    if led.kept_rollup("goods") is not None:
        return led.goods.select(*led.by, "product", "amount", "lines", "priced_lines")
    return led.items.groupBy(*led.by, "product").agg(
        total("amount").alias("amount"), F.sum("lines").alias("lines"), F.sum("priced_lines").alias("priced_lines")
    )


def abc_classes(orders, by=(), metric: str = "revenue") -> DataFrame:
    """A/B/C by cumulative share of revenue, or of line count with ``metric="lines"``."""
    led = Ledger.of(orders, by)
    source = F.col("amount") if metric == "revenue" else F.col("lines").cast(MONEY)
    values = product_totals(led).select(*led.by, "product", source.alias("value"), (-source).alias("_down"))
    prefix = ordered_prefix(values, led.by, ["_down", "product"], {"value": "value"})
    cumulative = F.try_divide(num("running_value"), num("whole_value"))
    a, b = ABC_LIMITS
    # The limits are compared at 12 places, as the shares are quotients of exact sums.
    place = F.round(cumulative, 12)
    return prefix.select(
        *led.by,
        "product",
        num("value").alias("value"),
        cumulative.alias("cumulative_share"),
        F.when(place <= a, "A").when(place <= b, "B").otherwise("C").alias("abc_rank"),
        F.try_divide(num("value"), num("whole_value")).alias("value_share"),
    )


def top_product_share(orders, by=(), fraction: float = 0.2) -> DataFrame:
    """Share of the top ``fraction`` of products in the revenue of all keyed products.

    No row for stores without products or without positive product revenue.
    """
    led = Ledger.of(orders, by)
    top = top_share_sum(product_totals(led), led.by, "amount", fraction, led.few)
    return top.filter(F.col("group_total") > 0).select(
        *led.by,
        F.col("group_rows").alias("products"),
        F.col("top_k").alias("top_products"),
        num("top_total").alias("top_revenue"),
        ratio("top_total", "group_total").alias("top_share"),
    )


def top_n_share(orders, by=(), n: int = 5) -> DataFrame:
    """Share of the ``n`` best-selling products in product revenue."""
    led = Ledger.of(orders, by)
    top = top_n_sum(product_totals(led), led.by, "amount", n)
    return top.select(
        *led.by,
        F.col("top_k").alias("top_n"),
        num("top_total").alias("top_revenue"),
        ratio("top_total", "group_total").alias("top_share"),
    )


def converting_rate(orders, by=()) -> DataFrame:
    """Products with positive revenue ÷ all products seen."""
    led = Ledger.of(orders, by)
    return product_totals(led).groupBy(*led.by).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("amount") > 0).alias("converting"),
        F.avg((F.col("amount") > 0).cast("double")).alias("converting_rate"),
    )


def multi_item_rate(orders, by=()) -> DataFrame:
    """Share of orders with more than one distinct product; item-less orders count as zero.

    An order has several if its least and greatest differ, so no set of products is kept.
    Kept orders tell it by hashes; those whose lines share one hash are looked up.
    """
    led = Ledger.of(orders, by)
    several = F.coalesce(F.min("product") < F.max("product"), F.lit(False)).alias("several")
    keys = [*led.by, "order_id"]
    if led.kept_rollup("placed") is None or not led.product_key:
        each = led.baskets.groupBy(*keys).agg(several)
    else:
        differ = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
        alike = ~differ & (F.col("item_lines") > 1)
        each = led.placed.select(*keys, differ.alias("several"), alike.alias("_alike"))
        doubtful = stored(each.filter("_alike").select(*keys))  # so that the planner sees how few they are
        if not doubtful.isEmpty():
            looked_up = match(led.baskets, doubtful, keys, "left_semi").groupBy(*keys).agg(several)
            each = each.filter(~F.col("_alike")).drop("_alike").unionByName(looked_up)
    return each.groupBy(*led.by).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if("several").alias("multi_item_orders"),
        F.avg(F.col("several").cast("double")).alias("multi_item_rate"),
    )


def product_kpis(orders, products: DataFrame, by=()) -> DataFrame:
    """Catalogue size, top-20 % share of all revenue, share of orders with several lines."""
    led = Ledger.of(orders, by)
    whole = led.sales.groupBy(*led.by).agg(total("amount").alias("_all"))
    if led.product_key:
        top = top_share_sum(product_totals(led), led.by, "amount", 0.2).select(*led.by, "top_total")
        whole = attach(whole, top, led.by)
    else:
        whole = whole.withColumn("top_total", F.lit(0).cast(MONEY))
    sizes = led.sales.filter(F.col("order_id").isNotNull()).groupBy(*led.by, "order_id").agg(F.sum("lines").alias("lines"))
    multi = sizes.groupBy(*led.by).agg(F.avg((F.col("lines") > 1).cast("double")).alias("multi_item_order_rate"))
    catalogue_by = [c for c in led.by if c in products.columns]
    size = (
        products.groupBy(*catalogue_by).agg(F.countDistinct("product_id").alias("total_skus"))
        if "product_id" in products.columns
        else None
    )
    joined = attach(whole, multi, led.by)
    if size is not None:
        joined = attach(joined, size, catalogue_by)
    else:
        joined = joined.withColumn("total_skus", F.lit(0).cast("long"))
    return joined.select(
        *led.by,
        F.coalesce("total_skus", F.lit(0)).alias("total_skus"),
        ratio("top_total", "_all").alias("top20_revenue_share"),
        F.coalesce("multi_item_order_rate", F.lit(0.0)).alias("multi_item_order_rate"),
    )


def product_months(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    return (
        led.items.filter(F.col("month").isNotNull())
        .groupBy(*led.by, "product", "month")
        .agg(total("amount").alias("amount"))
    )


def lifecycle(orders, by=()) -> DataFrame:
    """Launch / Growth / Mature / Decline from the slope over the last three active months.

    The slope of two or three equally spaced points is (last − first) ÷ (points − 1),
    so a product needs only its newest three months: a window no longer than the
    calendar, over its months, not its lines.
    """
    led = Ledger.of(orders, by)
    each = led.goods.filter(F.col("months") > 0).select(
        *led.by, "product", F.col("dated_amount").alias("total_revenue"), F.col("months").alias("months_active"),
        num("newest").alias("_v1"), num("second").alias("_v2"), num("third").alias("_v3"),
    )
    n = F.least(F.col("months_active"), F.lit(3))
    slope = (F.col("_v1") - F.coalesce("_v3", "_v2", "_v1")) / (n - 1)
    mean = (F.lit(0.0) + F.col("_v1") + F.coalesce("_v2", F.lit(0.0)) + F.coalesce("_v3", F.lit(0.0))) / n
    # The mean's sign stays: a negative recent mean turns the relative slope around.
    relative = F.round(F.when(mean != 0, slope / mean).otherwise(F.lit(0.0)), 12)
    stage = (
        F.when(F.col("months_active") < 2, "Launch")
        .when(relative > STAGE_SLOPE, "Growth")
        .when(relative < -STAGE_SLOPE, "Decline")
        .otherwise("Mature")
    )
    return each.select(*led.by, "product", num("total_revenue").alias("total_revenue"), "months_active", stage.alias("lifecycle_stage"))


def stage_shares(orders, by=()) -> DataFrame:
    led = Ledger.of(orders, by)
    stages = lifecycle(led).groupBy(*led.by)
    return stages.agg(
        F.count(F.lit(1)).alias("products"),
        *[
            F.avg((F.col("lifecycle_stage") == s).cast("double")).alias(f"{s.lower()}_share")
            for s in ("Launch", "Growth", "Mature", "Decline")
        ],
    )


def price_tiers(orders, by=()) -> DataFrame:
    """Number of distinct quartile bins of the products' mean line amount.

    Below four products as many bins as products are asked for.  A single product
    is one tier; equal prices of several products are none.
    """
    led = Ledger.of(orders, by)
    means = (
        product_totals(led)
        .filter(F.col("priced_lines") > 0)
        .select(*led.by, F.round(num("amount") / F.col("priced_lines"), 9).alias("price"))
    )
    thirds = {"t1": 1 / 3, "t2": 2 / 3}
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0, **thirds}
    edges = quantiles(means, led.by, "price", probs, few=led.few)

    def bins(*names: str) -> Column:
        return F.size(F.array_distinct(F.array(*[F.round(c, 9) for c in names]))) - 1

    tiers = (
        F.when(F.col("n") == 1, F.lit(1))
        .when(F.col("n") == 2, bins("q0", "q2", "q4"))
        .when(F.col("n") == 3, bins("q0", "t1", "t2", "q4"))
        .otherwise(bins("q0", "q1", "q2", "q3", "q4"))
    )
    return edges.select(*led.by, F.col("n").alias("products"), tiers.cast("long").alias("price_tiers"))


def category_performance(orders, by=()) -> DataFrame:
    """Revenue, orders, mean line amount and revenue share per category."""
    led = Ledger.of(orders, by)
    if not led.has("category"):
        raise ValueError("category_performance needs a 'category' column")
    amount = F.col("amount").cast(MONEY)
    cats = (
        led.lines_with("category", "amount", "order_id").filter(F.col("category").isNotNull())
        .groupBy(*led.by, "category")
        .agg(
            total(amount).alias("_rev"),
            F.countDistinct("order_id").alias("orders"),
            F.count(amount).alias("_n"),
        )
    )
    # One row per category by now; a join would read the lines again.
    return cats.withColumn("_all", F.sum("_rev").over(group_window(led.by))).select(
        *led.by,
        "category",
        num("_rev").alias("revenue"),
        "orders",
        F.try_divide(num("_rev"), num("_n")).alias("avg_price"),
        ratio("_rev", "_all").alias("revenue_share"),
    )


def _sale_days(led: Ledger) -> DataFrame:
    """by, _product, day of every sale up to the reference date, each day once."""
    key = led.need_key()
    sold = led.lines.filter(F.col(key).isNotNull()).select(
        *led.by, F.col(key).cast("string").alias("_product"), F.to_date("order_date").alias("day")
    )
    return (sold.filter(F.col("day") <= F.lit(led.ref_date)) if led.ref_date else sold).distinct()


def _catalogue(led: Ledger, products: DataFrame) -> DataFrame:
    """Catalogue rows with ``_product`` and ``ref``; with stores it must say what each offers."""
    missing = [c for c in led.by if c not in products.columns]
    if missing:
        raise ValueError(f"the catalogue needs the store columns {missing}: what a store never sold is in no other table")
    return led.with_reference(products.withColumn("_product", F.col("product_id").cast("string")))


def dormant_products(orders, products: DataFrame, by=(), ref_date=None, days: int = 90) -> DataFrame:
    """Catalogue products without a sale in the last ``days`` days, with their last sale."""
    led = Ledger.of(orders, by, ref_date)
    last = _sale_days(led).groupBy(*led.by, "_product").agg(F.max("day").alias("last_sale"))
    stale = F.col("last_sale").isNull() | (F.date_diff("ref", "last_sale") >= days)
    return match(_catalogue(led, products), last, [*led.by, "_product"], "left").filter(stale).drop("ref", "_product")


def unsold_launches(orders, products: DataFrame, by=(), ref_date=None, days: int = 60, launch_col: str = "launch_date") -> DataFrame:
    """Products without a sale from their launch date to ``days`` days after it.

    Sales before the launch do not count.  ``first_sale`` and ``last_sale`` are over
    all days.
    """
    led = Ledger.of(orders, by, ref_date)
    keys = [*led.by, "_product"]
    due = F.date_add(launch_col, days)
    launched = _catalogue(led, products).filter(due <= F.col("ref"))
    sales = _sale_days(led)
    spans = sales.groupBy(*keys).agg(F.min("day").alias("first_sale"), F.max("day").alias("last_sale"))
    dates = launched.select(*keys, F.col(launch_col).alias("_launch")).distinct()
    timely = match(dates, sales, keys).filter(F.col("day").between(F.col("_launch"), F.date_add("_launch", days)))
    late = match(launched.withColumn("_launch", F.col(launch_col)), timely.select(*keys, "_launch").distinct(), [*keys, "_launch"], "left_anti")
    return match(late, spans, keys, "left").drop("ref", "_product", "_launch")
