"""Products bought together: pair support and lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, durable, match, stored
from tallybrook.functions.scalars import num
from tallybrook.ledger import Ledger

# Baskets with more distinct frequent products than this are counted in pieces.
LARGE_BASKET = 256


def cross_sell_pairs(orders, by=(), min_support: float = 0.01, large_basket: int = LARGE_BASKET) -> DataFrame:
    """by, product_a, product_b, support, lift, count for pairs in enough orders.

    A pair needs max(2, ⌊orders × min_support⌋) common orders.  Products below that
    count cannot be part of one and are dropped first, which bounds a basket by
    ⌊order lines ÷ needed⌋ products.  Results are exact for any basket size.
    """
    led = Ledger.of(orders, by)
    by = led.by
    needed = F.greatest(F.lit(2), F.floor(num("n_orders") * F.lit(min_support))).cast("long").alias("needed")
    if led.kept_rollup("placed") is not None and led.kept_rollup("goods") is not None:
        limits = led.placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orders")).select(*by, "n_orders", needed)
        limits = led.few(limits)
        # A product has at most as many orders as lines, so baskets of the others need not be looked at.
        # These are written, so that the planner sees how few they are.
        enough = attach(led.goods.select(*by, "product", "lines"), limits, by).filter(F.col("lines") >= F.col("needed"))
        lines = stored(match(led.baskets, stored(enough.select(*by, "product")), [*by, "product"], "left_semi").distinct())
    else:
        # Read three times below: written once instead of scanning the lines again.
        lines = durable(led.baskets.distinct())
        limits = lines.groupBy(*by).agg(F.countDistinct("order_id").alias("n_orders")).select(*by, "n_orders", needed)
    items = lines.filter(F.col("product").isNotNull())

    counted = items.groupBy(*by, "product").agg(F.count(F.lit(1)).alias("product_orders"))
    frequent = durable(attach(counted, limits, by).filter(F.col("product_orders") >= F.col("needed")))
    kept = durable(match(items, frequent.select(*by, "product"), [*by, "product"], "left_semi"))

    pairs = _count_pairs(kept, limits, by, large_basket)
    for side in ("a", "b"):
        facts = ["n_orders", "needed"] if side == "a" else []
        one = frequent.select(*by, F.col("product").alias(f"product_{side}"), F.col("product_orders").alias(f"_n_{side}"), *facts)
        pairs = match(pairs, one, [*by, f"product_{side}"])
    n = num("n_orders")
    support = num("count") / n
    return pairs.filter(F.col("count") >= F.col("needed")).select(
        *by,
        "product_a",
        "product_b",
        support.alias("support"),
        (support / ((num("_n_a") / n) * (num("_n_b") / n))).alias("lift"),
        "count",
    )


def _count_pairs(kept: DataFrame, limits: DataFrame, by: list[str], large_basket: int) -> DataFrame:
    """Number of common orders per pair a < b; may omit pairs below the needed count."""
    basket = [*by, "order_id"]
    sizes = kept.groupBy(*basket).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.filter(F.col("_size") > large_basket).select(*basket)
    if large.isEmpty():
        return _pairs_of_small(kept, by)
    pair = [*by, "product_a", "product_b"]
    # Read twice: added up, and as the candidates that are followed through large baskets.
    from_small = durable(_pairs_of_small(match(kept, large, basket, "left_anti"), by))
    big = match(kept, large, basket, "left_semi")
    in_big = attach(big.groupBy(*by, "product").agg(F.count(F.lit(1)).alias("_in_big")), limits, by)
    from_big = _common_pairs(big, in_big, by, large_basket).unionByName(_rare_pairs(big, in_big, from_small, by))
    return from_small.unionByName(from_big).groupBy(*pair).agg(F.sum("count").alias("count"))


def _pairs_of_small(small: DataFrame, by: list[str]) -> DataFrame:
    """Pairs within baskets of bounded size, unfolded from one sorted array per basket."""
    return (
        small.groupBy(*by, "order_id")
        .agg(F.sort_array(F.collect_list("product")).alias("p"))
        .filter(F.size("p") > 1)
        .select(*by, F.posexplode("p").alias("i", "product_a"), "p")
        .select(*by, "product_a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("product_b"))
        .groupBy(*by, "product_a", "product_b")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _common_pairs(big: DataFrame, in_big: DataFrame, by: list[str], block_size: int) -> DataFrame:
    """Large baskets, both products in enough large baskets to qualify by them alone.

    Each basket is cut into blocks of about ``block_size`` products; every pair of
    blocks is its own small group, so one basket of any size spreads over many tasks.
    """
    common = in_big.filter(F.col("_in_big") >= F.col("needed")).select(*by, "product")
    rows = match(big, common, [*by, "product"], "left_semi")
    basket = [*by, "order_id"]
    blocks = rows.groupBy(*basket).agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("_blocks"))
    rows = match(rows, blocks, basket)
    mine = F.pmod(F.xxhash64("product"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = rows.groupBy(
        *basket, F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j")
    ).agg(
        F.collect_list(F.when(F.col("_mine") <= F.col("_other"), F.col("product"))).alias("left"),
        F.collect_list(F.when(F.col("_mine") >= F.col("_other"), F.col("product"))).alias("right"),
    )
    couples = cells.select(*by, "_i", "_j", F.explode("left").alias("x"), "right").select(
        *by, "_i", "_j", "x", F.explode("right").alias("y")
    )
    # Inside one block each pair shows up in both orders; keep one of them.
    couples = couples.filter((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y")))
    return (
        couples.groupBy(*by, F.least("x", "y").alias("product_a"), F.greatest("x", "y").alias("product_b"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _rare_pairs(big: DataFrame, in_big: DataFrame, from_small: DataFrame, by: list[str]) -> DataFrame:
    """Large-basket counts of pairs with a product too rare there to qualify by them alone.

    Such a pair must also occur in a small basket, so those pairs are the complete
    candidates.  Those stay that reach the needed count if every large basket with the
    rarer product held both; each is followed from that product.
    """
    presence = in_big.select(*by, "product", "_in_big", "needed")
    cand = from_small.select(*by, "product_a", "product_b", F.col("count").alias("_small"))
    for side in ("a", "b"):
        one = presence.select(
            *by,
            F.col("product").alias(f"product_{side}"),
            F.col("_in_big").alias(f"_big_{side}"),
            F.col("needed").alias(f"_needed_{side}"),
        )
        cand = match(cand, one, [*by, f"product_{side}"])
    rarer = F.least("_big_a", "_big_b")
    cand = cand.filter((rarer < F.col("_needed_a")) & (F.col("_small") + rarer >= F.col("_needed_a")))
    a_rarer = F.col("_big_a") <= F.col("_big_b")
    cand = cand.select(
        *by,
        "product_a",
        "product_b",
        F.when(a_rarer, F.col("product_a")).otherwise(F.col("product_b")).alias("product"),
        F.when(a_rarer, F.col("product_b")).otherwise(F.col("product_a")).alias("_partner"),
    )
    followed = match(cand, big, [*by, "product"]).drop("product").withColumnRenamed("_partner", "product")
    met = match(followed, big, [*by, "order_id", "product"], "left_semi")
    return met.groupBy(*by, "product_a", "product_b").agg(F.count(F.lit(1)).alias("count"))
