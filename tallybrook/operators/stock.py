"""Inventory KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.scalars import MONEY, num, ratio, total

# Fixed value: days on hand above which stock counts as overstock.
OVERSTOCK_DAYS = 90


def inventory_kpis(inventory: DataFrame, by=()) -> DataFrame:
    """Distinct SKUs, stock-outs, overstock and stock value in one aggregation."""
    has = inventory.columns.__contains__
    over = F.count_if(F.col("days_on_hand") > OVERSTOCK_DAYS) if has("days_on_hand") else F.lit(0).cast("long")
    quantity = F.col("quantity_on_hand").cast(MONEY)
    value = total(quantity * F.col("cost").cast(MONEY)) if has("cost") else F.lit(None)
    sums = inventory.groupBy(*by).agg(
        F.countDistinct("sku").alias("total_skus"),
        F.count_if(quantity <= 0).alias("stockout_skus"),
        over.alias("overstock_skus"),
        num(value).alias("total_inventory_value"),
    )
    return sums.select(
        *by,
        "total_skus",
        "stockout_skus",
        ratio("stockout_skus", "total_skus").alias("stockout_rate"),
        "overstock_skus",
        "total_inventory_value",
    )
