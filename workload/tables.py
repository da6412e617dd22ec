"""Canonical order lines, catalogue and inventory derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.functions.frames import likely
from tallybrook.functions.scalars import MONEY


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_lines(
    spark: SparkSession,
    folder: str,
    product: bool = False,
    store: bool = False,
    guests: bool = False,
    returns: bool = False,
    discount: bool = True,
    between: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Order lines in canonical form.

    ``product`` adds name, category and cost from the part table, ``store`` the
    customer's nation as ``store_id``.  ``guests`` drops the customer of orders with
    priority 5-LOW, ``returns`` negates amounts of returned lines.  ``between`` keeps the
    lines of orders placed on the first date or later, and before the second.

    The orders are joined last: the lines then lie together by order, as rollups by order want
    them, and are shuffled for their part while they are still narrow.
    """
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    if between:
        low, high = between
        orders = orders.filter((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < high))
        lines = likely(lines, "l_orderkey", orders, "o_orderkey")
    lines = lines.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_discount").cast("decimal(3,2)").alias("rate"),
    )
    if product:
        part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice", F.col("p_retailprice").cast("decimal(12,2)").alias("retail"))
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    if store:  # found for each order, so that the lines are joined once
        orders = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        orders = orders.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price, rate = F.col("price"), F.col("rate")
    amount = (price * (1 - rate)).cast(MONEY)
    if returns:
        amount = F.when(F.col("l_returnflag") == "R", -amount).otherwise(amount)
    customer = F.col("o_custkey")
    if guests:
        customer = F.when(F.col("o_orderpriority") != "5-LOW", customer)
    columns = [
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        customer.alias("customer_id"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_quantity").alias("quantity"),
        amount.alias("amount"),
    ]
    if discount:
        columns.append((price * rate).cast(MONEY).alias("discount"))
    if product:
        cost = F.col("l_quantity").cast("decimal(9,0)") * F.col("retail")
        columns += [
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("category"),
            F.col("p_retailprice").cast(MONEY).alias("item_price"),
            (cost * F.lit("2.1").cast("decimal(2,1)")).cast(MONEY).alias("cost"),
        ]
    if store:
        columns.append(F.col("n_name").alias("store_id"))
    return df.select(*columns)


# Stores of the edge lines and what is odd about them.
EDGES = {
    "ALGERIA": "one product", "ARGENTINA": "two products", "BRAZIL": "three products", "CANADA": "no revenue",
    "EGYPT": "one day", "ETHIOPIA": "lines without product", "FRANCE": "lines without order", "GERMANY": "one customer",
}


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines by store, where some stores are odd."""
    lines = order_lines(spark, folder, store=True)
    at = lambda what: F.col("store_id") == next(s for s, w in EDGES.items() if w == what)
    number = F.col("sku").cast("bigint")
    sku = (
        F.when(at("one product"), "1").when(at("two products"), (number % 2).cast("string")).when(at("three products"), (number % 3).cast("string"))
        .when(at("lines without product") & (number % 2 == 0), None).otherwise(F.col("sku"))
    )
    zero = F.lit(0).cast(MONEY)
    return lines.withColumns(
        {
            "sku": sku,
            "amount": F.when(at("no revenue"), zero).otherwise(F.col("amount")),
            "discount": F.when(at("no revenue"), zero).otherwise(F.col("discount")),
            "order_date": F.when(at("one day"), F.lit("1997-05-05").cast("timestamp_ntz")).otherwise(F.col("order_date")),
            "order_id": F.when(at("lines without order") & (F.col("order_id") % 3 == 0), None).otherwise(F.col("order_id")),
            "customer_id": F.when(at("one customer"), 7).otherwise(F.col("customer_id")),
        }
    )


def named_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines without a SKU, whose products go by name."""
    return order_lines(spark, folder, product=True).drop("sku")


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """A month of purchase events as orders with a time of day."""
    events = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("order_date"),
        F.col("user_id").alias("customer_id"),
        F.col("value").cast("decimal(18,2)").cast(MONEY).alias("amount"),
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("category"),
    )


def store_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue in which each product is offered by one store, sold there or not."""
    stores = table(spark, folder, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("store_id"))
    return catalogue(spark, folder).withColumn("_key", F.expr("product_id % 25")).join(stores, "_key").drop("_key")


def launches(spark: SparkSession, folder: str, offered=catalogue) -> DataFrame:
    """Catalogue with a launch date spread over the sales years by product number."""
    offset = F.expr("cast(product_id * 7 % 2400 as int)")
    return offered(spark, folder).withColumn("launch_date", F.date_add(F.lit("1995-01-01").cast("date"), offset))


def store_launches(spark: SparkSession, folder: str) -> DataFrame:
    return launches(spark, folder, store_catalogue)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("sku"),
        (F.col("p_size") - 10).alias("quantity_on_hand"),
        F.expr("p_partkey * 7 % 180").alias("days_on_hand"),
        (F.col("p_retailprice").cast("decimal(12,2)") * F.lit("0.6").cast("decimal(2,1)")).alias("cost"),
    )


def retail_export(spark: SparkSession, folder: str) -> DataFrame:
    """The lines as an all-text retail export: no amount, month-first dates, quantity × price."""
    lines = order_lines(spark, folder, product=True)
    return lines.select(
        F.concat(F.lit("INV"), "order_id").alias("Invoice"),
        F.col("sku").alias("StockCode"),
        F.col("product_name").alias("Description"),
        F.col("quantity").cast("int").cast("string").alias("Quantity"),
        F.date_format("order_date", "M/d/yyyy H:mm").alias("InvoiceDate"),
        F.col("item_price").cast("decimal(12,2)").cast("string").alias("Price"),
        F.concat(F.lit("C-"), "customer_id").alias("Customer ID"),
    )


def shop_export(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as an all-text shop export with order-level totals."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.concat(F.lit("#"), "o_orderkey").alias("Name"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")).alias("Created at"),
        F.col("o_orderstatus").alias("Financial Status"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Total"),
        F.concat("o_custkey", F.lit("@shop.example")).alias("Email"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "1.50").otherwise("n/a").alias("Discount Amount"),
    )


def ticket_export(spark: SparkSession, folder: str) -> DataFrame:
    """The orders with columns on both sides of the share of different values that makes an id."""
    orders = table(spark, folder, "orders")
    share = lambda percent: F.floor(F.col("o_orderkey") * percent / 100).cast("string")
    return orders.select(
        F.concat(F.lit("T"), "o_orderkey").alias("ticket"),
        F.concat(F.lit("B"), share(79)).alias("batch79"),
        F.concat(F.lit("B"), share(82)).alias("batch82"),
        F.concat(F.lit("C"), "o_custkey").alias("client"),
        F.lit(None).cast("string").alias("note"),
        F.date_format("o_orderdate", "d.M.yyyy").alias("day"),
        F.when(F.col("o_orderkey") % 5 < 4, F.concat(F.lit("$"), F.col("o_custkey").cast("string"))).otherwise("none").alias("fee"),
    )


def odd_export(spark: SparkSession, folder: str) -> DataFrame:
    """An export whose headers match no alias and need the similarity mapping."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.concat(F.lit("N"), "o_orderkey").alias("Order Id Number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day_date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("amount"),
        F.concat(F.lit("U"), "o_custkey").alias("customer id"),
        F.col("o_orderpriority").alias("priority"),
    )


def as_lines(export: DataFrame, cut: str, spoilt: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """The rows of an all-text export as CSV lines and their header.

    Where ``cut`` holds, the line lacks its last field; ``spoilt`` replaces fields of rows by
    SQL expressions.
    """
    for name, value in (spoilt or {}).items():
        export = export.withColumn(name, F.expr(value))
    columns = [F.col(f"`{c}`") for c in export.columns]
    options = {"escape": '"'}
    line = F.when(F.expr(cut), F.to_csv(F.struct(*columns[:-1]), options)).otherwise(F.to_csv(F.struct(*columns), options))
    # Unfolded from a list of one: a filter on the line does not build it once more.
    return export.select(F.explode(F.array(line)).alias("value")), ",".join(export.columns)


def retail_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """Retail lines with quoted descriptions, some too short and some without a date."""
    number = "cast(substring(Invoice, 4) as bigint)"
    spoilt = {
        "Description": "concat(Description, ', \"new\"')",
        "InvoiceDate": f"if({number} % 89 = 0, 'soon', InvoiceDate)",
    }
    return as_lines(retail_export(spark, folder), f"{number} % 97 = 0", spoilt)


def product_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The parts as lines of a shop's product export."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    export = table(spark, folder, "part").select(
        F.concat(F.lit("p-"), "p_partkey").alias("Handle"),
        F.concat("p_name", F.lit(', "boxed"')).alias("Title"),
        F.when(F.col("p_partkey") % 13 == 0, "n/a").otherwise(price).alias("Variant Price"),
        F.col("p_type").alias("Type"),
        F.col("p_brand").alias("Vendor"),
    )
    return as_lines(export, "cast(substring(Handle, 3) as bigint) % 31 = 0")


def inventory_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    export = inventory(spark, folder)
    export = export.select("sku", *[F.col(c).cast("string").alias(c) for c in ("quantity_on_hand", "days_on_hand", "cost")])
    return as_lines(export, "cast(sku as bigint) % 37 = 0", {"quantity_on_hand": "if(cast(sku as bigint) % 11 = 0, '', quantity_on_hand)"})
