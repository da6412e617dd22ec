"""Orders, products and inventory from files or tables, in canonical columns."""

from __future__ import annotations

import csv
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.functions.scalars import MONEY
from tallybrook.sources.headers import (
    NOTES_WITHOUT,
    REQUIRED,
    SHOPIFY_ORDER_MARKERS,
    SHOPIFY_ORDERS,
    SHOPIFY_PRODUCT_MARKERS,
    SHOPIFY_PRODUCTS,
)
from tallybrook.sources.mapping import map_columns, parse_timestamp, rename


class Validation(NamedTuple):
    valid: bool
    missing_columns: list[str]
    warnings: list[str]


def detect_format(columns: list[str]) -> str:
    return "shopify" if SHOPIFY_ORDER_MARKERS <= set(columns) else "generic"


def validate_schema(df: DataFrame, schema: str) -> Validation:
    """Required columns of ``orders``, ``products`` or ``inventory``; other names need none."""
    lacking = [name for name in sorted(REQUIRED.get(schema, ())) if name not in df.columns]
    notes = [text for (kind, name), text in NOTES_WITHOUT.items() if kind == schema and name not in df.columns]
    return Validation(not lacking, lacking, notes)


def conform(df: DataFrame, kind: str) -> DataFrame:
    """One projection: each canonical column of ``kind`` in its type, others as they are."""
    typed = CANONICAL[kind]
    out = df.select(*[typed.get(c, _as_is)(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if lacking := validate_schema(out, kind).missing_columns:
        raise ValueError(f"{kind} source lacks required columns: {lacking}")
    return out


def quality_report(raw: DataFrame, date_cols=("order_date",), number_cols=("amount", "discount", "quantity", "item_price")) -> DataFrame:
    """column, rows, nulls, unparsable: counts per canonical column in one pass."""
    aggs, kept = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(raw.columns):
        col = F.col(f"`{c}`")
        parsed = parse_timestamp(col) if c in date_cols else col.try_cast(MONEY) if c in number_cols else col
        aggs += [F.count_if(col.isNull()).alias(f"n{i}"), F.count_if(col.isNotNull() & parsed.isNull()).alias(f"b{i}")]
        kept.append(
            F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("unparsable"))
        )
    return raw.agg(*aggs).select(F.inline(F.array(*kept)))


def read_table(spark: SparkSession, path: str, kind: str = "csv", multi_line: bool = True) -> DataFrame:
    """CSV with a header and all columns as text, or parquet, orc, json, or a catalogue table.

    Quoted CSV fields may hold line breaks, so a file is one task; files known to have none
    can be split with ``multi_line=False``.  Rows of another width than the header raise.
    """
    if kind == "table":
        return spark.table(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', mode="FAILFAST")
    return spark.read.format(kind).load(path)


def _as_is(c: Column) -> Column:
    return c


def _money(c: Column) -> Column:
    return c.try_cast(MONEY)


def _money_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


def _text(c: Column) -> Column:
    return c.cast("string")


CANONICAL: dict[str, dict[str, Callable[[Column], Column]]] = {
    "orders": {
        "order_id": _text, "customer_id": _text, "sku": _text, "amount": _money, "cost": _money, "discount": _money_or_zero,
    },
    "products": {"price": _money},
    "inventory": {"quantity_on_hand": _money, "days_on_hand": _money, "cost": _money},
}


def _dates(df: DataFrame, on_bad_date: str) -> DataFrame:
    if "order_date" not in df.columns or df.schema["order_date"].dataType.typeName().startswith("timestamp"):
        return df
    raw = F.col("order_date")
    parsed = parse_timestamp(raw)
    if on_bad_date == "quarantine":
        return df.filter(parsed.isNotNull() | raw.isNull()).withColumn("order_date", parsed)
    if on_bad_date != "fail":
        raise ValueError("on_bad_date is 'fail' or 'quarantine'")
    bad = F.raise_error(F.concat(F.lit("cannot read order date: "), raw.cast("string"))).cast("timestamp")
    return df.withColumn("order_date", F.coalesce(parsed, F.when(raw.isNotNull(), bad)))


def bad_dates(df: DataFrame) -> DataFrame:
    """Rows that ``on_bad_date="quarantine"`` leaves out."""
    mapped = map_columns(df) if detect_format(df.columns) == "generic" else rename(df, SHOPIFY_ORDERS)
    return mapped.filter(F.col("order_date").isNotNull() & parse_timestamp(F.col("order_date")).isNull())


def _is_shop(columns: list[str], fmt: str) -> bool:
    return (detect_format(columns) if fmt == "auto" else fmt) == "shopify"


def normalise_orders(df: DataFrame, fmt: str = "auto", on_bad_date: str = "fail") -> DataFrame:
    """Canonical names and types; a missing amount becomes quantity × item price."""
    shop = _is_shop(df.columns, fmt)
    return _typed_orders(rename(df, SHOPIFY_ORDERS) if shop else map_columns(df), shop, on_bad_date)


def _typed_orders(named: DataFrame, shop: bool, on_bad_date: str) -> DataFrame:
    if not shop and "amount" not in named.columns and {"quantity", "item_price"} <= set(named.columns):
        named = named.withColumns({c: _money(F.col(c)) for c in ("quantity", "item_price")})
        named = named.withColumn("amount", F.col("quantity") * F.col("item_price"))
    return conform(_dates(named, on_bad_date), "orders")


def load_orders(
    spark: SparkSession,
    path: str,
    fmt: str = "auto",
    kind: str = "csv",
    on_bad_date: str = "fail",
    multi_line: bool = True,
) -> DataFrame:
    """Orders in canonical form, from the whole source."""
    return normalise_orders(read_table(spark, path, kind, multi_line), fmt, on_bad_date)


class Loaded(NamedTuple):
    """Canonical ``rows``, and ``rejected`` lines with the ``reason`` they were left out for."""

    rows: DataFrame
    rejected: DataFrame


LINE, WIDTH, WHEN = "_line", "_other_width", "_when"


def parse_lines(lines: DataFrame, header: str, text_col: str = "value") -> DataFrame:
    """Rows of CSV text as columns of ``header``, all text, with the line itself as ``_line``.

    A line with another number of fields has its text in ``_other_width`` as well.  Lines are
    parsed one by one, so any splitting of the input will do; a quoted field ends on its line.
    """
    names = next(csv.reader([header]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, WIDTH])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": WIDTH, "escape": '"'}
    line = F.col(f"`{text_col}`")
    row = F.from_csv(line, schema, options)
    # Unfolded from a list of one: a filter on the columns does not parse the line once more.
    return lines.filter(line != header).select(line.alias(LINE), F.inline(F.array(row)))


def load_lines(lines: DataFrame, header: str, kind: str = "orders", fmt: str = "auto", text_col: str = "value") -> Loaded:
    """``orders``, ``products`` or ``inventory`` from CSV lines, rejecting bad ones one by one.

    Reasons are ``width`` (more or fewer fields than the header) and, for orders,
    ``order_date`` (a date that no pattern fits).  Both outputs are views of the same lines,
    each read once; a line and its date are parsed once in either.
    """
    parsed = parse_lines(lines, header, text_col)
    good = parsed.filter(F.col(WIDTH).isNull()).drop(WIDTH)
    rejected = parsed.filter(F.col(WIDTH).isNotNull()).select(F.col(LINE).alias("line"), F.lit("width").alias("reason"))
    if kind == "orders":
        shop = _is_shop(good.columns, fmt)
        named = rename(good, SHOPIFY_ORDERS) if shop else map_columns(good)
        if "order_date" not in named.columns:
            return Loaded(_typed_orders(named, shop, "quarantine").drop(LINE), rejected)
        named = rename(parsed, dict(zip(good.columns, named.columns)))
        named = named.select("*", F.explode(F.array(parse_timestamp(F.col("order_date")))).alias(WHEN))
        late = F.col("order_date").isNotNull() & F.col(WHEN).isNull()
        reason = F.when(F.col(WIDTH).isNotNull(), "width").when(late, "order_date")
        rejected = named.select(F.col(LINE).alias("line"), reason.alias("reason")).filter(F.col("reason").isNotNull())
        kept = named.filter(F.col(WIDTH).isNull() & ~late).withColumn("order_date", F.col(WHEN)).drop(WIDTH, WHEN)
        rows = _typed_orders(kept, shop, "quarantine")
    elif kind == "products":
        rows = normalise_products(good)
    elif kind == "inventory":
        rows = conform(good, "inventory")
    else:
        raise ValueError("kind is 'orders', 'products' or 'inventory'")
    return Loaded(rows.drop(LINE), rejected)


def load_csv_lines(spark: SparkSession, path: str, kind: str = "orders", fmt: str = "auto") -> Loaded:
    """``load_lines`` of the CSV files at ``path``, whose first lines are the same header."""
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        raise ValueError(f"{path} has no header")
    return load_lines(lines, header["value"], kind, fmt)


def normalise_products(raw: DataFrame) -> DataFrame:
    return conform(rename(raw, SHOPIFY_PRODUCTS) if SHOPIFY_PRODUCT_MARKERS <= set(raw.columns) else raw, "products")


def load_products(spark: SparkSession, path: str, kind: str = "csv", multi_line: bool = True) -> DataFrame:
    return normalise_products(read_table(spark, path, kind, multi_line))


def load_inventory(spark: SparkSession, path: str, kind: str = "csv", multi_line: bool = True) -> DataFrame:
    return conform(read_table(spark, path, kind, multi_line), "inventory")
