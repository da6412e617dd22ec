"""The input of every operator: canonical order lines plus their reusable rollups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, by_key, numbered, stored
from tallybrook.functions.scalars import MONEY, total, whole_days

ROLLUPS = ("goods", "placed", "clients")  # what ``keep()`` can write beside lines, sales and daily sums


class Ledger:
    """Order lines seen by store (``by``) and as of a reference date.

    ``lines`` holds ``order_id, order_date, customer_id, amount`` and optionally
    ``sku, product_name, category, discount, cost, ...``.  Operators read the three
    narrow views ``sales``, ``items`` and ``baskets``, or the rollups ``goods``, ``placed`` and
    ``clients`` with a row per product, order and customer.  After ``keep()`` lines, sales (as
    order days) and rollups are written, and many operators share them.
    """

    def __init__(self, lines: DataFrame, by: Sequence[str] = (), ref_date: date | None = None):
        self.lines = lines
        self.by = list(by)
        self.ref_date = ref_date
        self.kept = False  # whether the views are shared rollups by now
        self._stored: DataFrame | None = None

    @staticmethod
    def of(orders: Ledger | DataFrame, by: Sequence[str] = (), ref_date: date | None = None) -> Ledger:
        """A ledger of order lines, or the given one if ``by`` and ``ref_date`` agree with it."""
        if not isinstance(orders, Ledger):
            return Ledger(orders, by, ref_date)
        if by and list(by) != orders.by or ref_date and ref_date != orders.ref_date:
            raise ValueError("the ledger has other grouping columns or another reference date")
        return orders

    def has(self, column: str) -> bool:
        return column in self.lines.columns

    @property
    def product_key(self) -> str | None:
        return next((c for c in ("sku", "product_name") if self.has(c)), None)

    @cached_property
    def sales(self) -> DataFrame:
        """by, order_id, customer_id, day, first_ts, last_ts, amount, discount, gross, lines, discounted_lines."""
        return self._sales()

    def _sales(self, *more: Column) -> DataFrame:
        amount = F.col("amount").cast(MONEY)
        discount = F.col("discount").cast(MONEY) if self.has("discount") else F.lit(None).cast(MONEY)
        used = ["order_id", "customer_id", "order_date", "amount", *([self.product_key] if more else [])]
        return self.lines_with(*used).select(
            *self.by,
            "order_id",
            "customer_id",
            F.to_date("order_date").alias("day"),
            F.col("order_date").alias("first_ts"),
            F.col("order_date").alias("last_ts"),
            amount.alias("amount"),
            discount.alias("discount"),
            (amount + discount).alias("gross"),
            F.lit(1).cast("long").alias("lines"),
            F.coalesce((discount > 0).cast("long"), F.lit(0)).alias("discounted_lines"),
            *more,
        )

    @cached_property
    def items(self) -> DataFrame:
        """by, product, month, amount, priced_lines, lines for lines with a product key."""
        return self._items(self._amounts())

    def _amounts(self) -> DataFrame:
        key = self.need_key()
        return self.lines_with(key, "order_date", "amount").filter(F.col(key).isNotNull()).select(
            *self.by,
            F.col(key).cast("string").alias("product"),
            F.trunc(F.to_date("order_date"), "month").alias("month"),
            F.col("amount").cast(MONEY).alias("amount"),
        )

    def _items(self, amounts: DataFrame) -> DataFrame:
        return amounts.select("*", F.col("amount").isNotNull().cast("long").alias("priced_lines"), F.lit(1).cast("long").alias("lines"))

    @cached_property
    def baskets(self) -> DataFrame:
        """by, order_id, product (null kept so that item-less orders still count)."""
        key = self.need_key()
        return self.lines_with(key, "order_id").filter(F.col("order_id").isNotNull()).select(
            *self.by, "order_id", F.col(key).cast("string").alias("product")
        )

    @cached_property
    def goods(self) -> DataFrame:
        """by, product, amount, lines, priced_lines; of lines with a date: dated_amount, months and
        the amounts ``newest``, ``second`` and ``third`` of the last three months that have any.

        The window holds the months of a product, not its lines.
        """
        return self._by_key(self._amounts(), "product", self._goods)

    def _goods(self, amounts: DataFrame) -> DataFrame:
        months = self._items(amounts).groupBy(*self.by, "product", "month").agg(
            total("amount").alias("amount"), F.sum("lines").alias("lines"), F.sum("priced_lines").alias("priced_lines")
        )
        months, keys = numbered(months, [*self.by, "product"])
        back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("month")))
        dated = F.col("month").isNotNull()
        each = months.withColumn("_back", back).groupBy(*keys).agg(
            F.sum("amount").alias("amount"),
            F.sum("lines").alias("lines"),
            F.sum("priced_lines").alias("priced_lines"),
            total(F.when(dated, F.col("amount"))).alias("dated_amount"),
            F.count("month").alias("months"),
            *[F.max(F.when(dated & (F.col("_back") == i), F.col("amount"))).alias(n) for i, n in enumerate(("newest", "second", "third"), 1)],
        )
        return each.drop("_number")

    @cached_property
    def placed(self) -> DataFrame:
        """by, order_id, order_total, its first and last month, and of its products: item_lines and
        the least and greatest hash."""
        return self._placed(self.order_days(self._sales(*self._hashes()), hashes=True))

    def _hashes(self) -> list[Column]:
        """Hash of a line's product, null without one: numbers are compared and kept cheaply.

        Four bytes do: orders whose lines share one hash are looked up anyway.
        """
        key = F.col(self.product_key).cast("string") if self.product_key else F.lit(None).cast("string")
        hashed = F.when(key.isNotNull(), F.hash(key))
        return [hashed.alias("low"), hashed.alias("high"), key.isNotNull().cast("long").alias("item_lines")]

    def _placed(self, days: DataFrame) -> DataFrame:
        month = F.trunc("day", "month")
        return days.filter(F.col("order_id").isNotNull()).groupBy(*self.by, "order_id").agg(
            total("amount").alias("order_total"),
            F.min(month).alias("first_month"),
            F.max(month).alias("last_month"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum("item_lines").alias("item_lines"),
        )

    @cached_property
    def clients(self) -> DataFrame:
        """``client_days`` and each customer's distinct ``orders``."""
        return self._by_key(self.sales.filter(F.col("customer_id").isNotNull()), "customer_id", self._clients)

    def _clients(self, known: DataFrame) -> DataFrame:
        keys = [*self.by, "customer_id"]
        pairs = known.select(*keys, "order_id").distinct()
        both = self._client_days(known).unionByName(pairs.groupBy(*keys).agg(F.count("order_id").alias("orders")), allowMissingColumns=True)
        return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])

    @property
    def client_days(self) -> DataFrame:
        """by, customer_id, revenue, last_ts, first_day, first_revenue, gap, dated_lines.

        ``gap`` is the sum of whole days between a customer's lines.  Lines of one day are less
        than a day apart and add nothing, so the window holds a customer's days, not the lines.
        """
        return self._client_days(self.sales.filter(F.col("customer_id").isNotNull()))

    def _client_days(self, known: DataFrame) -> DataFrame:
        keys = [*self.by, "customer_id"]
        days = known.groupBy(*keys, "day").agg(
            F.min("first_ts").alias("a"), F.max("last_ts").alias("b"), F.sum("lines").alias("lines"), total("amount").alias("amount")
        )
        days, grouped = numbered(days, keys)
        gap = whole_days(F.lag("b").over(Window.partitionBy(*grouped).orderBy("day")), F.col("a"))
        each = days.withColumn("gap", gap).groupBy(*grouped).agg(
            F.sum("amount").alias("revenue"),
            F.max("b").alias("last_ts"),
            F.min("day").alias("first_day"),
            F.min_by("amount", "day").alias("first_revenue"),
            F.coalesce(F.sum("gap"), F.lit(0)).alias("gap"),
            F.sum(F.when(F.col("day").isNotNull(), F.col("lines"))).alias("dated_lines"),
        )
        return each.drop("_number")

    @cached_property
    def daily(self) -> DataFrame:
        """``sales`` for sums over days or stores: after ``keep()`` one row per store and day."""
        return self.sales

    def lines_with(self, *columns: str) -> DataFrame:
        """The lines, from the written copy of ``keep()`` if that has all ``columns``."""
        if self._stored is not None and set(columns) <= set(self._stored.columns):
            return self._stored
        return self.lines

    def _by_key(self, rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``step`` on rows that meet by ``key`` first, if they come from the written copy of ``keep()``."""
        return step(rows) if self._stored is None else by_key(rows, [*self.by, key], step)

    def few(self, stores: DataFrame) -> DataFrame:
        """A row per store, to be attached to a written rollup.

        They are written too: the planner then sees how few they are, and does not shuffle the
        rollup by store.
        """
        return stored(stores) if self.kept and self.by else stores

    def need_key(self) -> str:
        if self.product_key is None:
            raise ValueError("product operators need a 'sku' or 'product_name' column")
        return self.product_key

    def keep(self, *rollups: str) -> Ledger:
        """Write the lines once, and from that copy order days, daily sums and ``rollups``, all by default.

        Lines often come from joins, so their source is read a single time.
        """
        if self.kept:
            return self
        wanted = [r for r in rollups or ROLLUPS if r != "goods" or self.product_key]
        used = ["order_id", "order_date", "customer_id", "amount", "discount", self.product_key, "category", "cost"]
        self._stored = stored(self.lines.select(*self.by, *[c for c in used if c and c not in self.by and self.has(c)]))
        self._forget()  # views may have been built on the source

        def goods() -> None:
            self.goods = stored(self.goods)

        def days() -> None:
            hashed = "placed" in wanted
            self.sales = stored(self.order_days(self._sales(*self._hashes()) if hashed else self._sales(), hashed))
            later = {"daily": self._days(self.sales)}
            later |= {"placed": self._placed(self.sales)} if hashed else {}
            later |= {"clients": self.clients} if "clients" in wanted else {}
            with ThreadPoolExecutor(max_workers=3) as pool:
                for view, written in zip(later, pool.map(stored, later.values())):
                    setattr(self, view, written)

        with ThreadPoolExecutor(max_workers=2) as pool:
            for done in [pool.submit(step) for step in ([days, goods] if "goods" in wanted else [days])]:
                done.result()
        self.kept = True
        return self

    def kept_rollup(self, name: str) -> DataFrame | None:
        """The written rollup of that name, if there is one."""
        return self.__dict__.get(name) if self.kept else None

    def release(self) -> None:
        """Go back to the lines themselves."""
        self._stored, self.kept = None, False
        self._forget()

    def _forget(self) -> None:
        for view in ("sales", "items", "baskets", "daily", "first_days", "reference", *ROLLUPS):
            self.__dict__.pop(view, None)

    def _days(self, sales: DataFrame) -> DataFrame:
        sums = ["amount", "discount", "gross", "lines", "discounted_lines"]
        return sales.groupBy(*self.by, "day").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *[F.sum(c).alias(c) for c in sums]
        )

    def order_days(self, sales: DataFrame, hashes: bool = False) -> DataFrame:
        """``sales`` with one row per order, customer and day, unless they are already rolled up.

        Lines of an order usually lie together, so most of them collapse before the
        shuffle, and whatever follows (joins, windows, distinct counts) is smaller.
        """
        if self.kept:
            return sales
        measures = ["amount", "discount", "gross", "lines", "discounted_lines", *(["item_lines"] if hashes else [])]
        return sales.groupBy(*self.by, "order_id", "customer_id", "day").agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            *[F.sum(c).alias(c) for c in measures],
            *([F.min("low").alias("low"), F.max("high").alias("high")] if hashes else []),
        )

    @cached_property
    def newest_day(self) -> date | None:
        """The reference date if one serves all stores: given, or the newest order day.

        The latter is one value fetched by one aggregate; as a literal it bounds later
        scans without being computed again in each of them.
        """
        if self.ref_date or self.by:
            return self.ref_date
        return self.daily.agg(F.max("day").alias("ref")).first()["ref"]

    @cached_property
    def reference(self) -> DataFrame:
        """One row per store with its reference date ``ref``."""
        if self.by and not self.ref_date:
            return self.daily.groupBy(*self.by).agg(F.max("day").alias("ref"))
        day = F.lit(self.newest_day).cast("date").alias("ref")
        if not self.by:
            return self.lines.sparkSession.range(1).select(day)
        return self.daily.select(*self.by).distinct().select(*self.by, day)

    def with_reference(self, df: DataFrame) -> DataFrame:
        if self.by and not self.ref_date:
            return attach(df, self.reference, self.by)
        return df.withColumn("ref", F.lit(self.newest_day).cast("date"))

    @cached_property
    def first_days(self) -> DataFrame:
        """First order day of each known customer over the full history."""
        if self.kept_rollup("clients") is not None:
            return self.clients.select(*self.by, "customer_id", "first_day")
        return (
            self.sales.filter(F.col("customer_id").isNotNull())
            .groupBy(*self.by, "customer_id")
            .agg(F.min("day").alias("first_day"))
        )

    def with_first_day(self, df: DataFrame) -> DataFrame:
        """Add ``first_day``; guests get null and stay outside the join, where they would share a key."""
        keys = [*self.by, "customer_id"]
        first = self.first_days.select(*[F.col(k).alias(f"_f_{k}") for k in keys], "first_day")
        cond = F.col("customer_id") == F.col("_f_customer_id")
        for k in self.by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_f_{k}"))
        known = df.filter(F.col("customer_id").isNotNull())
        guests = df.filter(F.col("customer_id").isNull()).withColumn("first_day", F.lit(None).cast("date"))
        return known.join(first, cond, "left").drop(*[f"_f_{k}" for k in keys]).unionByName(guests)

    def recent_sales(self, oldest: int) -> DataFrame:
        """Sales from ``oldest`` days before the reference date up to it, with ``ref``.

        One reference date gives literal bounds on the raw timestamp, which reach the
        scan; per-store dates filter after the join.
        """
        if self.by and not self.ref_date:
            return self.with_reference(self.sales).filter(F.col("day").between(F.date_sub("ref", oldest), F.col("ref")))
        ref = F.lit(self.newest_day).cast("date")
        inside = (F.col("first_ts") >= F.date_sub(ref, oldest)) & (F.col("first_ts") < F.date_add(ref, 1))
        return self.sales.filter(inside).withColumn("ref", ref)

    def recent(self, oldest: int) -> DataFrame:
        """Order days from ``oldest`` days before the reference date up to it, with ``ref``."""
        if self.by and not self.ref_date:
            df = self.with_reference(self.order_days(self.sales))
            return df.filter(F.col("day").between(F.date_sub("ref", oldest), F.col("ref")))
        return self.order_days(self.recent_sales(oldest).drop("ref")).withColumn("ref", F.lit(self.newest_day).cast("date"))
