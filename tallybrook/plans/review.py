"""The business review: all sections, and one JSON document per store."""

from __future__ import annotations

from datetime import date, datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import attach, durable, gather, side_by_side, without_nan
from tallybrook.ledger import Ledger
from tallybrook.operators import customers, kpis, periods, revenue
from tallybrook.plans import checks, issues, rules

VERSION = "0.1.0"


def data_quality(orders, by=()) -> DataFrame:
    """Warnings: partial last month, short or limited data span."""
    led = Ledger.of(orders, by)
    facts = gather(
        [
            periods.data_span(led).select(*led.by, "span_days"),
            revenue.latest_months(led).select(*led.by, "partial_last_month", "last_month", "last_month_days"),
        ],
        led.by,
    )
    c = F.col

    def warning(kind: str, message: Column, period: Column | None = None, with_data: Column | None = None, days: Column | None = None):
        return F.struct(
            F.lit(kind).alias("type"),
            (period if period is not None else F.lit(None).cast("string")).alias("period"),
            (with_data if with_data is not None else F.lit(None).cast("long")).alias("days_with_data"),
            (days if days is not None else F.lit(None).cast("long")).alias("days"),
            message.alias("message"),
        )

    # Types and texts of the warnings.
    partial = warning(
        "partial_period",
        F.format_string(
            "Latest month (%s) has only %d days of data. MoM comparisons use prior complete months.",
            "last_month",
            "last_month_days",
        ),
        period=c("last_month"),
        with_data=c("last_month_days"),
    )
    short = warning(
        "short_data_span",
        F.format_string(
            "Data spans only %d days. 90d and 365d analyses are unavailable; interpret results with caution.", "span_days"
        ),
        days=c("span_days"),
    )
    limited = warning(
        "limited_data_span",
        F.format_string(
            "Data spans %d days (<1 year). 365d analysis may be unavailable; year-over-year comparisons are limited.",
            "span_days",
        ),
        days=c("span_days"),
    )
    rows = F.array_compact(
        F.array(
            F.when(c("partial_last_month"), partial),
            F.when(c("span_days") < 90, short).when(c("span_days") < 365, limited),
        )
    )
    return facts.select(*led.by, F.inline(rows))


class Review:
    """All sections of the review over shared rollups.

    Sections are small (per store: 3 periods, 13 months, 23 checks) and written once,
    so that those built on others do not run the history again.
    """

    def __init__(self, orders, by=(), period: str | None = None, ref_date: date | None = None,
                 pair_support: float = rules.PAIR_SUPPORT, generated_at: str | None = None):
        self.generated_at = generated_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
        self.ledger = Ledger.of(orders, by, ref_date).keep()
        self.by = self.ledger.by
        self.period = period
        self.pair_support = pair_support

    @cached_property
    def _sections(self) -> dict[str, DataFrame]:
        led = self.ledger
        tasks = {
            "checks": lambda: checks.health_checks(led, pair_support=self.pair_support),
            "blocks": lambda: kpis.period_blocks(led),
            "trend": lambda: kpis.monthly_trend(led),
            "quality": lambda: data_quality(led),
            "metadata": lambda: periods.metadata(led),
            "coverage": lambda: periods.data_coverage(led),
            "repeat": lambda: customers.repeat_purchase_rate(led),
            "annual": lambda: periods.annual_revenue(led),
        }
        return {name: without_nan(df) for name, df in zip(tasks, side_by_side(list(tasks.values())))}

    @property
    def metadata(self) -> DataFrame:
        return self._sections["metadata"]

    @property
    def data_coverage(self) -> DataFrame:
        return self._sections["coverage"]

    @property
    def data_quality(self) -> DataFrame:
        return self._sections["quality"]

    @property
    def periods(self) -> DataFrame:
        """Blocks of the wanted periods that the data covers."""
        blocks = self._sections["blocks"]
        pick = F.coalesce(*[F.when(F.col("period") == p, F.col(f"covered_{p}")) for p in periods.PERIOD_DAYS])
        kept = attach(blocks, self.data_coverage.drop("span_days"), self.by).filter(pick)
        if self.period:
            kept = kept.filter(F.col("period") == self.period)
        return kept.select(*blocks.columns)

    @property
    def monthly_trend(self) -> DataFrame:
        return self._sections["trend"]

    @property
    def repeat_purchase_rate(self) -> DataFrame:
        return self._sections["repeat"]

    @property
    def checks(self) -> DataFrame:
        return self._sections["checks"]

    @property
    def annual_revenue(self) -> DataFrame:
        return self._sections["annual"]

    @cached_property
    def top_issues(self) -> DataFrame:
        return issues.top_issues(self.checks, self.annual_revenue, self.by)

    @cached_property
    def action_candidates(self) -> DataFrame:
        return issues.action_candidates(self.top_issues, self.by)

    @cached_property
    def finding_clusters(self) -> DataFrame:
        return issues.finding_clusters(self.checks, self.by)

    def release(self) -> None:
        self.ledger.release()

    def _listed(self, df: DataFrame, order: str, entry: Column, name: str) -> DataFrame:
        """The rows' entries as one array per store, in ``order``; bounded per store."""
        rows = df.select(*self.by, F.col(order).alias("o"), entry.alias("entry"))
        by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
        listed = F.array_sort(F.collect_list(F.struct("o", "entry")), by_order)
        return rows.groupBy(*self.by).agg(F.transform(listed, lambda x: x["entry"]).alias(name))

    def records(self) -> DataFrame:
        """by, review: the whole review of a store as one nested struct.

        Fields whose type or presence differs from entry to entry are variants: values and
        limits of checks, warnings, months, and the blocks of the covered periods.
        """
        months, warnings = self.monthly_trend, self.data_quality
        plain = [c for c in months.columns if c not in (*self.by, "partial")]
        month = F.when(F.col("partial"), F.to_variant_object(F.struct(*plain, "partial"))).otherwise(F.to_variant_object(F.struct(*plain)))
        trend = self._listed(months, "month", month, "monthly_trend")
        repeat = self.repeat_purchase_rate.select(*self.by, "repeat_purchase_rate")
        blocks = attach(attach(self.periods, trend, self.by), repeat, self.by)
        names = self.periods.columns[len(self.by) + 1 :]
        parts = [F.struct(*names[:8]).alias("summary"), F.struct(*names[8:18]).alias("kpi_tree"), F.struct(*names[18:]).alias("drivers")]
        none = F.array().cast("array<variant>")
        year = [F.coalesce("monthly_trend", none).alias("monthly_trend"), F.coalesce("repeat_purchase_rate", F.lit(0.0)).alias("repeat_purchase_rate")]
        block = F.when(F.col("period") == "365d", F.to_variant_object(F.struct(*parts, *year))).otherwise(F.to_variant_object(F.struct(*parts)))
        days = F.coalesce(*[F.when(F.col("period") == p, F.lit(d)) for p, d in periods.PERIOD_DAYS.items()])
        shown = self._listed(blocks.withColumn("days", days), "days", F.struct("period", block.alias("block")), "periods")
        shown = shown.select(*self.by, F.map_from_entries("periods").alias("periods"))

        own = {"partial_period": ["period", "days_with_data"], "short_data_span": ["days"], "limited_data_span": ["days"]}
        warning = F.coalesce(*[F.when(F.col("type") == t, F.to_variant_object(F.struct("type", *columns, "message"))) for t, columns in own.items()])
        either = lambda name: F.coalesce(F.col(f"{name}_text").cast("variant"), F.col(name).cast("variant")).alias(name)
        check = F.struct(F.col("check_id").alias("id"), "category", "severity", "result", "message", either("value"), either("threshold"))
        issue = F.struct(F.col("check_id").alias("id"), "category", "severity", "result", "message", "estimated_annual_impact")
        action = F.struct("action", "source_check", "severity", "estimated_annual_impact", "timeline")
        facts = [c for c in self.metadata.columns if c not in self.by]
        meta = self.metadata.select(*self.by, F.struct(F.lit(self.generated_at).alias("generated_at"), *facts).alias("metadata"))
        covered = F.struct(*[F.col(f"covered_{p}").alias(p) for p in periods.PERIOD_DAYS])
        lists = [
            self._listed(warnings, "type", warning, "data_quality"),
            self._listed(self.checks, "ord", check, "checks"),
            self._listed(self.top_issues, "rank", issue, "top_issues"),
            self._listed(self.action_candidates, "rank", action, "action_candidates"),
        ]
        doc = gather([meta, self.data_coverage.select(*self.by, covered.alias("data_coverage")), shown, *lists], self.by)
        empty = lambda name: (F.create_map() if name == "periods" else F.array()).cast(doc.schema[name].dataType)
        full = lambda name: F.coalesce(name, empty(name)).alias(name)
        review = F.struct(
            F.lit(VERSION).alias("version"),
            "metadata",
            full("data_quality"),
            "data_coverage",
            full("periods"),
            F.struct(full("checks"), full("top_issues")).alias("health"),
            full("action_candidates"),
        )
        return doc.select(*self.by, review.alias("review"))

    def documents(self) -> DataFrame:
        """by, document: the record of a store as JSON text; null fields are kept."""
        return self.records().select(*self.by, F.to_json("review", {"ignoreNullFields": "false"}).alias("document"))


def review_documents(orders, by=(), period: str | None = None, ref_date: date | None = None,
                     pair_support: float = rules.PAIR_SUPPORT, generated_at: str | None = None) -> DataFrame:
    """One JSON document per store; rollups are released before it is returned.

    ``generated_at`` is the time written into the metadata, the present one if not given.
    """
    review = Review(orders, by, period, ref_date, pair_support, generated_at)
    out = durable(review.documents())
    review.release()
    return out
