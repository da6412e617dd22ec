"""Oracle SQL of the review document: every value in it as a row (path, text, number)."""

from __future__ import annotations

from workload.oracle_base import ANNUAL, COVERAGE, Source, query, r
from workload.oracle_checks import IMPACT, ISSUES, check_parts

# Columns of the blocks in the document's order.
SUMMARY = ("revenue", "revenue_change", "orders", "orders_change", "aov", "aov_change", "customers", "customers_change")
TREE = [
    f"{side}_{name}"
    for side in ("new", "returning")
    for name in ("customer_revenue", "customer_revenue_share", "customers", "customers_change", "customer_aov")
]
DRIVERS = ("aov_effect", "volume_effect", "mix_effect")
MONTH = ("revenue", "orders", "aov", "customers", "new_customers", "returning_customers", "days_with_data")
NO_TEXT, NO_NUMBER = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"


def _leaf(path: str, table: str, text: str = NO_TEXT, number: str = NO_NUMBER, where: str = "true") -> str:
    shown = NO_NUMBER if number == NO_NUMBER else r(number)
    return f"SELECT store_id, {path} AS path, CAST({text} AS VARCHAR) AS text, {shown} AS number FROM {table} WHERE {where}"


def _listed(section: str, table: str, texts: dict[str, str], numbers: dict[str, str]) -> list[str]:
    """Leaves of the rows of a table that numbers them as ``place``."""
    path = lambda name: f"'/{section}/' || place || '/{name}'"
    return [_leaf(path(n), table, text=c) for n, c in texts.items()] + [_leaf(path(n), table, number=c) for n, c in numbers.items()]


def document(src: Source, block: str, trend: str, quality: str, actions: str, support: float, period: str | None = None) -> str:
    """``src``, ``block``, ``trend`` and ``quality`` have a store column."""
    parts = [
        *check_parts(support, False), COVERAGE, ANNUAL, IMPACT, ISSUES,
        f"block AS ({block})",
        f"months_shown AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month) - 1 AS place FROM ({trend}))",
        f"warnings AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY type) - 1 AS place FROM ({quality}))",
        """facts AS (SELECT store_id, strftime(min(day), '%Y-%m-%d') AS data_start, strftime(max(day), '%Y-%m-%d') AS data_end,
            count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers, sum(amount) AS total_revenue
            FROM o GROUP BY store_id)""",
        """covered AS (SELECT store_id, unnest(['30d', '90d', '365d']) AS period, unnest([span_days >= 45, span_days >= 120, span_days >= 400]) AS yes
            FROM spans)""",
        f"shown AS (SELECT block.* FROM block JOIN covered USING (store_id, period) WHERE yes AND {'true' if period is None else f'period = {period!r}'})",
        "year AS (SELECT store_id FROM shown WHERE period = '365d')",
        f"""places AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY ord) - 1 AS place FROM checks),
        found_issues AS (SELECT *, rank - 1 AS place FROM issues),
        found_actions AS (SELECT *, CASE severity WHEN 'critical' THEN 'this_week' WHEN 'high' THEN 'this_month' ELSE 'this_quarter' END AS timeline
            FROM found_issues JOIN (VALUES {actions}) AS a(check_id, action) USING (check_id))""",
    ]
    head = {n: n for n in ("category", "severity", "result", "message")}
    leaves = [
        _leaf("'/version'", "facts", text="'0.1.0'"),
        _leaf("'/metadata/generated_at'", "facts", text="'2020-01-01T00:00:00'"),
        _leaf("'/metadata/currency'", "facts", text="'USD'"),
        _leaf("'/metadata/revenue_definition'", "facts", text="'Net sales after discounts, before tax and shipping'"),
        *[_leaf(f"'/metadata/{n}'", "facts", text=n) for n in ("data_start", "data_end")],
        *[_leaf(f"'/metadata/{n}'", "facts", number=n) for n in ("total_orders", "total_customers", "total_revenue")],
        _leaf("'/data_coverage/' || period", "covered", text="yes"),
        *_listed("data_quality", "warnings", {"type": "type", "message": "message"}, {}),
        _leaf("'/data_quality/' || place || '/period'", "warnings", text="period", where="type = 'partial_period'"),
        _leaf("'/data_quality/' || place || '/days_with_data'", "warnings", number="days_with_data", where="type = 'partial_period'"),
        _leaf("'/data_quality/' || place || '/days'", "warnings", number="days", where="type <> 'partial_period'"),
        *[
            _leaf(f"'/periods/' || period || '/{part}/{n}'", "shown", number=n)
            for part, names in (("summary", SUMMARY), ("kpi_tree", TREE), ("drivers", DRIVERS))
            for n in names
        ],
        _leaf("'/periods/365d/repeat_purchase_rate'", "year JOIN rates USING (store_id)", number="repeat_purchase_rate"),
        _leaf("'/periods/365d/monthly_trend/' || place || '/month'", "year JOIN months_shown USING (store_id)", text="month"),
        *[_leaf(f"'/periods/365d/monthly_trend/' || place || '/{n}'", "year JOIN months_shown USING (store_id)", number=n) for n in MONTH],
        _leaf("'/periods/365d/monthly_trend/' || place || '/partial'", "year JOIN months_shown USING (store_id)", text="'true'", where="partial"),
        *_listed("health/checks", "places", {"id": "check_id", **head}, {}),
        *[_leaf(f"'/health/checks/' || place || '/{n}'", "places", text=f"{n}_text", number=n) for n in ("value", "threshold")],
        *_listed("health/top_issues", "found_issues", {"id": "check_id", **head}, {"estimated_annual_impact": "est"}),
        *_listed(
            "action_candidates", "found_actions",
            {"action": "action", "source_check": "check_id", "severity": "severity", "timeline": "timeline"}, {"estimated_annual_impact": "est"},
        ),
    ]
    key = "store_id, " if src.key else ""
    return query(src, parts, f"SELECT {key}path, text, number FROM (" + "\nUNION ALL ".join(leaves) + ")")
