"""Impact estimates, ranked issues, action candidates and finding clusters.

Everything here works on check rows: at most 23 per store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.frames import By, attach, group_window
from tallybrook.functions.scalars import num
from tallybrook.plans import rules


def _choose(key: Column, table: dict, other) -> Column:
    """Value of a small fixed table, as a CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(other))


def _flagged() -> Column:
    return ~F.lower("result").isin("pass", "na")


def _severity_rank() -> Column:
    return _choose(F.lower("severity"), rules.SEVERITY_ORDER, 9)


def _not_fail() -> Column:
    return F.lower("result") != "fail"


def estimate_impact(checks: DataFrame, annual: DataFrame, by: By = ()) -> DataFrame:
    """Flagged checks with annual impact and confidence; none where annual revenue is 0.

    ``annual`` has one ``annual_revenue`` per store.
    """
    rows = attach(checks.filter(_flagged()), annual.select(*by, "annual_revenue"), by)
    rows = rows.filter(F.col("annual_revenue") > 0)
    severity = F.lower("severity")
    pct = _choose(severity, rules.SEVERITY_SHARE, rules.OTHER_SHARE)
    pct = F.when(F.lower("result") == "warning", pct * 0.5).otherwise(pct)
    own = (F.col("check_id") == "avg_discount_rate_trend") & F.col("value").isNotNull()
    excess = F.greatest(F.lit(0.0), F.col("value") - rules.NORMAL_DISCOUNT)
    specific = num("annual_revenue") * excess * rules.RECOVERABLE
    impact = F.when(own, specific).otherwise(num("annual_revenue") * pct)
    confidence = F.when(own, "high").otherwise(_choose(severity, rules.CONFIDENCE, "low"))
    return rows.select(
        *by,
        "check_id",
        F.bround(impact, 0).alias("annual_revenue_impact"),
        confidence.alias("confidence"),
        "severity",
        "result",
    )


def top_issues(checks: DataFrame, annual: DataFrame, by: By = (), max_issues: int | None = rules.MAX_ISSUES) -> DataFrame:
    """Flagged checks by severity, fail before watch, impact, check order; all of them with None."""
    impact = estimate_impact(checks, annual, by).select(*by, "check_id", "annual_revenue_impact")
    flagged = attach(checks.filter(_flagged()), impact, [*by, "check_id"])
    flagged = flagged.withColumn("estimated_annual_impact", F.coalesce("annual_revenue_impact", F.lit(0.0)))
    order = group_window(by).orderBy(_severity_rank(), _not_fail(), F.desc("estimated_annual_impact"), "ord")
    ranked = flagged.withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= max_issues) if max_issues is not None else ranked
    return ranked.select(*by, "rank", "check_id", "category", "severity", "result", "message", "estimated_annual_impact")


def action_candidates(issues: DataFrame, by: By = (), max_actions: int | None = rules.MAX_ACTIONS) -> DataFrame:
    """First issue of each check with its action text and timeline, in issue order."""
    fields = ["rank", "severity", "message", "estimated_annual_impact"]
    first = issues.groupBy(*by, "check_id").agg(F.min_by(F.struct(*fields), "rank").alias("f"))
    first = first.select(*by, "check_id", *[F.col(f"f.{c}").alias(c) for c in fields])
    ranked = first.withColumn("rank", F.row_number().over(group_window(by).orderBy("rank")))
    action = F.coalesce(_choose(F.col("check_id"), rules.ACTIONS, None), F.concat(F.lit("Address "), "message"))
    ranked = ranked.filter(F.col("rank") <= max_actions) if max_actions is not None else ranked
    return ranked.select(
        *by,
        "rank",
        action.alias("action"),
        F.col("check_id").alias("source_check"),
        "severity",
        "estimated_annual_impact",
        _choose(F.lower("severity"), rules.TIMELINE, "this_quarter").alias("timeline"),
    )


def _members(checks: DataFrame) -> DataFrame:
    """Flagged checks joined to the clusters they belong to (a fixed table of 22 rows)."""
    rows = [(i, name, c) for i, (name, members, *_) in enumerate(rules.CLUSTERS, start=1) for c in members]
    table = checks.sparkSession.createDataFrame(rows, "cluster_ord int, name string, check_id string")
    return checks.filter(_flagged()).join(F.broadcast(table), "check_id")


def finding_clusters(checks: DataFrame, by: By = (), min_members: int = 2) -> DataFrame:
    """Clusters with enough flagged members: count, messages worst first, hypothesis, approach."""
    member = F.struct(_severity_rank().alias("s"), _not_fail().alias("w"), F.col("ord").alias("o"), F.col("message").alias("m"))
    groups = _members(checks).groupBy(*by, "cluster_ord", "name").agg(
        F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(member)).alias("members")
    )
    texts = {name: template for name, _, template, _ in rules.CLUSTERS}
    approaches = {name: approach for name, _, _, approach in rules.CLUSTERS}
    messages = F.transform("members", lambda x: x["m"])
    filled = F.replace(
        F.replace(_choose(F.col("name"), texts, ""), F.lit("{n}"), F.col("count").cast("string")),
        F.lit("{worst}"),
        F.get(messages, F.lit(0)),
    )
    return groups.filter(F.col("count") >= min_members).select(
        *by,
        "cluster_ord",
        "name",
        "count",
        F.concat_ws(", ", messages).alias("related_issues"),
        filled.alias("hypothesis"),
        _choose(F.col("name"), approaches, "").alias("approach"),
    )


def strict_clusters(checks: DataFrame, by: By = ()) -> DataFrame:
    """Clusters under the stricter rules: a least count and hits in each named group of checks."""
    conditions = None
    for name, (least, groups) in rules.STRICT_CLUSTERS.items():
        met = F.count(F.lit(1)) >= least
        for hits, ids in groups:
            met = met & (F.count_if(F.col("check_id").isin(ids)) >= hits)
        met = F.when(F.first("name") == name, met)
        conditions = met if conditions is None else F.coalesce(conditions, met)
    groups = _members(checks).groupBy(*by, "cluster_ord", "name").agg(
        F.count(F.lit(1)).alias("count"), conditions.alias("active")
    )
    return groups.filter("active").drop("active")


def structural_clusters(short: DataFrame, long: DataFrame, by: By = ()) -> DataFrame:
    """Clusters that are active in the checks of both a short and a long window."""
    both = finding_clusters(short, by).select(*by, "cluster_ord", "name", F.col("count").alias("short_count"))
    other = finding_clusters(long, by).select(*by, "cluster_ord", F.col("count").alias("long_count"))
    joined = attach(both, other, [*by, "cluster_ord"])
    return joined.filter(F.col("long_count").isNotNull())


def kpi_markers(checks: DataFrame, by: By = ()) -> DataFrame:
    """KPI tree nodes coloured by the worst of their graded checks."""
    rows = [(i, node, c) for i, (node, ids) in enumerate(rules.MARKERS.items(), start=1) for c in ids]
    table = checks.sparkSession.createDataFrame(rows, "node_ord int, node string, check_id string")
    rank = _choose(F.lower("result"), {"pass": 0, "watch": 1, "fail": 2}, None)
    graded = checks.filter(F.lower("result") != "na").join(F.broadcast(table), "check_id")
    worst = graded.groupBy(*by, "node_ord", "node").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("checks"))
    return worst.select(
        *by, "node_ord", "node", "checks", _choose(F.col("worst"), {0: "green", 1: "yellow", 2: "red"}, None).alias("marker")
    )
