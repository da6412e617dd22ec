import datetime as dt
import json

import pytest

from tallybrook.functions.frames import without_nan
from tallybrook.functions.scalars import fixed
from tallybrook.plans import checks, issues, review, rules
from tallybrook.sources import sinks
from tests.conftest import one

SCHEMA = (
    "ord int, check_id string, category string, severity string, result string, message string, "
    "value double, value_text string, threshold double, threshold_text string"
)


@pytest.fixture
def make_checks(spark):
    def make(**results):
        facts = {c: (i, cat, sev) for i, (c, cat, sev, _) in enumerate(rules.CHECKS, start=1)}
        rows = [(facts[c][0], c, facts[c][1], facts[c][2], res, f"{c} text", 0.2, None, None, None) for c, res in results.items()]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def annual(spark):
    return spark.createDataFrame([(1_000_000.0,)], "annual_revenue double")


def test_issue_order_impact_and_timeline(make_checks, annual):
    given = make_checks(
        aov_trend="watch", order_count_trend="fail", repeat_purchase_rate="watch", avg_discount_rate_trend="fail",
        daily_revenue_volatility="na", multi_item_order_rate="pass", lost_segment_share="fail",
    )
    got = issues.top_issues(given, annual).orderBy("rank").collect()
    assert [r["check_id"] for r in got] == [
        "repeat_purchase_rate", "avg_discount_rate_trend", "order_count_trend", "aov_trend", "lost_segment_share",
    ]
    # (0.2 - 0.12) * 0.5 of a million for the discount rate, a fixed share otherwise
    assert [r["estimated_annual_impact"] for r in got] == [30000.0, 40000.0, 15000.0, 15000.0, 5000.0]
    actions = issues.action_candidates(issues.top_issues(given, annual)).orderBy("rank").collect()
    assert [a["timeline"] for a in actions] == ["this_week"] + ["this_month"] * 3 + ["this_quarter"]
    assert actions[0]["action"] == rules.ACTIONS["repeat_purchase_rate"]


def test_no_revenue_means_no_impact(make_checks, spark):
    zero = spark.createDataFrame([(0.0,)], "annual_revenue double")
    given = make_checks(aov_trend="fail")
    assert issues.estimate_impact(given, zero).count() == 0
    assert one(issues.top_issues(given, zero))["estimated_annual_impact"] == 0.0


def test_issue_limit(make_checks, annual):
    given = make_checks(**{c: "fail" for c, *_ in rules.CHECKS})
    assert issues.top_issues(given, annual).count() == 10


def test_clusters(make_checks):
    given = make_checks(
        repeat_customer_revenue_share="fail", repeat_purchase_rate="watch", champions_loyal_share="fail",
        avg_discount_rate_trend="fail", discounted_order_ratio="pass",
    )
    r = one(issues.finding_clusters(given))
    assert (r["name"], r["count"]) == ("Customer & LTV Engine Weakness", 3)
    assert r["hypothesis"].startswith("3 customer") and "repeat_customer_revenue_share text is most severe" in r["hypothesis"]
    assert r["related_issues"].split(", ")[-1] == "champions_loyal_share text"
    assert one(issues.strict_clusters(given))["cluster_ord"] == 3
    assert issues.finding_clusters(make_checks(converting_sku_rate="na", multi_item_order_rate="fail")).count() == 0


def test_structural_needs_both_windows(make_checks):
    both = make_checks(converting_sku_rate="fail", multi_item_order_rate="fail")
    other = make_checks(converting_sku_rate="fail", multi_item_order_rate="pass")
    assert issues.structural_clusters(both, both).count() == 1
    assert issues.structural_clusters(both, other).count() == 0


def test_markers(make_checks):
    given = make_checks(aov_trend="pass", order_count_trend="watch", repeat_purchase_rate="fail", price_tier_distribution="na")
    got = {r["node"]: r["marker"] for r in issues.kpi_markers(given).collect()}
    assert got == {"Revenue": "yellow", "Existing Customer Revenue": "red"}


@pytest.mark.parametrize("value,digits", [(43.05, 1), (0.125, 2), (2.5, 0), (3.5, 0), (-0.04, 1), (99.95, 1), (0.0, 1), (1234.5678, 2)])
def test_fixed_equals_exact_half_even(spark, value, digits):
    got = one(spark.createDataFrame([(value,)], "v double").select(fixed("v", digits).alias("t")))["t"]
    assert got == f"{value:.{digits}f}"


def shop(n_days=450, start=dt.datetime(2024, 1, 1)):
    return [
        (f"o{i}", start + dt.timedelta(days=i), f"c{i % 40}", 50.0 + i % 17, f"s{(i + j) % 11}")
        for i in range(n_days)
        for j in range(2)
    ]


def test_review_document_contract(make_orders, tmp_path):
    docs = review.review_documents(make_orders(shop(), ", sku string"))
    doc = json.loads(one(docs)["document"])
    assert list(doc) == ["version", "metadata", "data_quality", "data_coverage", "periods", "health", "action_candidates"]
    assert doc["data_coverage"] == {"30d": True, "90d": True, "365d": True}
    assert set(doc["periods"]) == {"30d", "90d", "365d"}
    assert set(doc["periods"]["365d"]) == {"summary", "kpi_tree", "drivers", "monthly_trend", "repeat_purchase_rate"}
    assert set(doc["periods"]["30d"]) == {"summary", "kpi_tree", "drivers"}
    ids = [c["id"] for c in doc["health"]["checks"]]
    assert ids == [c for c, *_ in rules.CHECKS if c in ids] and "cross_sell_pair_lift" in ids
    assert "discounted_order_ratio" not in ids and "category_margin_variance" not in ids
    by_id = {c["id"]: c for c in doc["health"]["checks"]}
    assert by_id["avg_discount_rate_trend"]["result"] == "na" and by_id["avg_discount_rate_trend"]["value"] is None
    assert len(doc["action_candidates"]) == len(doc["health"]["top_issues"])
    path = sinks.write_review(docs, str(tmp_path), "90d")
    assert path.endswith("review_90d.json")


def test_review_short_span_and_period(make_orders):
    doc = json.loads(one(review.review_documents(make_orders(shop(30), ", sku string")))["document"])
    assert doc["periods"] == {} and "short_data_span" in [w["type"] for w in doc["data_quality"]]
    picked = json.loads(one(review.review_documents(make_orders(shop(130), ", sku string"), period="90d"))["document"])
    assert list(picked["periods"]) == ["90d"]


def test_a_rerun_leaves_other_stores(spark, tmp_path):
    def documents(*rows):
        return spark.createDataFrame(rows, "store_id string, document string")

    sinks.write_review(documents(("a", '{"n": 1}'), ("b", '{"n": 1}'), (None, '{"n": 1}')), str(tmp_path))
    path = sinks.write_review(documents(("b", '{"n": 2}')), str(tmp_path))
    found = {r["store_id"]: json.loads(r["value"])["n"] for r in spark.read.text(path).collect()}
    assert found == {"a": 1, "b": 2, None: 1}
    one_store = documents(("a", "{}")).drop("store_id")
    assert spark.read.text(sinks.write_review(one_store, str(tmp_path), "30d")).count() == 1


def test_nested_nan_and_infinity_are_null(spark):
    kind = "id int, v double, s struct<x: double, t: string>, l array<struct<y: float, deep: array<double>>>, m map<string, double>, n struct<z: double>"
    nan, inf = float("nan"), float("inf")
    row = (1, nan, (inf, "NaN"), [(-inf, [nan, 1.5, None]), (2.5, None), None], {"a": -inf, "b": 0.0}, None)
    df = spark.createDataFrame([row], kind)
    out = one(without_nan(df))
    assert out.v is None and out.s.x is None and out.s.t == "NaN" and out.n is None
    assert out.l[0].y is None and out.l[0].deep == [None, 1.5, None] and out.l[1].y == 2.5 and out.l[1].deep is None and out.l[2] is None
    assert out.m == {"a": None, "b": 0.0}
    assert without_nan(df).dtypes == df.dtypes


def test_document_keeps_null_fields_and_types(make_orders):
    rows = [(f"o{i}", dt.datetime(2025, 1, 1) + dt.timedelta(days=i), f"c{i}", 0.0) for i in range(500)]
    doc = json.loads(one(review.review_documents(make_orders(rows), generated_at="2026-01-01T00:00:00"))["document"])
    assert doc["metadata"]["generated_at"] == "2026-01-01T00:00:00"
    assert doc["periods"]["30d"]["summary"]["revenue_change"] == 0.0
    by_id = {c["id"]: c for c in doc["health"]["checks"]}
    assert set(by_id["revenue_concentration_top10"]) == {"id", "category", "severity", "result", "message", "value", "threshold"}
    assert by_id["revenue_concentration_top10"]["value"] is None and by_id["repeat_purchase_rate"]["threshold"] == 0.25
    assert "partial" not in doc["periods"]["365d"]["monthly_trend"][-2]


def test_checks_without_products_or_revenue(make_orders):
    rows = [(f"o{i}", dt.datetime(2025, 1, 1) + dt.timedelta(days=i), f"c{i}", 0.0) for i in range(40)]
    got = {r["check_id"]: r["result"] for r in checks.health_checks(make_orders(rows)).collect()}
    assert got["revenue_concentration_top10"] == "na" and got["daily_revenue_volatility"] == "na"
    assert got["free_shipping_threshold_effectiveness"] == "na"
    assert "large_order_dependency" not in got and "converting_sku_rate" not in got
