import datetime as dt

import pytest

from tallybrook.ledger import Ledger
from tallybrook.operators import customers, kpis, periods, pricing, products, revenue
from tests.conftest import one


def days(start, n):
    first = dt.datetime.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def test_window_dates():
    ref = dt.date(2026, 3, 15)
    assert periods.trailing_window(ref, 30) == ("Past 30 Days", dt.date(2026, 2, 14), ref)
    assert periods.trailing_window(ref, 90)[1] == dt.date(2025, 12, 16)
    assert periods.prior_trailing_window(ref, 30)[1:] == (dt.date(2026, 1, 15), dt.date(2026, 2, 13))
    assert periods.prior_trailing_window(ref, 90)[1:] == (dt.date(2025, 9, 17), dt.date(2025, 12, 15))


def test_window_frame_equals_the_dates(make_orders):
    rows = periods.period_windows(make_orders([("o", "2026-03-15", "c", 1.0)])).collect()
    got = {(r["period"], r["side"]): (r["label"], r["period_start"], r["period_end"]) for r in rows}
    for p, n in periods.PERIOD_DAYS.items():
        assert got[p, "current"] == periods.trailing_window(dt.date(2026, 3, 15), n)
        assert got[p, "prior"] == periods.prior_trailing_window(dt.date(2026, 3, 15), n)


@pytest.mark.parametrize("span,covered", [(61, "100"), (151, "110"), (517, "111"), (29, "000")])
def test_coverage(make_orders, span, covered):
    end = dt.datetime(2025, 1, 1) + dt.timedelta(days=span)
    r = one(periods.data_coverage(make_orders([("a", "2025-01-01", "c", 1.0), ("b", end, "c", 1.0)])))
    assert r["span_days"] == span
    assert "".join(str(int(r[f"covered_{p}"])) for p in ("30d", "90d", "365d")) == covered


def test_period_block_counts_new_guests_and_changes(make_orders):
    rows = [
        ("o1", "2025-01-20", "old", 100.0),
        ("o2", "2025-03-01", "old", 60.0),
        ("o2", "2025-03-01", "old", 40.0),
        ("o3", "2025-03-02", "new", 50.0),
        ("o4", "2025-03-03", None, 30.0),
    ]
    got = {(r["period"], r["side"]): r for r in kpis.period_summary(make_orders(rows)).collect()}
    cur, prior = got["30d", "current"], got["30d", "prior"]
    assert (cur["revenue"], cur["orders"], cur["customers"]) == (180.0, 3, 2)
    assert (cur["new_customers"], cur["new_customer_revenue"]) == (1, 50.0)
    # The guest belongs to the returning side but is no customer.
    assert (cur["returning_customers"], cur["returning_customer_revenue"], cur["returning_customer_aov"]) == (1, 130.0, 65.0)
    assert (prior["revenue"], prior["new_customers"]) == (100.0, 1)
    assert got["365d", "prior"]["revenue"] == 0.0 and got["365d", "prior"]["orders"] == 0
    block = {r["period"]: r for r in kpis.period_blocks(make_orders(rows)).collect()}
    assert block["30d"]["revenue_change"] == pytest.approx(0.8)
    assert block["365d"]["revenue_change"] is None and block["365d"]["aov_effect"] == 0.0


def test_drivers_volume_only(make_orders):
    rows = [(f"a{i}", "2025-01-15", "c", 100.0) for i in range(10)]
    rows += [(f"b{i}", "2025-02-15", "c", 100.0) for i in range(12)]
    got = {r["period"]: r for r in kpis.drivers(Ledger(make_orders(rows), ref_date=dt.date(2025, 2, 28))).collect()}
    assert (got["30d"]["volume_effect"], got["30d"]["aov_effect"], got["30d"]["mix_effect"]) == (200.0, 0.0, 0.0)


def test_split_sums_hold_per_store(make_orders):
    rows = [(f"o{i}", d, f"c{i % 7}", 10.0 + i, "s", f"st{i % 3}") for i, d in enumerate(days("2025-01-01", 100))]
    for r in kpis.period_summary(make_orders(rows, ", sku string, store_id string"), ["store_id"]).collect():
        assert r["new_customers"] + r["returning_customers"] == r["customers"]
        assert r["new_customer_revenue"] + r["returning_customer_revenue"] == pytest.approx(r["revenue"])


def test_partial_last_month(make_orders):
    rows = [(f"n{i}", d, "a", 1000.0) for i, d in enumerate(days("2025-11-01", 30))]
    rows += [(f"d{i}", d, "a", 1100.0) for i, d in enumerate(days("2025-12-01", 31))]
    rows += [(f"j{i}", d, "b", 100.0) for i, d in enumerate(days("2026-01-01", 3))]
    df = make_orders(rows)
    r = one(revenue.latest_months(df))
    assert (r["partial_last_month"], r["last_month_days"], r["last_month"]) == (True, 3, "2026-01")
    assert r["mom_growth_latest"] == pytest.approx(31 * 1100 / (30 * 1000) - 1)
    trend = {t["month"]: t for t in kpis.monthly_trend(df).collect()}
    assert trend["2026-01"]["partial"] and not trend["2025-12"]["partial"]
    assert trend["2026-01"]["new_customers"] == 1


def test_single_month_has_no_growth(make_orders):
    r = one(revenue.latest_months(make_orders([(f"o{i}", d, "c", 1.0) for i, d in enumerate(days("2025-01-01", 20))])))
    assert r["mom_growth_latest"] is None and r["aov_change"] is None


def test_repeat_share_counts_guests_and_later_days(make_orders):
    rows = [("1", "2025-01-01 08:00:00", "a", 10.0), ("2", "2025-01-01 20:00:00", "a", 10.0)]
    rows += [("3", "2025-01-05", "a", 20.0), ("4", "2025-01-06", None, 60.0)]
    assert one(revenue.repeat_revenue_share(make_orders(rows)))["repeat_revenue_share"] == pytest.approx(0.8)


def test_interval_floors_partial_days(make_orders):
    rows = [
        ("1", "2025-01-01 23:00:00", "a", 1.0),
        ("1", "2025-01-01 23:00:00", "a", 1.0),
        ("2", "2025-01-03 01:00:00", "a", 1.0),
        ("3", "2025-01-05 02:00:00", "a", 1.0),
        ("4", "2025-01-05 03:00:00", "b", 1.0),
    ]
    r = one(customers.purchase_interval(make_orders(rows)))
    # gaps 0, 1 (26 h), 2 (49 h) over three steps; customer b has no gap
    assert r["customers_with_gaps"] == 1 and r["avg_purchase_interval_days"] == pytest.approx(1.0)


def test_rfm_matches_quantile_bins(make_orders):
    import random

    import pandas as pd

    rng = random.Random(3)
    rows = [(f"o{i:03d}", days("2025-01-01", 90)[rng.randint(0, 89)], f"c{rng.randint(0, 36):02d}", float(rng.randint(1, 500))) for i in range(160)]
    got = {r["customer_id"]: r for r in customers.rfm_segments(make_orders(rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["o", "d", "c", "a"])
    base = pdf.groupby("c").agg(last=("d", "max"), f=("o", "nunique"), m=("a", "sum"))
    recency = (pdf["d"].max() - base["last"]).dt.days
    r_score = 5 - pd.qcut(recency, 5, labels=False, duplicates="drop")
    f_score = pd.qcut(base["f"].rank(method="first"), 5, labels=False) + 1
    m_score = pd.qcut(base["m"].rank(method="first"), 5, labels=False) + 1
    for c in base.index:
        assert (got[c]["r_score"], got[c]["f_score"], got[c]["m_score"]) == (r_score[c], f_score[c], m_score[c])


def test_equal_recency_has_no_score(make_orders):
    rows = [(f"o{i}", "2025-01-01", f"c{i}", 10.0) for i in range(6)]
    for r in customers.rfm_segments(make_orders(rows)).collect():
        assert r["r_score"] is None and r["segment"] == "Potential"


@pytest.mark.parametrize("prices,tiers", [([5.0], 1), ([5.0, 5.0, 5.0], 0), ([1.0, 2.0], 2), ([1.0, 2.0, 9.0], 3), ([1, 2, 3, 4, 5], 4)])
def test_price_tiers(make_orders, prices, tiers):
    rows = [(f"o{i}", "2025-01-01", "c", float(p), f"s{i}") for i, p in enumerate(prices)]
    assert one(products.price_tiers(make_orders(rows, ", sku string")))["price_tiers"] == tiers


def test_lifecycle_stages(make_orders):
    amounts = {"up": [10, 20, 30], "down": [30, 20, 10], "flat": [20, 20, 20], "one": [5], "back": [-10, -20, -30]}
    rows = [(f"{s}{i}", f"2025-0{i + 1}-10", "c", float(v), s) for s, vs in amounts.items() for i, v in enumerate(vs)]
    got = {r["product"]: r["lifecycle_stage"] for r in products.lifecycle(make_orders(rows, ", sku string")).collect()}
    # A negative mean turns the relative slope around.
    assert got == {"up": "Growth", "down": "Decline", "flat": "Mature", "one": "Launch", "back": "Growth"}


def test_threshold_rounds_half_even(make_orders):
    rows = [(f"o{i}", "2025-01-01", "c", v) for i, v in enumerate([100.0, 208.5, 208.5, 240.0])]
    r = one(pricing.free_shipping_threshold(make_orders(rows)))
    assert (r["median_order"], r["suggested_threshold"]) == (208.5, 300.0)
    assert r["orders_below_threshold_pct"] == 1.0
    assert r["potential_aov_lift"] == pytest.approx((300 - 240) / ((100 + 208.5 * 2 + 240) / 4))


def test_discount_trend_and_missing_discount(make_orders):
    rows = [(f"o{m}", f"2025-0{m}-01", "c", 100.0 - 5 * m, 5.0 * m) for m in range(1, 5)]
    r = one(pricing.discount_dependency(make_orders(rows, ", discount double")))
    assert r["discount_rate_trend"] == "increasing" and r["discounted_line_ratio"] == 1.0
    bare = one(pricing.discount_dependency(make_orders([x[:4] for x in rows])))
    assert (bare["discount_rate_trend"], bare["avg_discount_rate"], bare["discounted_line_ratio"]) == ("stable", 0.0, 0.0)


def test_a_ledger_keeps_its_grouping(make_orders):
    from tallybrook import Ledger

    led = Ledger(make_orders([("1", "2025-01-01", "a", 1.0)]))
    assert Ledger.of(led) is led
    with pytest.raises(ValueError):
        Ledger.of(led, ["store_id"])
    with pytest.raises(ValueError):
        Ledger.of(led, ref_date=dt.date(2024, 1, 1))


def test_an_order_with_and_without_its_customer(make_orders):
    """Later lines of an order may lack the customer; the order counts once."""
    rows = [("1", "2025-01-01", "a", 5.0), ("1", "2025-01-01", None, 3.0), ("2", "2025-01-02", None, 2.0), (None, "2025-01-02", "b", 1.0)]
    month = {(r.period, r.side): r for r in kpis.period_summary(make_orders(rows)).collect()}["30d", "current"]
    assert (month.orders, month.customers, month.new_customers, month.revenue) == (2, 2, 2, 11.0)
    assert (month.new_customer_revenue, month.returning_customer_revenue, month.new_customer_aov, month.returning_customer_aov) == (6.0, 5.0, 6.0, 2.5)


def test_launches_and_sales_before_them(spark, make_orders):
    from tallybrook.operators import products

    lines = make_orders([("1", "2024-01-01", "a", 1.0, "p"), ("2", "2025-06-01", "a", 1.0, "p"), ("3", "2024-02-05", "a", 1.0, "q")], ", sku string")
    launches = spark.createDataFrame([("p", dt.date(2024, 2, 1)), ("q", dt.date(2024, 2, 1)), ("r", dt.date(2024, 2, 1))], "product_id string, launch_date date")
    assert {r.product_id for r in products.unsold_launches(lines, launches).collect()} == {"p", "r"}
    with pytest.raises(ValueError):
        products.dormant_products(lines.withColumn("store_id", lines.sku), launches, ["store_id"])
