"""How often the lines are read and what a task has to hold, read off the plans."""

import os

import pytest

from tallybrook.ledger import Ledger
from tallybrook.operators import products

FOLDER = "/root/testdata/sf0.001"
tables_present = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(df, name):
    return [line for line in plan(df).splitlines() if line.lstrip(" :+-").startswith(name)]


def test_multi_item_rate_keeps_no_set_of_products(spark, make_orders):
    rows = [("a", "2024-01-01", "x", 1.0, "p"), ("a", "2024-01-01", "x", 1.0, "p"), ("b", "2024-01-01", "x", 1.0, None), ("b", "2024-01-01", "x", 1.0, "q"),
            ("c", "2024-01-02", "y", 1.0, "p"), ("c", "2024-01-02", "y", 1.0, "q"), ("d", "2024-01-02", "y", 1.0, None), (None, "2024-01-02", "y", 1.0, "r")]
    rate = products.multi_item_rate(Ledger(make_orders(rows, ", sku string")))
    assert rate.collect()[0].asDict() == {"orders": 4, "multi_item_orders": 1, "multi_item_rate": 0.25}
    assert len(nodes(rate, "Aggregate")) == 2


@tables_present
def test_lines_are_joined_once_for_their_store(spark):
    from workload import tables

    joins = nodes(tables.order_lines(spark, FOLDER, store=True), "Join")
    assert len(joins) == 3 and "l_orderkey" in joins[0]


def test_kept_lines_are_read_once(spark, make_orders):
    rows = [("a", "2024-01-01", "x", 1.0, "p"), ("b", "2024-02-01", "x", 4.0, "p"), ("c", "2024-02-03", None, 5.0, "q")]
    seen = spark.sparkContext.accumulator(0)
    source = make_orders(rows, ", sku string")

    def counted(row):
        seen.add(1)
        return row

    from tallybrook.plans import checks, scorecards

    lines = spark.createDataFrame(source.rdd.map(counted), source.schema)
    assert checks.health_checks(lines).count() > 0
    assert seen.value == len(rows)
    assert scorecards.risk_rubric(lines).count() > 0
    assert seen.value == 2 * len(rows)


ODD = [
    ("a", "2024-01-01", "x", 10.0, "p"), ("a", "2024-01-01", "x", 5.0, "p"), ("b", "2024-01-09", "x", 7.0, "q"), ("b", "2024-01-09", "x", 1.0, None),
    ("c", "2024-02-03", "y", 2.0, "p"), ("c", "2024-02-04", "y", 4.0, "q"), ("d", "2024-03-01", None, 9.0, "p"), ("e", None, "y", 3.0, "r"),
    (None, "2024-03-05", "x", 6.0, "q"), ("f", "2024-04-02", "z", 8.0, None), ("f", "2024-05-02", "w", -8.0, "p"), ("g", None, "v", 1.5, None),
    ("h", "2024-06-01", "x", 2.5, "q"), ("h", "2024-06-01", "x", 2.5, "p"), ("i", "2024-06-02", "y", None, "s"),
]


def test_kept_rollups_change_no_result(spark, make_orders):
    """Lines without order, customer, product or date, and an order of one product in two lines."""
    from tallybrook.operators import baskets, customers, pricing, revenue

    rows = [(*r, s) for s in ("m", "n") for r in (ODD if s == "m" else ODD[3:9])]
    dated = [r for r in rows if r[1]]
    lines = make_orders(dated, ", sku string, store_id string").unionByName(
        spark.createDataFrame([r for r in rows if not r[1]], "order_id string, order_date timestamp, customer_id string, amount double, sku string, store_id string")
    )
    operators = [
        products.product_totals, products.lifecycle, products.stage_shares, products.price_tiers, products.top_product_share, products.converting_rate,
        products.multi_item_rate, baskets.cross_sell_pairs, pricing.order_totals, pricing.large_order_share, pricing.free_shipping_threshold,
        customers.orders_per_customer, customers.repeat_purchase_rate, customers.purchase_interval, customers.rfm_segments, customers.cohort_month,
        revenue.customer_revenue, revenue.top_customer_share, revenue.repeat_revenue_share, revenue.monthly_revenue, revenue.latest_months,
    ]
    for by in ([], ["store_id"]):
        plain, kept = Ledger(lines, by), Ledger(lines, by).keep()
        for operator in operators:
            found = [sorted(map(repr, operator(led).collect())) for led in (plain, kept)]
            assert found[0] == found[1] != [], operator.__name__


def test_kept_products_orders_and_customers_are_grouped_once(spark, make_orders):
    from tallybrook.operators import customers, pricing, revenue

    kept = Ledger(make_orders([r for r in ODD if r[1] and r[0] != "a"], ", sku string")).keep()
    for operator in (products.converting_rate, products.stage_shares, products.multi_item_rate, customers.repeat_purchase_rate, customers.purchase_interval):
        assert len(nodes(operator(kept), "Aggregate")) == 1 and not nodes(operator(kept), "Window"), operator.__name__
    for operator in (products.product_totals, pricing.order_totals, customers.orders_per_customer, revenue.customer_revenue):
        assert not nodes(operator(kept), "Aggregate"), operator.__name__


def test_margins_and_categories_need_one_scan(spark, make_orders):
    from tallybrook.operators import pricing

    rows = [("a", "2024-01-01", "x", 10.0, "p", "k", 4.0), ("b", "2024-01-01", "x", 5.0, "q", None, 1.0), ("c", "2024-01-01", "x", 2.0, "r", "m", 3.0)]
    lines = make_orders(rows, ", sku string, category string, cost double")
    margin = pricing.margin_summary(lines)
    assert margin.collect()[0].asDict() == {"overall_margin": 9 / 17, "categories": 2, "negative_categories": 1}
    assert len(nodes(margin, "LogicalRDD") or nodes(margin, "LocalRelation")) <= 1 and "scalar-subquery" not in plan(margin)
    shares = products.category_performance(lines)
    assert {r["category"]: r["revenue_share"] for r in shares.collect()} == {"k": 10 / 12, "m": 2 / 12}
    assert "scalar-subquery" not in plan(shares)


def test_rejected_lines_are_parsed_once(spark):
    from tallybrook.sources import readers

    header = "Invoice,InvoiceDate,Customer ID,Price,Quantity"
    text = [header, "1,1/2/2024 8:00,c,2.5,2", "2,soon,c,1,1", "3,1/2/2024", "4,,c,1,1"]
    found = readers.load_lines(spark.createDataFrame([(t,) for t in text], "value string"), header)
    assert sorted((r["line"], r["reason"]) for r in found.rejected.collect()) == [("2,soon,c,1,1", "order_date"), ("3,1/2/2024", "width")]
    assert sorted((r["order_id"], r["order_date"] is None) for r in found.rows.collect()) == [("1", False), ("4", True)]
    assert plan(found.rejected).count("from_csv") == 1 and plan(found.rows).count("from_csv") == 1


def test_numbers_are_told_without_expressions(spark):
    from tallybrook.sources import mapping

    texts = ["1", "-1.5", "1.5-", "$1,000", " 7\t", "--1", "1.2.3", "", "-", ".", "1a", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    row = mapping.column_profile(df).collect()[0]
    assert (row["filled"], round(row["numeric_rate"] * row["filled"])) == (11, 5)


@tables_present
def test_issues_and_annual_revenue_share_the_lines(spark, monkeypatch):
    from workload import queries, tables

    calls, real = [], tables.order_lines
    monkeypatch.setattr(tables, "order_lines", lambda *a, **k: calls.append(k) or real(*a, **k))
    assert queries.queries()["top_issues"](spark, FOLDER).count() > 0
    assert len(calls) == 1


def test_risks_write_no_rollup_that_they_do_not_read(make_orders, monkeypatch):
    from tallybrook import ledger
    from tallybrook.plans import scorecards

    written, real = [], ledger.stored
    monkeypatch.setattr(ledger, "stored", lambda df: written.append(df.columns) or real(df))
    assert scorecards.risk_rubric(make_orders([r for r in ODD if r[1]], ", sku string")).count() > 0
    assert len(written) == 4  # lines, order days, daily sums, products


def test_likely_partners_lose_no_match(spark):
    from tallybrook.functions.frames import likely

    others = spark.createDataFrame([(k,) for k in (None, -5, 0, 7, 7, 2**62, *range(1000, 1100))], "o long")
    rows = spark.createDataFrame([(k,) for k in (None, -5, 0, 7, 2**62, *range(1000, 9000), 1050)], "k long")
    wanted = sorted(r["k"] for r in rows.join(others.distinct(), rows["k"] == others["o"]).collect())
    for blocks in (1, 4, 1 << 19):  # many keys on one bit, and hardly any
        left = likely(rows, "k", others, "o", blocks)
        assert sorted(r["k"] for r in left.join(others.distinct(), left["k"] == others["o"]).collect()) == wanted
    assert left.count() < 200
    assert likely(rows.selectExpr("try_cast(k AS int) AS k"), "k", others, "o").filter("k = 1050").count() == 2
    assert likely(rows, "k", others.limit(0), "o").count() == 0


@tables_present
def test_lines_of_a_few_days_are_cut_before_their_join(spark):
    from pyspark.sql import functions as F

    from workload import queries, tables

    low, high = queries._early(90)
    lines = tables.order_lines(spark, FOLDER, between=(low, high))
    joins = nodes(lines, "Join")
    assert len(joins) == 2 and "Inner" in joins[0] and "LeftSemi" in joins[1] and "broadcast" in joins[1]
    plain = tables.order_lines(spark, FOLDER).filter((F.col("order_date") >= low) & (F.col("order_date") < high))
    assert sorted(map(repr, lines.collect())) == sorted(map(repr, plain.collect())) != []


@tables_present
def test_lines_meet_their_orders_last(spark):
    """Lines that leave the join lie together by order; the part is found while they are narrow."""
    from workload import tables

    joins = nodes(tables.order_lines(spark, FOLDER, store=True, product=True), "Join")
    assert len(joins) == 4 and "l_orderkey" in joins[0] and "l_partkey" in joins[1]


def test_kept_rollups_are_shuffled_once(spark, make_orders, monkeypatch):
    """Months of a product, and days and orders of a customer, meet by one shuffle of the written rows."""
    from tallybrook import ledger
    from tallybrook.functions import frames

    shuffles, real = {}, ledger.stored

    def seen(df):
        shuffles[df.columns[1]] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        return real(df)

    monkeypatch.setattr(ledger, "stored", seen)
    monkeypatch.setattr(ledger, "by_key", lambda *a: frames.by_key(*a, busy=1), raising=False)  # none of so few rows is busy
    rows = [(*r, s) for s in ("m", "n") for r in ODD if r[1]]
    Ledger(make_orders(rows, ", sku string, store_id string"), ["store_id"]).keep()
    assert shuffles["product"] == 1
    assert shuffles["customer_id"] == 2  # days, and pairs of customer and order


def test_busy_keys_change_no_result(spark, make_orders, monkeypatch):
    """One customer and one product with most lines, or every one of them busy, or none."""
    from tallybrook import ledger
    from tallybrook.functions import frames

    rows = [(*r, s) for s in ("m", None) for r in ODD if r[1]] + [(f"o{i % 7}", f"2024-0{1 + i % 9}-11", "x", float(i), "p", "m") for i in range(60)]
    lines = make_orders(rows, ", sku string, store_id string")
    plain = Ledger(lines, ["store_id"])
    wanted = {n: sorted(map(repr, getattr(plain, n).collect())) for n in ("goods", "clients")}
    branches = []
    for busy in (1, 3, 1000):

        def told(rows, keys, step):
            return frames.by_key(rows, keys, lambda part: branches.append((busy, keys[-1])) or step(part), busy)

        monkeypatch.setattr(ledger, "by_key", told)
        kept = Ledger(lines, ["store_id"]).keep()
        assert {n: sorted(map(repr, getattr(kept, n).collect())) for n in wanted} == wanted
    assert branches.count((3, "product")) == branches.count((3, "customer_id")) == 2
    assert branches.count((1, "product")) == 1


@tables_present
def test_rollups_are_not_shuffled_by_store(spark):
    """What is known of each store is so little that it goes to the rollup, not the rollup to it."""
    from tallybrook.operators import baskets, pricing
    from workload import tables

    kept = Ledger(tables.order_lines(spark, FOLDER, store=True), ["store_id"]).keep()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "6000")  # less than a rollup's file
    try:
        for operator in (pricing.free_shipping_threshold, products.top_product_share, products.price_tiers):
            shown = operator(kept)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown, operator.__name__
        assert baskets.cross_sell_pairs(kept).count() >= 0
    finally:
        spark.conf.set(limit, before)


def test_shuffle_files_go_with_their_query(spark):
    import time

    from tallybrook.functions import frames

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.splitlines() if "shuffle_" in f}

    before, former = files(), spark.conf.get(frames.FREED, "false")
    written = frames.stored(spark.range(1000).repartition(4, "id").groupBy("id").count())
    left = files() - before
    for _ in range(50):
        if not left:
            break
        time.sleep(0.1)
        left = files() - before
    assert not left and written.count() == 1000
    with frames.shuffles_freed(spark), frames.shuffles_freed(spark):
        assert spark.conf.get(frames.FREED) == "true"
    assert spark.conf.get(frames.FREED, "false") == former


def test_orders_of_a_month_are_counted_without_a_shuffle_by_order(make_orders):
    """Only orders with lines in several months are looked up by day."""
    from tallybrook.operators import revenue

    rows = [r for r in ODD if r[1]]
    each = {"one": [r for r in rows if r[0] != "f"], "some": [*rows, ("f", "2024-05-09", "x", 1.0, "p"), (None, "2023-05-09", "x", 1.0, "p")]}
    for which, given in each.items():
        plain, kept = (Ledger(make_orders(given, ", sku string")) for _ in range(2))
        found, wanted = revenue.monthly_revenue(kept.keep()), revenue.monthly_revenue(plain)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())) != []
        assert any("order_id" in line for line in nodes(found, "Aggregate")) == (which == "some")
        assert [r["orders"] for r in found.collect() if r["month"] == "2023-05"] == [0] * (which == "some")
