"""A spread of registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "period_block", "period_summary_guests", "monthly_trend_by_store", "top_decile_share_guests_by_store",
    "purchase_interval_short", "rfm_scores", "abc_revenue", "product_lifecycle_returns", "price_tiers_by_store",
    "cross_sell_pairs", "discount_dependency", "free_shipping_threshold", "retail_normalise", "fuzzy_normalise",
    "drivers_mix_guests_by_store", "days_to_second_order_short", "review_document_short", "load_orders_rejected",
    "column_profile_at_limits", "edges_price_tiers", "edges_rfm_scores", "named_top20_share",
]


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, row)) for row in cursor.fetchall()]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == columns

    def ordered(rows):
        clean = [tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in columns) for r in rows]
        return sorted(clean, key=lambda t: [(x is None, str(x)) for x in t])

    assert ordered([r.asDict() for r in df.collect()]) == ordered(want)
