"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybrook.session import local_session  # noqa: E402
from workload.queries import queries  # noqa: E402

HEADLINE = [
    "period_block",
    "period_block_by_store_ref1996",
    "monthly_trend",
    "mom_growth",
    "repeat_revenue_share",
    "top_decile_share",
    "daily_cv",
    "purchase_interval",
    "rfm_scores",
    "abc_revenue",
    "product_lifecycle",
    "price_tiers",
    "cross_sell_pairs",
    "discount_dependency",
    "margin_by_category",
    "free_shipping_threshold",
    "purchase_funnel",
    "retail_normalise",
    "health_checks",
    "health_checks_by_store",
    "review_document",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registered = queries()
    registered["metadata"](spark, folder).collect()  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
