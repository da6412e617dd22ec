"""Pair counts against brute force for small, large and mixed baskets."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tallybrook.ledger import Ledger
from tallybrook.operators import baskets

LINES = ", sku string, store_id string"


def brute(rows, min_support):
    orders, seen = {}, set()
    for order, _, _, _, sku, _ in rows:
        seen.add(order)
        orders.setdefault(order, set())
        if sku is not None:
            orders[order].add(sku)
    n, items, pairs = len(seen), Counter(), Counter()
    for basket in orders.values():
        items.update(basket)
        pairs.update(combinations(sorted(basket), 2))
    need = max(2, int(n * min_support))
    return {
        (a, b): (c, c / n, (c / n) / ((items[a] / n) * (items[b] / n))) for (a, b), c in pairs.items() if c >= need
    }


@pytest.mark.parametrize("large", [2, 4, 256])
@pytest.mark.parametrize("by", [[], ["store_id"]])
def test_pairs_match_brute_force(make_orders, large, by):
    rng = random.Random(large)
    rows = []
    for i in range(60):
        size = 14 if i % 10 == 0 else rng.randint(1, 4)
        for _ in range(size):
            sku = rng.choice([None] + [f"s{x}" for x in range(16)])
            rows.append((f"o{i}", "2025-01-01", "c", 1.0, sku, "x" if i < 45 else "y"))
    got = baskets.cross_sell_pairs(Ledger(make_orders(rows, LINES), by), min_support=0.03, large_basket=large).collect()
    stores = ["x", "y"] if by else [None]
    total = 0
    for store in stores:
        want = brute([r for r in rows if store in (None, r[5])], 0.03)
        mine = {(r["product_a"], r["product_b"]): r for r in got if not by or r["store_id"] == store}
        assert set(mine) == set(want)
        for key, (count, support, lift) in want.items():
            assert mine[key]["count"] == count
            assert mine[key]["support"] == pytest.approx(support)
            assert mine[key]["lift"] == pytest.approx(lift)
        total += len(want)
    assert len(got) == total > 0


def test_one_giant_basket_emits_nothing(make_orders):
    rows = [("big", "2025-01-01", "c", 1.0, f"s{i}", "x") for i in range(40)]
    assert baskets.cross_sell_pairs(Ledger(make_orders(rows, LINES)), large_basket=5).count() == 0
