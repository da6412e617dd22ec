"""Sliced ranks, sums and quantiles against brute force, with hot groups and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.functions import ordering


@pytest.fixture(params=["1", "13"])
def slices(request, spark):
    """Few rows in one slice, and in many."""
    names = {"spark.sql.shuffle.partitions": request.param, "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def rows():
    rng = random.Random(5)
    # Store a holds most rows, and one value repeats very often.
    return [("a" if rng.random() < 0.8 else rng.choice(["b", None]), i, rng.choice([1, 1, 1, 2, 3, rng.randint(-9, 99)])) for i in range(90)]


def grouped(rows):
    out = {}
    for store, i, v in rows:
        out.setdefault(store, []).append((v, i))
    return out


def test_ranks_and_running_sums(spark, rows, slices):
    df = spark.createDataFrame(rows, "store string, id long, v long")
    got = ordering.ordered_prefix(df, ["store"], ["v", "id"], {"v": "v"}).collect()
    ranks = {r["id"]: (r["rank"], r["group_rows"]) for r in ordering.ranked(df, ["store"], ["v", "id"]).collect()}
    assert len(got) == len(rows) == len(ranks)
    running = {r["id"]: (r["running_v"], r["whole_v"]) for r in got}
    for members in grouped(rows).values():
        total = 0
        for place, (v, i) in enumerate(sorted(members), start=1):
            total += v
            assert ranks[i] == (place, len(members))
            assert running[i] == (total, sum(x for x, _ in members))


def test_quantiles_match_numpy(spark, rows, slices):
    df = spark.createDataFrame(rows, "store string, id long, v long")
    probs = {"lo": 0.2, "mid": 0.5, "hi": 0.9}
    for r in ordering.quantiles(df, ["store"], "v", probs).collect():
        values = [v for v, _ in grouped(rows)[r["store"]]]
        assert r["n"] == len(values)
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p))


def test_quantiles_without_groups(spark, rows, slices):
    df = spark.createDataFrame(rows, "store string, id long, v long")
    r = ordering.quantiles(df, [], "v", {"mid": 0.5}).collect()[0]
    assert r["mid"] == pytest.approx(np.median([x[2] for x in rows]))


@pytest.mark.parametrize("shares", [(0.3, 0.3), (0.0, 0.1), (0.9, 1.0)])
def test_top_sum_splits_ties(spark, rows, slices, shares):
    """Small groups are ordered as a whole, wherever the sketch was asked to look."""
    df = spark.createDataFrame([*rows, ("a", -1, None)], "store string, id long, v long")
    k = F.greatest(F.lit(1), F.floor(F.col("group_rows") * 0.3))
    for r in ordering.top_sum(df, ["store"], "v", k, shares).collect():
        values = sorted((v for v, _ in grouped(rows)[r["store"]]), reverse=True)
        n = max(1, int(len(values) * 0.3))
        assert (r["top_k"], r["top_total"], r["group_total"]) == (n, sum(values[:n]), sum(values))


@pytest.mark.parametrize("probs", [{"a": 0.05, "b": 0.5, "c": 0.97, "d": 1.0}, {"a": 0.0, "b": 0.499, "c": 0.5, "d": 0.501}])
def test_quantiles_by_the_sketch(spark, rows, probs, monkeypatch):
    """Groups above the small size, with places so close that their values overlap."""
    monkeypatch.setattr(ordering, "SMALL", 40)
    monkeypatch.setattr(ordering, "MARGIN", 0.06)
    rows = [(s, i, v + i % 7) for s, i, v in rows * 4]
    df = spark.createDataFrame(rows, "store string, id long, v long")
    values = {s: [v for v, _ in members] for s, members in grouped(rows).items()}
    for r in ordering.quantiles(df, ["store"], "v", probs).collect():
        assert [r[k] for k in probs] == pytest.approx(list(np.quantile(values[r["store"]], list(probs.values()))))


def test_a_missed_rank_raises(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL", 1)
    df = spark.range(1000).select(F.col("id").alias("v"))
    with pytest.raises(Exception, match="outside the sketch"):
        ordering.top_sum(df, [], "v", F.floor(F.col("group_rows") * 0.5), (0.1, 0.1)).collect()


def test_nothing_to_select(spark):
    none = spark.createDataFrame([], "store string, v decimal(18,4)")
    assert ordering.quantiles(none, [], "v", {"m": 0.5}).collect()[0].asDict() == {"n": None, "m": None}
    assert ordering.top_sum(none, [], "v", F.lit(1), (0.0, 1.0)).collect()[0]["top_total"] is None
    assert ordering.quantiles(none, ["store"], "v", {"m": 0.5}).count() == 0


def test_places_between_many_values(spark):
    df = spark.range(200_000).select(F.expr("cast((id * 7919) % 200000 as decimal(18,4)) / 4").cast("decimal(18,4)").alias("v"))
    r = ordering.quantiles(df, [], "v", {"a": 0.25, "b": 1 / 3, "c": 0.5}).collect()[0]
    exact = np.arange(200_000) / 4
    assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(exact, [0.25, 1 / 3, 0.5])))
    t = ordering.top_share_sum(df, [], "v", 0.1).collect()[0]
    assert (t["top_k"], float(t["top_total"])) == (20_000, exact[-20_000:].sum())
    for n in (1, 5, 1500, 250_000):
        t = ordering.top_n_sum(df, [], "v", n).collect()[0]
        assert (t["top_k"], float(t["top_total"])) == (min(n, 200_000), exact[-n:].sum())
