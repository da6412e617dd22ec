"""Ordered prefix sums, ranks and exact quantiles that never need one big task.

A window over a whole table, or over a group that may hold a third of it, sorts
that group in a single task.  For ranks of all rows they are range partitioned along
the full sort key and written; each partition is a slice that its own task scans, and
the few slice totals are added up in front.

Quantiles and sums of the largest values need a few places of the order only.  They
are selected: a sketch names two values around each place, and only the values between
them are ordered, above exact counts and sums of all that lies below.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.functions.frames import By, attach, durable, group_window

MARGIN = 0.001  # share of the rows on either side of a place that is looked at closely
ACCURACY = 10_000  # of the sketch: its error is a share of 1 / ACCURACY of the rows
SMALL = 10_000  # rows of a group that may be ordered as a whole


def ordered_prefix(df: DataFrame, by: By, order: list[str], sums: Mapping[str, str], bounded: bool = False) -> DataFrame:
    """Add running and whole-group sums along ``order`` within each ``by`` group.

    ``sums`` maps an output name to the summed column; ``running_<name>`` includes
    the current row, ``whole_<name>`` covers the group.  ``order`` sorts ascending
    and must make rows unique within a group.  ``bounded`` says that a group is small
    by nature (days, months), so that a window per group does.

    Slices come from ``spark.sql.shuffle.partitions``; writing them fixes each row's
    slice, whichever task is computed again.
    """
    if bounded:
        group = group_window(by)
        along = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(
            "*",
            *[F.sum(src).over(along).alias(f"running_{n}") for n, src in sums.items()],
            *[F.sum(src).over(group).alias(f"whole_{n}") for n, src in sums.items()],
        )
    keys = [F.col(c) for c in [*by, *order]]
    sliced = durable(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()))

    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.select("*", *[F.sum(src).over(inside).alias(f"_in_{n}") for n, src in sums.items()])

    before = group_window(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = sliced.groupBy(*by, "_slice").agg(*[F.sum(src).alias(f"_p_{n}") for n, src in sums.items()])
    offsets = parts.select(
        *by,
        "_slice",
        *[F.sum(f"_p_{n}").over(before).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_p_{n}").over(group_window(by)).alias(f"whole_{n}") for n in sums],
    )
    joined = attach(rows, offsets, [*by, "_slice"])
    return joined.select(
        *df.columns,
        *[F.when(F.col(f"_b_{n}").isNull(), F.col(f"_in_{n}")).otherwise(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(f"running_{n}") for n in sums],
        *[f"whole_{n}" for n in sums],
    )


def ranked(df: DataFrame, by: By, order: list[str]) -> DataFrame:
    """Add ``rank`` (1..n along ``order``) and ``group_rows`` per ``by`` group."""
    out = ordered_prefix(df.withColumn("_one", F.lit(1).cast("long")), by, order, {"one": "_one"})
    return out.withColumnsRenamed({"running_one": "rank", "whole_one": "group_rows"}).drop("_one")


def value_counts(df: DataFrame, by: By, value: str) -> DataFrame:
    """Distinct values with their frequency: what ranks and quantiles need, no more."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("copies"))


def quantiles_of_counts(counts: DataFrame, by: By, value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles from a (value, copies) frame with few values.

    One row per ``by`` group: ``n`` and one double per entry of ``probs``.
    """
    prefix = ordered_prefix(counts, by, [value], {"copies": "copies"}, bounded=True)
    above = F.col("running_copies") - F.col("copies")

    def at(position: Column) -> Column:
        hit = (above <= position) & (position < F.col("running_copies"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("whole_copies") - 1)
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    edges = prefix.groupBy(*by).agg(F.max("whole_copies").alias("n"), *aggs)

    def between(name: str, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (place - F.floor(place))).alias(name)

    return edges.select(*by, "n", *[between(n, p) for n, p in probs.items()])


def _selected(
    df: DataFrame,
    by: By,
    value: str,
    places: Mapping[str, tuple[float, float]],
    ranks: Callable[[str], tuple[Column, Column]],
    few: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Per group ``group_rows``, ``total`` and for each place a struct of the values at two ranks.

    ``places`` say between which shares of the rows a place lies; ``ranks`` gives the first and last rank
    wanted there, from 0, ascending, as expressions of ``group_rows``.  A struct holds ``first``
    and ``last``, the values at these ranks, and ``below_n`` and ``below``, how many values are
    smaller than ``first`` and their sum.

    Values between the two of a place stay apart with their copies, all others are counted and
    summed by the gap they lie in.  Small groups stay apart as a whole.  The sketch's error is
    bounded; a rank that it misses all the same raises.  ``few`` may write the sketches, one row per
    group, where reading ``df`` twice costs less than a shuffle by group (``Ledger.few``).
    """
    df = df.filter(F.col(value).isNotNull()).select(*by, value)
    v = F.col(value)
    near = [(max(0.0, low - MARGIN), min(1.0, high + MARGIN)) for low, high in sorted(set(places.values()))]
    sketch = df.groupBy(*by).agg(
        (F.count(F.lit(1)) <= SMALL).alias("_small"), F.percentile_approx(v, [p for pair in near for p in pair], ACCURACY).alias("_at")
    )
    part = F.when(F.col("_small"), 1)
    for i in range(len(near)):
        part = part.when(v < F.col("_at")[2 * i], 2 * i).when(v <= F.col("_at")[2 * i + 1], 2 * i + 1)
    parted = attach(df, few(sketch), by).select(*by, v, part.otherwise(2 * len(near)).alias("_part"))
    apart = F.when(F.col("_part") % 2 == 1, v).alias("_v")
    counts = parted.groupBy(*by, "_part", apart).agg(F.count(F.lit(1)).alias("_copies"), F.sum(v).alias("_mass"))

    group = group_window(by)
    before = group.orderBy("_part", "_v").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.select(
        *by, "_v", "_copies",
        F.sum("_copies").over(group).alias("group_rows"),
        F.sum("_mass").over(group).alias("total"),
        F.coalesce(F.sum("_copies").over(before), F.lit(0)).alias("_under"),
        F.coalesce(F.sum("_mass").over(before), F.lit(0)).alias("_below"),
    )
    missed = F.raise_error(F.lit("a rank lies outside the sketch's bounds"))

    def here(rank: Column) -> Column:
        return rank.between(F.col("_under"), F.col("_under") + F.col("_copies") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when(here(rank), F.coalesce("_v", missed.cast(df.schema[value].dataType))))

    return known.groupBy(*by).agg(
        F.max("group_rows").alias("group_rows"),
        F.max("total").alias("total"),
        *[
            F.struct(
                at(first).alias("first"),
                at(last).alias("last"),
                F.max(F.when(here(first), F.col("_under"))).alias("below_n"),
                F.max(F.when(here(first), F.col("_below"))).alias("below"),
            ).alias(name)
            for name in places
            for first, last in [ranks(name)]
        ],
    )


def _as_is(df: DataFrame) -> DataFrame:
    return df


def quantiles(
    df: DataFrame, by: By, value: str, probs: Mapping[str, float], bounded: bool = False, few: Callable[[DataFrame], DataFrame] = _as_is
) -> DataFrame:
    """Exact linearly interpolated quantiles of a column: by, ``n``, a double per entry of ``probs``.

    ``bounded`` says that the column has few different values (days, counts).
    """
    if bounded:
        return quantiles_of_counts(value_counts(df, by, value), by, value, probs)
    place = lambda name: F.lit(float(probs[name])) * (F.col("group_rows") - 1)
    found = _selected(df, by, value, {name: (p, p) for name, p in probs.items()}, lambda name: (F.floor(place(name)), F.ceil(place(name))), few)

    def between(name: str) -> Column:
        low, high = F.col(f"{name}.first").cast("double"), F.col(f"{name}.last").cast("double")
        return (low + (high - low) * (place(name) - F.floor(place(name)))).alias(name)

    return found.select(*by, F.col("group_rows").alias("n"), *[between(name) for name in probs])


def top_sum(
    df: DataFrame, by: By, value: str, k: Column, shares: tuple[float, float], few: Callable[[DataFrame], DataFrame] = _as_is
) -> DataFrame:
    """Sum of the ``k`` largest values per group; ``k`` may use ``group_rows``.

    ``shares`` are the least and greatest share of its rows that ``k`` can be in a group of
    more than ``SMALL``; outside of them an error is raised.
    Output: by, group_rows, group_total, top_k, top_total.
    """
    size = F.col("group_rows")
    taken = F.least(k.cast("long"), size)
    lowest = size - F.greatest(taken, F.lit(1))
    place = (1.0 - shares[1], 1.0 - shares[0])
    found = _selected(df, by, value, {"cut": place}, lambda _: (lowest, lowest), few)
    # Of values equal to the lowest one taken, some may be among the others.
    others = F.col("cut.below") + (size - taken - F.col("cut.below_n")) * F.col("cut.first")
    return found.select(*by, "group_rows", F.col("total").alias("group_total"), taken.alias("top_k"), (F.col("total") - others).alias("top_total"))


def top_n_sum(df: DataFrame, by: By, value: str, n: int) -> DataFrame:
    """``top_sum`` of ``n`` values, or of all in a smaller group."""
    return top_sum(df, by, value, F.least(F.lit(n), F.col("group_rows")), (0.0, min(1.0, n / SMALL)))


def top_share_sum(
    df: DataFrame, by: By, value: str, fraction: float, few: Callable[[DataFrame], DataFrame] = _as_is
) -> DataFrame:
    """``top_sum`` of a fraction of the values, at least one."""
    k = F.greatest(F.lit(1), F.floor(F.col("group_rows").cast("double") * F.lit(fraction)))
    return top_sum(df, by, value, k, (fraction, fraction), few)
