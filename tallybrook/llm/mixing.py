"""Mixing sources to target weights: budgets down a tree, token prefixes at its leaves.

A tree of columns (domain, language, source) has weights at each level.  A token budget is
passed down: children share their parent's budget by weight, a child never gets more than
its subtree can supply, and what it cannot take goes to its siblings by their weights.
Only a parent whose children are all exhausted gives the rest to its own siblings, since
its supply is the sum of theirs.  A leaf may be read ``epochs`` times; the epoch that is
not complete takes the leading documents of an order drawn from the seed, as long as they
fit the leaf's tokens.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.store import written
from tallybrook.llm.words import words

LEVELS = ("domain", "lang", "source")
ROWS_PER_SLICE = 256  # rows of a leaf that one window task sorts, about
ORDER_BITS = 52


def _weight(values: Mapping[str, float], key: Column) -> Column:
    if not values:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(known[key].cast("double"), F.lit(1.0))


def share_out(nodes: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Adds ``_given``: each child's part of ``_budget`` under weights and supplies.

    ``nodes`` has one row per child with ``_budget`` (its parent's), ``_supply``, ``_weight``.
    Children with the smallest supply per weight are filled first; the others split the rest.
    """
    group = [F.col(k) for k in parent] or [F.lit(0)]
    by_need = Window.partitionBy(*group).orderBy(F.col("_supply") / F.col("_weight"), child)
    whole = Window.partitionBy(*group)
    filled = F.col("_weight") > 0
    staged = (
        nodes.withColumn("_weight", F.greatest("_weight", F.lit(0.0)))
        .withColumn("_supply", F.when(filled, F.col("_supply")).otherwise(0.0))
        .withColumn("_weight", F.when(filled, F.col("_weight")).otherwise(1e-300))
        .withColumn("_below", F.coalesce(F.sum("_supply").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_above", F.sum("_weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_supply") * F.col("_above") <= (F.col("_budget") - F.col("_below")) * F.col("_weight"))
        .withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("_supply")).otherwise(0.0)).over(whole))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(whole))
    )
    rest = (F.col("_budget") - F.col("_taken")) * F.col("_weight") / F.col("_open")
    return staged.withColumn("_given", F.when(F.col("_full"), F.col("_supply")).otherwise(rest)).drop(
        "_below", "_above", "_full", "_taken", "_open"
    )


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: float | None, share: float, epochs: int) -> DataFrame:
    """``_given`` tokens of each leaf; ``leaves`` has ``_k0 .. _kn``, ``_tokens``, ``_rows``."""
    keys = [c for c in leaves.columns if c.startswith("_k")]
    names = list(weights)
    leaves = leaves.withColumn("_supply", F.col("_tokens").cast("double") * epochs)
    total = F.lit(float(budget)) if budget is not None else F.col("_all") * F.lit(float(share))
    above = leaves.agg(F.coalesce(F.sum("_tokens"), F.lit(0)).cast("double").alias("_all")).select(total.alias("_budget"))
    for depth, key in enumerate(keys):
        path = keys[:depth]
        nodes = leaves.groupBy(*keys[: depth + 1]).agg(F.sum("_supply").alias("_supply"))
        if path:
            nodes = nodes.join(above, path)
        else:
            nodes = nodes.withColumn("_budget", above.scalar())
        given = share_out(nodes.withColumn("_weight", _weight(weights[names[depth]], F.col(key))), path, key)
        above = given.select(*keys[: depth + 1], F.col("_given").alias("_budget"))
    return leaves.join(above.withColumnRenamed("_budget", "_given"), keys).drop("_supply")


def mix(
    docs: DataFrame,
    weights: Mapping[str, Mapping[str, float]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: float | None = None,
    share: float = 0.5,
    epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Rows of ``docs`` that fill the budget, once per ``epoch`` (added column, from 0).

    ``weights`` names the tree's columns from the top, each with weights by value (missing:
    1; 0 or less: nothing from it).  ``budget`` counts words; without it ``share`` of all
    words.  Null level values are one value of their own; documents without words cost
    nothing and fit; rows with equal ids share a place in the order and are counted each.
    A document that would exceed what is left ends its leaf's prefix.  An input column
    ``epoch`` is replaced.
    """
    levels = list(weights)
    keys = [f"_k{i}" for i in range(len(levels))]
    keyed = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(levels, keys)],
        F.struct(*[c for c in docs.columns if c != "epoch"]).alias("_doc"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.size(words(F.col(text_col))).cast("long").alias("_n"),
    )
    slim = written(keyed.drop("_doc"), "mix-rows")
    leaves = slim.groupBy(*keys).agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows"))
    tokens = F.greatest(F.col("_tokens"), F.lit(1))
    plan = written(
        budgets(written(leaves, "mix-leaves"), weights, budget, share, epochs)
        .withColumn("_given", F.floor(F.col("_given") + F.lit(1e-6)).cast("long"))
        .withColumn("_full", F.floor(F.col("_given") / tokens).cast("long"))
        .withColumn("_rest", F.col("_given") - F.col("_full") * F.col("_tokens"))
        .withColumn("_slices", F.ceil(F.col("_rows") / F.lit(ROWS_PER_SLICE)).cast("long"))
        .drop("_given", "_rows", "_tokens"),
        "mix-plan",
    )

    def placed(rows: DataFrame, leaf_plan: DataFrame) -> DataFrame:
        """Each row's place in its leaf's unfinished epoch, and the slice that holds it."""
        draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id")))
        return (
            rows.join(leaf_plan, keys)
            .withColumn("_at", F.conv(F.substring(draw, 1, ORDER_BITS // 4), 16, 10).cast("long"))
            .withColumn("_slice", F.floor(F.col("_at") / F.lit(float(2**ORDER_BITS)) * F.col("_slices")).cast("long"))
        )

    in_leaf = Window.partitionBy(*keys).orderBy("_slice")
    sums = (
        placed(slim, plan).groupBy(*keys, "_slice", "_rest").agg(F.sum("_n").alias("_sum"))
        .withColumn("_upto", F.sum("_sum").over(in_leaf))
        .filter(F.col("_upto") > F.col("_rest"))
        .groupBy(*keys)
        .agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_edge"))
    )
    cut = written(
        plan.join(sums, keys, "left").select(*plan.columns, F.col("_edge._slice").alias("_last"), F.col("_edge._before").alias("_before")),
        "mix-cut",
    )
    rows = placed(keyed, cut)
    in_edge = Window.partitionBy(*keys).orderBy(F.struct("_at", "_id"))  # equal ids stand or fall together
    clear = rows.filter(F.col("_last").isNull() | (F.col("_slice") != F.col("_last"))).withColumn(
        "_copies", F.col("_full") + F.when(F.col("_last").isNull() | (F.col("_slice") < F.col("_last")), 1).otherwise(0)
    )
    edge = rows.filter(F.col("_slice") == F.col("_last")).withColumn(
        "_copies", F.col("_full") + F.when(F.col("_before") + F.sum("_n").over(in_edge) <= F.col("_rest"), 1).otherwise(0)
    )
    return (
        clear.unionByName(edge)
        .withColumn("_copies", F.least("_copies", F.lit(epochs)))  # of documents without words
        .filter(F.col("_copies") > 0)
        .select("_doc.*", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("epoch"))
    )
