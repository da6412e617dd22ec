"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of the edges ``a``, ``b``; equal roots, one component.

    In each round every node points to the smallest of its neighbours and itself, pointers
    are followed for a few steps, and edges are redrawn between what they reach.  Edges
    inside a contracted part vanish, so the table shrinks until none is left.  A hub is a
    single row after aggregation; its many edges are spread by the join's skew handling.
    """
    edges = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        for _ in range(2):
            step = written(step, "pointers")
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            step = step.join(ahead, "root").select("node", F.col("_next").alias("root"))
        step = written(step, "pointers")
        if roots is None:
            roots = step
        else:
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            roots = written(roots.join(ahead, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots")
        from_a = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a")
        from_b = from_a.join(step.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
        drawn = from_b.filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = written(drawn, "edges")
        if edges.isEmpty():
            return roots
