"""A Merkle manifest of a dataset: a leaf per document, a tree per group, a tree over groups.

Leaves are numbered along the order of their group without one task sorting a group
(``functions.ordering``).  A group is cut into aligned blocks of ``ARITY ** height`` leaves.
A task appends the leaves of a block one after the other: every open subtree holds the
partial witnesses of its leaves, and whenever siblings complete a node, the witnesses below
it are extended by what stood beside them.  Block roots are appended in the same way, as
leaves of the next round, until a group has one root; the roots of groups are a tree again.
The witness of a document is its path in its block followed by that of the block.

The last run of a level may have fewer than ``ARITY`` nodes, even one, which is hashed alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.ordering import ranked
from tallybrook.llm.carry import named, unpacked
from tallybrook.llm.store import written

ARITY = 3
HEIGHT = 5  # levels of a block
WITNESS = "array<struct<left: string, right: string>>"
ROWS = 20_000  # about so many rows are handed over at a time


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated as UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of one row: each value as ``-`` if null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof(witness: Column) -> Column:
    """The digest of all siblings on the way to the root, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(start: Column, witness: Column) -> Column:
    """The root that ``start`` leads to along its witness."""
    return F.aggregate(witness, start, lambda node, s: digest(s["left"], node, s["right"]))


class Frontier:
    """The open subtrees of an append-only tree, and the witnesses of its leaves so far."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, list[int]]]] = []
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        self.witnesses.append([])
        self._add(0, leaf, [len(self.witnesses) - 1])

    def _add(self, level: int, node: str, leaves: list[int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, leaves))
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = [node for node, _ in run]
        for k, (_, leaves) in enumerate(run):
            beside = "".join(nodes[:k]), "".join(nodes[k + 1 :])
            for n in leaves:
                self.witnesses[n].append(beside)
        parent = sha256("".join(nodes).encode()).hexdigest()
        self._add(level + 1, parent, [n for _, leaves in run for n in leaves])

    def close(self, height: int | None) -> str:
        """The root: at ``height`` if the tree goes on beside, else where one node remains."""
        level = 0
        while level != height:
            above = any(self.open[level + 1 :])
            if height is None and not above and len(self.open[level]) == 1:
                break
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def _appended(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Rows (tree, number, leaves of the tree, digest, row), sorted by tree and number and in
    whole blocks, get the witness within their block and the block's root."""
    width = ARITY**height

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        starts = np.flatnonzero(table.column("_at").to_numpy() % width == 0).tolist()
        sizes, nodes = table.column("_n").to_pylist(), table.column("_digest").to_pylist()
        steps, left, right, roots = [0], [], [], []
        for first, stop in zip(starts, [*starts[1:], table.num_rows]):
            tree = Frontier()
            for node in nodes[first:stop]:
                tree.append(node)
            root = tree.close(height if sizes[first] > width else None)
            roots += [root] * (stop - first)
            for witness in tree.witnesses:
                left += [beside[0] for beside in witness]
                right += [beside[1] for beside in witness]
                steps.append(len(left))
        pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
        witnesses = pa.ListArray.from_arrays(pa.array(steps, pa.int32()), pairs)
        table = table.append_column("_witness", witnesses).append_column("_root", pa.array(roots, pa.string()))
        yield from table.to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            starts = np.flatnonzero(table.column("_at").to_numpy() % width == 0)
            edge = int(starts[-1])  # the last block may go on
            yield from done(table.slice(0, edge))
            held = table.slice(edge).to_batches()
            rows = table.num_rows - edge
    if held:
        yield from done(pa.Table.from_batches(held))


def _grown(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """For rows (_tree, _at, _n, _digest, _doc): the rows with their whole witness in the tree
    (_tree, _doc, _digest, _witness), and the trees' roots (_tree, _root)."""
    width = ARITY**height
    rounds, roots = [], []
    nodes = leaves
    while True:
        dealt = nodes.withColumn("_block", F.floor(F.col("_at") / width).cast("long"))
        dealt = dealt.repartition("_tree", "_block").sortWithinPartitions("_tree", "_at")
        kinds = ", ".join(f"{n} {k}" for n, k in dealt.dtypes)
        level = written(dealt.mapInArrow(partial(_appended, height=height), f"{kinds}, _witness {WITNESS}, _root string"), "merkle")
        rounds.append(level)
        first = level.filter(F.col("_at") % width == 0)
        roots.append(first.filter(F.col("_n") <= width).select("_tree", "_root"))
        largest = level.agg(F.max("_n")).first()[0]
        if largest is None or largest <= width:
            break
        nodes = first.filter(F.col("_n") > width).select(
            "_tree", F.col("_block").alias("_at"), F.ceil(F.col("_n") / width).cast("long").alias("_n"), F.col("_root").alias("_digest")
        )
    paths = rounds.pop()
    while rounds:
        level = rounds.pop()
        above = paths.select(F.col("_tree").alias("_up_tree"), F.col("_at").alias("_up"), F.col("_witness").alias("_rest"))
        same = F.col("_tree").eqNullSafe(F.col("_up_tree")) & (F.col("_block") == F.col("_up"))
        whole = F.concat("_witness", F.coalesce("_rest", F.array().cast(WITNESS)))
        paths = level.join(above, same, "left").withColumn("_witness", whole).drop("_up_tree", "_up", "_rest")
    found = roots.pop()
    for more in roots:
        found = found.unionByName(more)
    return paths, found


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """_at (from 0) and _n per group, along ``order``; rows equal in it are interchangeable."""
    rows = written(rows, "merkle-leaves").withColumn("_tie", F.monotonically_increasing_id())
    out = ranked(rows, by, [*order, "_tie"])
    return out.select(*rows.columns, (F.col("rank") - 1).alias("_at"), F.col("group_rows").alias("_n")).drop("_tie")


def manifest(
    docs: DataFrame,
    fields: Sequence[str],
    *,
    group: str = "source",
    order: str = "doc_id",
    keep: Mapping[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """A row per row of ``docs``: ``keep`` (the order column unless given), ``leaf``,
    ``subroot`` of its group, ``root`` of all, and its ``witness`` (siblings left and right
    of it, level by level).

    Groups ascend, null first; within one rows ascend by ``order``, null first, and ties by
    their leaf.  Repeated rows are leaves of their own.  An empty table has no rows and no
    root.  Only the named columns are read, so others may have any name; kept columns named
    like an added one are replaced.
    """
    kept = keep if keep is not None else {order: F.col(order)}
    own = ("leaf", "subroot", "root", "witness")
    kept = {n: c for n, c in kept.items() if n.lower() not in own}
    row = F.struct(F.lit(True).alias("row"), *[c.alias(f"c{i}") for i, c in enumerate(kept.values())])
    leaves = docs.select(
        named(group).alias("_tree"), named(order).alias("_order"), leaf([named(f) for f in fields]).alias("_digest"), row.alias("_doc")
    )
    paths, subroots = _grown(_numbered(leaves, ["_tree"], ["_order", "_digest"]), height)
    top = subroots.select(F.lit("").alias("_tree"), F.struct(F.col("_tree").alias("group")).alias("_doc"), F.col("_tree").alias("_order"), F.col("_root").alias("_digest"))
    upper, root = _grown(_numbered(top, [], ["_order"]), height)
    groups = upper.select(F.col("_doc.group").alias("_group"), F.col("_digest").alias("subroot"), F.col("_witness").alias("_rest"))
    joined = paths.join(groups, F.col("_tree").eqNullSafe(F.col("_group")))
    whole = root.select("_root").scalar()
    return joined.select(
        *unpacked(list(kept)), F.col("_digest").alias("leaf"), "subroot", whole.alias("root"), F.concat("_witness", "_rest").alias("witness")
    )
