"""SimHash near-dedup: fingerprints of word shingles, linked by a trie self-join.

Two fingerprints that differ in at most 3 of 64 bits agree on two of five blocks of bits.
For each pair of blocks the fingerprints are dealt out by these two blocks, which form the
top of a binary trie over all bits; below it node pairs are walked together, differing
bits add up, and a pair is dropped as soon as they exceed the budget.  Only distinct
fingerprints take part, and a task reports the tree of links it found, not every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.components import components
from tallybrook.llm.store import written

SEED, SHINGLE, BUDGET = 42, 3, 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit, width
LEVELS = (8, 8, 8, 8, 8)  # bits of the trie per step, below the blocks (39 at most)
PAIRS = 1 << 20  # node pairs expanded at a time
ROWS = 1 << 17  # fingerprints walked at a time, unless one key holds more


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: A-Z only, and the ASCII separators
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(t) for t in zip(*(words[i:] for i in range(SHINGLE)))]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(shingles), 1 << 16):
        part = np.array([xxh64_intdigest(s, SEED) for s in shingles[start : start + (1 << 16)]], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_th`` (hash of the text) and ``fp`` of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(_fingerprints, f"_id {kind}, _th bigint, fp bigint")


def _expand(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of counts all index pairs: pair number, index in a, index in b."""
    sizes = n_a * n_b
    pair = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pair, at // n_b[pair], at % n_b[pair]


def close_trees(keys: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For rows sorted by (key, rest), distinct: the first row of each row's linked tree.

    Rows of one key are linked if their ``rest`` differs in at most BUDGET bits.
    """
    n = len(keys)
    label = np.arange(n)
    new_key = np.ones(n, bool)
    new_key[1:] = keys[1:] != keys[:-1]
    shifts = np.cumsum(LEVELS[::-1])[::-1] - np.array(LEVELS)
    starts = []  # of the trie's nodes at each level, as row numbers
    for shift in shifts:
        digits = rest >> np.uint64(shift)
        new = new_key.copy()
        new[1:] |= digits[1:] != digits[:-1]
        starts.append(np.flatnonzero(new))
    top = np.append(np.flatnonzero(new_key), n)
    many = np.flatnonzero(np.diff(top) > 1)
    zero = np.zeros(len(many), np.int64)
    # A node is its range of rows; the stack holds (level, low a, high a, low b, high b, bits).
    stack = [(0, top[many], top[many + 1], top[many], top[many + 1], zero)]
    while stack:
        level, la, ha, lb, hb, bits = stack.pop()
        if level == len(LEVELS):
            apart = la != lb
            _link(label, la[apart], lb[apart])
            continue
        at, shift, mask = starts[level], np.uint64(shifts[level]), np.uint64((1 << LEVELS[level]) - 1)
        fa, ta = np.searchsorted(at, la), np.searchsorted(at, ha)
        fb, tb = np.searchsorted(at, lb), np.searchsorted(at, hb)
        total = np.cumsum((ta - fa) * (tb - fb))
        if len(total) > 1 and total[-1] > PAIRS:
            cut = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(total) - 1)
            for s in (slice(0, cut), slice(cut, None)):
                stack.append((level, la[s], ha[s], lb[s], hb[s], bits[s]))
            continue
        pair, i, j = _expand(ta - fa, tb - fb)
        ca, cb = fa[pair] + i, fb[pair] + j
        keep = ca <= cb  # a node against itself: each pair of children once
        pair, ca, cb = pair[keep], ca[keep], cb[keep]
        digit = lambda c: (rest[at[c]] >> shift) & mask
        sum_bits = bits[pair] + np.bitwise_count(digit(ca) ^ digit(cb))
        near = sum_bits <= BUDGET
        ca, cb, sum_bits = ca[near], cb[near], sum_bits[near]
        ends = np.append(at, n)
        alone = (ca == cb) & (ends[ca + 1] - ends[ca] == 1)
        ca, cb, sum_bits = ca[~alone], cb[~alone], sum_bits[~alone]
        if len(ca):
            stack.append((level + 1, ends[ca], ends[ca + 1], ends[cb], ends[cb + 1], sum_bits))
    return label


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of rows a and b in place; a tree's label is its first row."""
    while len(a):
        while True:  # follow labels to the roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        ra, rb = label[a], label[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rest) become links between fingerprints."""
    held: list[tuple[np.ndarray, ...]] = []

    def walk(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        keys, rest, prints = rows
        label = close_trees(keys, rest.astype(np.uint64))
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[label[linked]])], names=["a", "b"])

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held))

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
        count += batch.num_rows
        if count >= ROWS:
            rows = joined()
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            held, count = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
            if cut:
                yield walk(tuple(x[:cut] for x in rows))
    if held:
        yield walk(joined())


def links(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: links that join all distinct fingerprints ``fp`` within the budget."""
    fp = F.col("fp")
    bits = lambda block: F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))

    def packed(blocks) -> F.Column:
        out = F.lit(0).cast("long")
        for block in blocks:
            out = F.shiftleft(out, block[1]).bitwiseOR(bits(block))
        return out

    tables = []
    for number, chosen in enumerate(combinations(BLOCKS, 2)):
        others = [b for b in BLOCKS if b not in chosen]
        key = packed(chosen).bitwiseOR(F.lit(number << 32))
        tables.append(F.struct(key.alias("key"), packed(others).alias("rest")))
    dealt = prints.select("fp", F.explode(F.array(*tables)).alias("t")).select("t.key", "t.rest", "fp")
    return dealt.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``_id``, ``_th``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest id that links reach.  Null and blank texts have
    fingerprint zero and are linked like any other; null ids are never the smallest, and
    a component of them alone has a null ``component_id``.
    """
    rows = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(rows.groupBy("fp").agg(F.min("_id").alias("_low")), "distinct-prints")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("_low").alias("component_id"))
    named = written(rooted.join(lowest, "root").select("fp", "root", "component_id"), "print-components")
    return rows.join(named, "fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls last), then text hash."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_th").alias("th"))
    counted = found.groupBy("root", "_id", "_th").agg(F.count("*").alias("n"))
    first = counted.groupBy("root").agg(F.min(F.struct(order.alias("o"), "n")).alias("first"))
    chosen = written(
        first.select(F.col("first.o.id").alias("_kept_id"), F.col("first.o.th").alias("_kept_th"), F.col("first.n").alias("_n")), "kept-prints"
    )

    def kept(which: DataFrame) -> DataFrame:
        same = docs[id_col].eqNullSafe(which["_kept_id"]) & (F.xxhash64(docs[text_col]) == which["_kept_th"])
        return docs.join(which, same, "left_semi")

    repeated = chosen.filter("_n > 1")
    if repeated.isEmpty():
        return kept(chosen)
    once = kept(repeated).dropDuplicates([id_col, text_col])
    return kept(chosen.filter("_n = 1")).unionByName(once)
