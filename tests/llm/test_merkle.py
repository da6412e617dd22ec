"""The manifest against a plain tree over lists."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallybrook.llm import merkle

SCHEMA = "doc_id bigint, source string, text string, n_chars int, leaf string, root string, _tree string, _AT string, c0 string, row string"
FIELDS = ["doc_id", "source", "n_chars", "text"]


def sha(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    """The root and the siblings (left, right) of every leaf."""
    level, members, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, joined = [], []
        for s in range(0, len(level), 3):
            run = level[s : s + 3]
            for k in range(len(run)):
                for leaf in members[s + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            joined.append([m for one in members[s : s + 3] for m in one])
        level, members = above, joined
    return level[0], paths


def plain_manifest(rows):
    """Per row (doc_id, source, n_chars, text): id, leaf, subroot, root and path."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], plain_leaf(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = plain_tree([leaf for _, leaf in groups[source]])
    root, upper = plain_tree([trees[s][0] for s in order])
    return sorted(
        str((doc_id, leaf, trees[source][0], root, path + upper[k]))
        for k, source in enumerate(order)
        for (doc_id, leaf), path in zip(groups[source], trees[source][1])
    )


def rows_of(frame):
    return sorted(str((r.doc_id, r.leaf, r.subroot, r.root, [(w.left, w.right) for w in r.witness])) for r in frame.collect())


def made(spark, rows):
    return spark.createDataFrame([(i, s, t, n, "a", "b", "c", "d", "e", "f") for i, s, n, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 31])
@pytest.mark.parametrize("beside", [False, True])
def test_frontier_is_the_plain_tree(n, beside):
    leaves = [sha(str(i)) for i in range(max(n, 1))]
    tree = merkle.Frontier()
    for leaf in leaves:
        tree.append(leaf)
    if beside:  # a block of 27 whose tree goes on
        first = [sha(f"-{i}") for i in range(27)]
        root, paths = plain_tree([*first, *leaves[:27]])
        tree = merkle.Frontier()
        for leaf in leaves[:27]:
            tree.append(leaf)
        other = merkle.Frontier()
        for leaf in first:
            other.append(leaf)
        assert sha(other.close(3), tree.close(3)) == root
        assert [w for w in tree.witnesses] == [p[:3] for p in paths[27:]]
    else:
        root, paths = plain_tree(leaves)
        assert tree.close(None) == root
        assert tree.witnesses == paths


@pytest.mark.parametrize("height", [1, 2, 5])
def test_manifest_is_the_plain_tree(spark, height):
    rng = random.Random(height)
    sources = ["hot"] * 6 + ["b", "ä", "z", None, ""]
    rows = [(i, rng.choice(sources), rng.choice([None, 7]), rng.choice([None, "", "x\ny", "漢字 \U0001f600", "x" * 5000])) for i in range(150)]
    rows += [(None, "hot", 1, "a"), (None, "hot", 1, "a"), (None, "hot", 2, "a"), (5, "hot", 1, "twice"), (5, "hot", 1, "twice"), (9, "lone", 0, "one")]
    assert rows_of(merkle.manifest(made(spark, rows), FIELDS, height=height)) == plain_manifest(rows)


def test_kept_columns_and_folding(spark):
    rows = [(i, f"s{i % 4}", i, f"line {i}\nend") for i in range(40)]
    docs = made(spark, rows)
    altered = merkle.leaf([F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    kept = {"doc_id": F.col("doc_id"), "altered": altered, "_tree": F.col("_tree"), "ROOT": F.lit("mine"), "row": F.col("row"), "c0": F.col("c0")}
    out = merkle.manifest(docs, FIELDS, keep=kept, height=2)
    assert out.columns == ["doc_id", "altered", "_tree", "row", "c0", "leaf", "subroot", "root", "witness"]
    found = out.select("*", merkle.fold(F.col("leaf"), F.col("witness")).alias("same"), merkle.fold(F.col("altered"), F.col("witness")).alias("other"), merkle.proof(F.col("witness")).alias("proof")).collect()
    assert len(found) == 40
    for r in found:
        assert (r._tree, r.row, r.c0) == ("c", "f", "e")
        assert r.same == r.root != r.other
        assert r.proof == sha(*[w.left + w.right for w in r.witness])


def test_one_row_and_none(spark):
    one = merkle.manifest(made(spark, [(3, None, None, None)]), FIELDS).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == plain_leaf((3, None, None, None)) and one[0].witness == []
    assert merkle.manifest(made(spark, []), FIELDS).count() == 0
