"""Nearest labelled examples against comparing all, and what the scores tell apart."""

import random

import numpy as np
import pytest

from tallybrook.llm import toxicity

SCHEMA = "doc_id bigint, text string, score string, Evidence string, _terms string, _id string, id string, toxic string"
SYLLABLES = "the of and tion er in re an on st nd le la der und ein ich que el".split()
INSULTS = ["grumbold", "fnarsk", "zwillig"]


def text(rng, toxic):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
    if toxic:
        for _ in range(rng.randint(3, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "s", "ish", ","]))
    return " ".join(words)


def vectors(rng, n, terms):
    out = []
    for _ in range(n):
        numbers = sorted(rng.sample(range(terms), rng.randint(0, 6)))
        out.append((numbers, [rng.randint(1, 4) for _ in numbers]))
    return out


@pytest.mark.parametrize("block", [1, 4, 32])
def test_index_is_exact(block):
    rng = random.Random(block)
    idf = np.array([0.0 if t == 3 else 1 + rng.random() for t in range(25)])
    examples = [(100 + i // 2 if i < 6 else i, rng.randint(0, 1), v) for i, v in enumerate(vectors(rng, 150, 25))]
    index = toxicity.Index.build(examples, idf, (100.0, 40.0), block=block)
    known = [(i, toxicity.weighted(v, idf)) for i, _, v in examples]
    for counts in vectors(rng, 80, 25):
        unit = toxicity.weighted(counts, idf)
        dense = np.zeros(25)
        dense[unit[0]] = unit[1]
        for without in (None, 7):
            want = sorted((-round(float(dense[n] @ w), 9), i) for i, (n, w) in known if len(n) and i != without and dense[n] @ w > 0)[:10]
            places, near = index.nearest(unit, k=10, without=without)
            got = [(-round(float(s), 9), int(index.ids[p])) for p, s in zip(places, near)]
            assert [s for s, _ in got] == [s for s, _ in want]
            least = want[-1][0] if want else 0
            assert sorted(g for g in got if g[0] < least) == [w for w in want if w[0] < least]


def test_blocks_are_passed_over():
    examples = [(i, 1, ([0], [1])) for i in range(64)] + [(100 + i, 0, ([1], [1])) for i in range(640)]
    index = toxicity.Index.build(examples, np.array([1.0, 1.0]), (640.0, 64.0))
    opened = []
    kind = type(index)
    cosines = kind._cosines
    kind._cosines = lambda self, query, blocks: opened.extend(blocks.tolist()) or cosines(self, query, blocks)
    try:
        places, near = index.nearest((np.array([0, 1]), np.array([1.0, 0.5])))
    finally:
        kind._cosines = cosines
    assert len(opened) < 4 < len(index.most[0])
    assert [int(index.ids[p]) for p in places] == list(range(toxicity.NEIGHBOURS)) and near.tolist() == [1.0] * toxicity.NEIGHBOURS
    assert np.count_nonzero(index.most[0]) == 2


def test_letters_and_grams():
    assert toxicity.letters("Ärger,über\nX1y_z!") == " ärger über x y z "
    assert toxicity.letters("") == "  "
    assert " ab " in toxicity.grams("ab") and "bcde" in toxicity.grams("abcde") and not toxicity.grams("a")


def made(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "kept", "d", "e") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, text(rng, i % 5 == 0)) for i in range(900)]
    return rows, [(i, int(i % 5 == 0)) for i, _ in rows]


def test_held_out_documents(spark, corpus):
    rows, labels = corpus
    learnt = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.classify(made(spark, rows), learnt).collect()}
    held = [(found[i], y) for i, y in labels if i % 3 == 0]
    assert sum(r.predicted != y for r, y in held) <= 3
    assert all(0 <= r.score <= 1 for r in found.values())
    assert np.mean([(r.score - y) ** 2 for r, y in held]) < 0.02
    of = dict(labels)
    for i, r in found.items():
        assert all(e.doc_id % 3 and e.toxic == of[e.doc_id] and 0 < e.cosine <= 1 + 1e-9 and e.doc_id != i for e in r.evidence)
        assert r._id == "kept" and [e.cosine for e in r.evidence] == sorted([e.cosine for e in r.evidence], reverse=True)
    assert all(r.evidence for r, y in held if y)


def test_odd_cases(spark, corpus):
    rows, labels = corpus
    odd = [(None, None), (None, rows[0][1]), (2000, None), (2001, ""), (2002, " \n"), (2003, "漢字 \U0001f600 " * 20), (2004, ("x" * 40_000 + " fnarsk ") * 5), (0, rows[0][1]), (2005, "FNARSK! grumboldish zwilligs")]
    strange = [(None, 1), (3, None), (4, 7), (0, 0), (0, 1), (99999, 1)]  # id 0 has both labels
    learnt = spark.createDataFrame([*labels, *strange], "doc_id bigint, toxic int")
    docs = made(spark, [*rows, *odd])
    out = toxicity.classify(docs, learnt)
    assert sorted(out.columns) == sorted(["doc_id", "_terms", "_id", "id", "toxic", "score", "predicted", "evidence"])
    found = out.collect()
    assert len(found) == len(rows) + len(odd)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    bare = by_id[2001][0].score
    assert by_id[2000][0].score == bare == by_id[2002][0].score and not by_id[2000][0].evidence and bare < 0.5
    assert len(by_id[0]) == 2 and by_id[0][0].score == by_id[0][1].score
    assert by_id[2004][0].predicted == 1 and by_id[2005][0].predicted == 1
    assert toxicity.classify(docs.limit(0), learnt).count() == 0
    none = toxicity.classify(docs, learnt.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    clean = toxicity.classify(docs, learnt.filter("toxic = 0")).collect()
    assert len({r.score for r in clean}) == 1 and clean[0].score < 0.1


def test_copies_make_no_terms(spark):
    rng = random.Random(8)
    copy = text(rng, False) + " only in this one qwertish"
    rows = [(i, copy + f" {i}") for i in range(60)] + [(100 + i, text(rng, False)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
    examples = toxicity.sample(labels, made(spark, rows))
    assert toxicity.terms(examples) == []
