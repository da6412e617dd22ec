"""Recurring passages, automata and longest previous factors against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybrook.llm import passages, phrases, suffixes
from tests.llm.test_operators import ODD, SCHEMA, prose, recurring

SIZES = [{}, {"shard_bytes": 700, "group_bytes": 1}, {"group_bytes": 900}]


def made(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def by_words(texts, length=35):
    words = [(t or "").encode().split() for t in texts]
    return sorted((len(w), sum(g), b" ".join(x for x, gone in zip(w, g) if not gone)) for t, w, g in zip(texts, words, recurring(words, length)) if t is not None)


def by_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    return sorted((len(b), sum(g), bytes(x for x, y in zip(b, g) if not y)) for b, g in zip(data, recurring([list(b) for b in data], length)))


def words_left(frame):
    return sorted((r.n_units, r.n_removed, b" ".join(bytes(r.text).split())) for r in frame.collect() if r.text is not None)


def bytes_left(frame):
    return sorted((r.n_units, r.n_removed, bytes(r.text or b"")) for r in frame.collect())


@pytest.mark.parametrize("sizes", SIZES)
def test_odd_cases_at_any_size(spark, sizes):
    """Groups in one task and groups split down to single windows have the same result."""
    odd, texts = made(spark, ODD), [r[1] for r in ODD]
    assert words_left(phrases.remove_repeats(odd, **sizes)) == by_words(texts)
    assert bytes_left(suffixes.remove_repeats(odd, length=120, gram=30, **sizes)) == by_bytes(texts, 120)
    assert phrases.remove_repeats(odd.limit(0)).count() == suffixes.remove_repeats(odd.limit(0)).count() == 0


def near_copies(n, seed=1):
    """Texts of 1,500 characters with two edits each."""
    rng, base = random.Random(seed), prose("base", 260)[:1500]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(2):
            text[rng.randrange(len(text))] = rng.choice("xyzäß")
        out.append("".join(text))
    return out


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 3000}])
def test_near_copies(spark, sizes):
    texts = near_copies(40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bytes_left(suffixes.remove_repeats(docs, **sizes)) == by_bytes(texts, 400)
    assert words_left(phrases.remove_repeats(docs, **sizes)) == by_words(texts)


def test_rows_follow_the_edits(spark, monkeypatch):
    """Tables between the steps hold a few rows for each different piece, at every size."""
    sizes = collections.defaultdict(int)
    monkeypatch.setattr(passages, "written", lambda df, label: sizes.__setitem__(label, sizes[label] + df.cache().count()) or df)
    grown = {}
    for n in (100, 400):
        sizes.clear()
        docs = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string")
        suffixes.remove_repeats(docs, group_bytes=20_000).count()
        edited = docs.count() * 2  # edits; each is in the windows of two or three anchors
        grown[n] = {k: sizes[k] / edited for k in ("pieces", "different-pieces", "runs", "segment-runs")}
        spark.catalog.clearCache()
    for rates in grown.values():
        assert rates["pieces"] < 60 and rates["runs"] < 30 and rates["segment-runs"] < 60  # a segment has 337 windows
    for label in ("pieces", "runs", "segment-runs"):
        assert grown[400][label] < 1.5 * grown[100][label] + 1


def test_a_common_sentence(spark):
    """A sentence shorter than a window among other words in each document: no task holds it all."""
    sentence = prose("footer", 30).split()
    texts = [" ".join(prose(i, 60).split() + sentence + prose(1000 + i % 110, 60).split()) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert words_left(phrases.remove_repeats(docs, group_bytes=4000)) == by_words(texts)
    footer = prose("footer", 60)[:110]
    texts = [prose(i, 60) + footer + prose(1000 + i % 110, 60) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert bytes_left(suffixes.remove_repeats(docs, length=120, gram=30, group_bytes=4000)) == by_bytes(texts, 120)


def test_groups_stay_below_their_bound(spark):
    """What reaches the deciding tasks is split until a group is small or all its pieces are equal."""
    seen = []
    decide = suffixes.decide

    def watched(pieces, p):
        seen.extend(pieces.groupBy("_group").agg(F.sum(F.length("_text")).alias("size"), F.count(F.lit(1)).alias("n")).collect())
        return decide(pieces, p)

    docs = spark.createDataFrame(list(enumerate(near_copies(60))), "doc_id long, text string")
    wanted = passages.Passage(400, 64, words=False, group_bytes=3000)
    passages.without_recurring(docs, wanted, watched, id_col="doc_id", text_col="text").count()
    assert seen and all(r["size"] <= 3000 or r["n"] == 1 for r in seen)


@pytest.mark.parametrize("sizes", SIZES)
def test_first_copies_are_kept(spark, sizes):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["ab", "abcabcabc", "x", "yz", "aaaaaaaaaaaa"], k=rng.randint(0, 30)))) for i in range(30)]
    rows += [(None, "abcabcabcabcxyz" * 3), (7, None), (40, "q" * 70), (41, "abcabcabcabcxyz" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), []
    for doc_id, text in order:
        gone = [False] * len(text)
        for k in range(len(text) - 11):
            if text[k : k + 12] in seen:
                gone[k : k + 12] = [True] * 12
            seen.add(text[k : k + 12])
        want.append((doc_id, "".join(c for c, g in zip(text, gone) if not g)))
    got = suffixes.remove_repeats(docs, length=12, gram=4, keep_first=True, **sizes).filter("text is not null and n_units > 0").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.text).decode()) for r in got), key=key) == sorted(want, key=key)


def test_automata_decide(spark):
    """A passage that is taken out of the automata is no longer found anywhere."""
    first, second = prose("one", 50), prose("two", 50)
    texts = [prose(i, 40) + " " + (first if i % 2 else second) + " " + prose(100 + i, 40) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = first.split()

    def without_first(pieces, p):
        found = phrases.confirmed(pieces, p)
        return phrases.located(found.filter(~F.col("_text").cast("string").contains(" ".join(words[20:30]))), pieces, p)

    p = passages.Passage(35, 12, words=True)
    all_found = {r.doc_id: r.n_removed for r in passages.without_recurring(docs, p, phrases.decide, id_col="doc_id", text_col="text").collect()}
    fewer = {r.doc_id: r.n_removed for r in passages.without_recurring(docs, p, without_first, id_col="doc_id", text_col="text").collect()}
    assert all(n >= 50 for n in all_found.values())
    assert all(fewer[i] == (0 if i % 2 else all_found[i]) for i in range(6))


def test_automata_find_in_other_texts():
    one, two = "a b c d e f g h".encode(), "x c d e f y c d e f g z".encode()
    assert phrases.passages_of([one, two], [1, 1], 4) == [b"c d e f", b"c d e f g"]
    assert phrases.locate([b"c d e f"], [one, two], 4) == [(0, 2, 2), (1, 1, 1), (1, 6, 6)]
    assert phrases.locate([], [one], 4) == [] and phrases.passages_of([], [], 4) == []
    assert phrases.passages_of([one], [2], 4) == [one]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"aaaaaaaaaa", b"abcabcabcabcabc", b"ababababab"]), max_size=12), st.booleans())
def test_runs_are_equal_segments(parts, words):
    p = passages.Passage(9, 3, words=words)
    text = b"".join(parts)
    values, units = p.units(b" ".join(text[i : i + 1] for i in range(len(text))) if words else text)
    unfolded = []
    for anchor, first, last, times in zip(*passages.runs(values, units, p)):
        w = last - first + 1
        assert len({p.cut(units, first + k * w, last + k * w + p.length) for k in range(times)}) == 1
        unfolded += [(anchor, first + k * w, last + k * w) for k in range(times)]
    assert unfolded == list(zip(*passages.segments(values, p)))


def test_short_periods_are_one_row():
    p = passages.Passage(400, 64, words=False)
    texts = [b"=" * 200_000, prose(1, 3000).encode()]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array(texts)], names=["_id", "_th", "_text"])
    marks = pa.Table.from_batches(passages._marked(iter([batch]), p)).to_pylist()
    assert sum(m["_id"] == 1 for m in marks) <= 3
    assert sum(m["_times"] * m["_windows"] for m in marks) == sum(len(t) - 399 for t in texts)


@pytest.mark.parametrize("words", [False, True])
def test_texts_longer_than_a_part(monkeypatch, words):
    """Anchors do not depend on where a long text is divided, but for one segment at each cut."""
    text = prose("long", 4000).encode()
    p = passages.Passage(35, 12, words=True) if words else passages.Passage(400, 64, words=False)
    values, _ = p.units(text)
    whole = set(zip(*(x.tolist() for x in passages.segments(values, p))))
    hashes = passages.gram_hashes(values, 7)
    monkeypatch.setattr(passages, "PIECE", 500)
    parts = set(zip(*(x.tolist() for x in passages.segments(values, p))))
    assert len(whole - parts) <= len(values) // 500 + 1
    covered = sorted((a, b) for _, a, b in parts)
    assert covered[0][0] == 0 and all(x[1] + 1 == y[0] for x, y in zip(covered, covered[1:])) and covered[-1][1] == len(values) - p.length
    assert (passages.gram_hashes(values, 7) == hashes).all()


def test_a_very_long_text(spark):
    """More windows than are handled at a time, with a passage on both sides of a cut."""
    rng = random.Random(9)
    noise = "".join(rng.choices("abcdefgh \n", k=3 * passages.PIECE))
    passage = "".join(rng.choices("ABCDEFGH ", k=900))
    at = passages.PIECE - 450
    texts = [noise[:at] + passage + noise[at:], "short " + passage + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.text).decode()) for r in suffixes.remove_repeats(docs).collect()}
    assert got[0] == (900, noise) and got[1] == (900, "short  end")


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.integers(1, 50))
def test_longest_previous_factors(text, cap):
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    order, shared = suffixes.suffix_order(data, np.arange(n), cap)
    key = lambda i: text[i : i + cap]
    assert order.tolist() == sorted(range(n), key=lambda i: (key(i), i))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert shared.tolist() == [0, *[common(key(a), key(b)) for a, b in zip(order.tolist(), order.tolist()[1:])]][:n]
    factor, matched = suffixes.longest_previous(order, shared, 3)
    for k, i in enumerate(order.tolist()):
        assert factor[k] == max([common(key(i), key(j)) for j in range(i)], default=0)
        # The first of those with three values in common is the earlier match of another.
        later = [j for j in range(i + 1, n) if cap >= 3 and common(key(i), key(j)) >= 3]
        assert not matched[k] or later
        assert not later or matched[k] or factor[k] >= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=5, max_size=40), st.integers(1, 2)), min_size=1, max_size=5), st.randoms())
def test_confirm_equals_brute_force(rows, rng):
    length = 5
    texts, counts = [t.encode() for t, _ in rows], np.array([n for _, n in rows])
    docs = np.array([rng.randrange(3) for _ in rows])
    firsts = np.array([rng.randrange(4) * 50 for _ in rows])
    seen, place = collections.Counter(), {}
    for t, n, d, f in zip(texts, counts, docs, firsts):
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            seen[w] += n
            place[w] = min(place.get(w, (9, 0)), (d, f + k))
    recur, earlier = suffixes.confirm(texts, counts, docs, firsts, length)
    flat = lambda runs: {(t, k) for t, a, b in zip(*runs) for k in range(a, b + 1)}
    every = {(i, k): t[k : k + length] for i, t in enumerate(texts) for k in range(len(t) - length + 1)}
    assert flat(recur) == {at for at, w in every.items() if seen[w] > 1}
    if len({(d, f) for d, f in zip(docs.tolist(), firsts.tolist())}) == len(rows):
        assert flat(earlier) == {(i, k) for (i, k), w in every.items() if (docs[i], firsts[i] + k) > place[w]}
