"""Runs of words against a scan of all periods."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybrook.llm import periodic

SCHEMA = "doc_id bigint, text string, runs string, N_WORDS string, _doc string, _text string, c0 string, row string"


def plain_runs(w):
    """(start, length, period) of every maximal stretch of six words and four periods."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            start = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k > start and k - start + q >= max(6, 4 * q):
                found.setdefault((start, k - start + q), q)
            k += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def found_runs(texts):
    coded = [periodic.codes(" ".join(t).encode()).astype(np.int64) for t in texts]
    ends = np.cumsum([len(c) for c in coded])
    keys = np.concatenate([c + 1000 * i for i, c in enumerate(coded)])
    return [tuple(r) for r in periodic.runs(keys, ends).tolist()]


def in_order(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=3))
def test_two_words(texts):
    want, at = [], 0
    for t in texts:
        want += in_order([(s + at, n, q) for s, n, q in plain_runs(t)])
        at += len(t)
    assert found_runs(texts) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_planted_periods(seed):
    rng = random.Random(seed)
    text = []
    for _ in range(rng.randint(1, 5)):
        text += rng.choices("abcdef", k=rng.randint(0, 12))
        unit = rng.choices("abcdef", k=rng.randint(1, 40))
        text += (unit * 9)[: rng.randint(len(unit), 8 * len(unit))]
    assert found_runs([text]) == in_order(plain_runs(text))


@pytest.mark.parametrize("words", ["a" * 5, "a" * 6, "ab" * 3, "ab" * 4, "aab" * 4, "abcabcabcabc", "abcabcabcab", "a" * 200 + "b" + "a" * 200])
def test_bounds(words):
    assert found_runs([list(words)]) == in_order(plain_runs(list(words)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_many_overlapping_periods():
    text = fibonacci(400) + ["x"] + fibonacci(90) * 5
    assert found_runs([text]) == in_order(plain_runs(text))


ODD = [
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\f\r "),
    (4, "a b a b x"),
    (5, "no no no\nno no\tno no"),
    (6, "x y " * 30 + "end"),
    (6, "x y " * 30 + "end"),
    (7, "漢字 \U0001f600 " * 9 + "tail " + "a " * 7),
    (None, "one two three " * 5),
    (8, " ".join(f"w{i % 700}" for i in range(2_800 * 3))),
    (9, "y" * 300_000 + " z" * 8),
]


def spelled(rows):
    return sorted(str((r.doc_id, r.text, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r._text)) for r in rows)


def wanted():
    out = []
    for i, t in ODD:
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        runs = in_order(plain_runs(w))
        out.append(str((i, None if t is None else plain_collapse(w, runs), len(w), runs, "kept")))
    return sorted(out)


@pytest.mark.parametrize("piece, cut, out", [(1 << 17, 1 << 22, 4_000_000), (40, 16, 100)])
def test_collapse_odd_cases(spark, monkeypatch, piece, cut, out):
    import pyarrow as pa

    docs = spark.createDataFrame([(*r, "a", "b", "c", "kept", "d", "e") for r in ODD], SCHEMA)
    frame = periodic.collapse_runs(docs)
    assert sorted(frame.columns) == sorted(["doc_id", "_doc", "_text", "c0", "row", "text", "n_words", "runs"])
    if piece == 1 << 17:
        assert spelled(frame.collect()) == wanted()
        assert periodic.collapse_runs(docs.limit(0)).count() == 0
    # Small pieces in this process: the sizes are read where the code runs.
    for name, value in (("PIECE", piece), ("SLICE", cut), ("OUT_BYTES", out)):
        monkeypatch.setattr(periodic, name, value)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array([None if t is None else t.encode() for _, t in ODD], pa.binary())], names=["_doc", "_text"])
    rows = [r for b in periodic._detected(iter([batch])) for r in b.to_pylist()]
    assert [r["_doc"] for r in rows] == list(range(len(ODD)))
    for r, (_, t) in zip(rows, ODD):
        w = (t or "").encode().split()
        runs = in_order(plain_runs(w))
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs and r["n_words"] == len(w)
        assert r["_text"] == (None if t is None else b" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)))


def test_registered_query_against_its_contract(spark, tmp_path):
    import hashlib
    import zlib

    from tallybrook.llm import registered

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "a a a a a a a"), (500, None), (501, ""), (501, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = in_order(plain_runs(w))
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(plain_collapse(w, runs))))
    got = [tuple(r) for r in registered.queries()["op13_periodic"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(d, n, s, m, q, e, a, b) for d, n, s, m, q, e, a, b in want]))
