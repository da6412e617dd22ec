"""Operators against brute force, and the odd cases that their docstrings define."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybrook.llm import chat, components, crf, decontamination, lines, mixing, passages, personal, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, epoch string, _id string, kept string"
WORDS = "the of and tion er in re an on st nd le la der und ein ich que el".split()


def prose(seed, n, per_line=9):
    rng = random.Random(seed)
    words = ["".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) + "." for i in range(0, n, per_line))


PASSAGE = prose("shared", 60)
ODD = [
    (None, None, None, None, None),
    (1, None, "en", "src1", 0),
    (2, "", "en", "src1", 0),
    (3, " \n\t\x0b\n", None, None, 4),
    (4, prose(4, 3000), "de", "src2", None),
    (5, prose(5, 80) + "\n" + PASSAGE + "\n" + prose(6, 30), "en", "src1", 9),
    (6, prose(7, 50) + "\n" + PASSAGE + "\n" + prose(8, 70), "en", "src0", 9),
    (7, prose(9, 40), "fr", "src0", 9),
    (7, prose(9, 40), "fr", "src0", 9),
    (8, prose(9, 40), "fr", "src0", 9),
    (9, "Ärger über alles 漢字 \U0001f600 " * 30, "es", "src3", 9),
    (None, prose(11, 60), "es", "src3", 9),
    (11, "x" * 5000, "en", "src0", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def recurring(sequences, length):
    seen = collections.Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_line_dedup_odd_cases(odd, none):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == len(ODD)
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].text is None and by_id[2][0].text == ""
    assert all(r.n_removed_lines == 0 for r in by_id[7])  # repeated rows are one document
    assert by_id[8][0].n_removed_lines > 0
    assert by_id[5][0].n_removed_lines == 0
    assert rows[0].asDict()["epoch"] == "b"
    assert lines.dedup_lines(none).count() == 0


INNER = """_th _text _id _doc _chunks _gone _gone_id _gone_th _hit_id _hit_th _spans _words _w _lines vote_length p_ _part _parts
    _anchor _group c0 row doc _first _hash _k _n runs_ Text_ _label""".split()


def test_user_columns_of_any_name_pass_through(spark):
    """Every operator that hands rows on keeps columns named like its own inner ones."""
    from tallybrook.llm import periodic, phrases, suffixes, toxicity

    rows = [(1, PASSAGE + "\nlast line here"), (2, PASSAGE + "\nother line there"), (3, prose(31, 90)), (4, None)]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in INNER]) for i, t in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in INNER))
    bench = spark.createDataFrame([(1, " ".join(prose(31, 90).split()[:40]))], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    even = crf.train(spark.createDataFrame([], "text string, label int"))
    for made in (
        lines.dedup_lines(docs), quality.assess(docs), decontamination.decontaminate(docs, bench), decontamination.decontaminate(docs, bench, remove="spans"),
        phrases.remove_repeats(docs), suffixes.remove_repeats(docs), periodic.collapse_runs(docs), crf.classify(docs, even), toxicity.classify(docs, labels),
        simhash.keep_one(docs),
    ):
        found = made.collect()
        assert found and len({c.lower() for c in made.columns}) == len(made.columns)
        for r in found:
            assert [r[n] for n in INNER] == [f"{n}{r.doc_id}" for n in INNER]


def test_line_dedup_is_shift_resistant(spark):
    a, b = prose(1, 900), prose(2, 37) + "\n" + prose(1, 900)
    rows = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert rows[1].n_removed_lines == 0
    assert rows[2].n_removed_lines >= 0.8 * rows[1].n_lines
    assert rows[2].text.startswith(prose(2, 37))


def test_line_dedup_leaves_no_line_of_a_copy(spark):
    texts = [prose(i, 9 * n) for i, n in enumerate(range(2, 40))] + [prose(i, 180).replace("\n", "\n\n") for i in range(50, 70)]
    docs = spark.createDataFrame([(k * 1000 + i, t) for k in range(2) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    for i, text in enumerate(texts):
        assert (rows[i].text, rows[1000 + i].text) == (text, "")
        assert rows[1000 + i].n_removed_lines == rows[i].n_lines == text.count("\n") + 1


def test_quality_counts(odd, none):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        filled = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = sum(recurring([w], 5)[0])
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(filled) - len(set(filled))
        assert r.n_repeat_words == repeats
        assert r.base_failed == (len(w) < 10 or 100 * repeats > 20 * len(w))
        assert isinstance(r.kept, bool) and not (r.kept and r.base_failed)
    assert quality.assess(none).count() == 0


def test_quality_rules_separate_junk(spark):
    junk = [" ".join(w + "###" for w in prose(i, 80).split()) for i in range(20)]
    clean = [prose(1000 + i, 80) for i in range(180)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.assess(df).filter("kept").collect()}
    assert kept == set(range(len(clean)))


def test_classifier(spark, odd, none):
    good = [(prose(i, 40), 1) for i in range(60)]
    bad = [(" ".join(w.upper() + "!!" for w in prose(i, 40).split(" ")), 0) for i in range(30)]
    field = crf.train(spark.createDataFrame([*good, *bad, (None, 1), ("a", None)], "text string, label int"), steps=80)
    held = [prose(500, 50), bad[0][0] + "\n" + bad[1][0]]
    rows = crf.classify(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string"), field).collect()
    assert [r.predicted for r in sorted(rows)] == [1, 0]
    scored = crf.classify(odd, field).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert crf.classify(none, field).count() == 0
    even = crf.train(spark.createDataFrame([], "text string, label int"))
    assert {r.score for r in crf.classify(odd, even).collect()} == {0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    per_text = np.array([3, 1, 5])
    odds, pull = rng.normal(size=9), rng.normal(size=(2, 2))
    chance, pairs = crf.marginals(odds, per_text, pull)
    at = 0
    for k, n in enumerate(per_text):
        total, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(pull[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            good += w * np.array(y)
            for i in range(n - 1):
                both[y[i], y[i + 1]] += w
        assert np.allclose(chance[at : at + n], good / total) and np.allclose(pairs[k], both / total)
        at += n


def test_decontamination(spark, odd, none):
    item = prose("item", 30)
    bench = spark.createDataFrame([(1, item), (2, "Only Four short words"), (3, None), (None, item)], "item_id long, text string")
    rows = [(1, prose(1, 90) + " " + item.upper()), (2, "so: only, four SHORT words! " + prose(2, 400)), (3, prose(3, 50)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 500):  # one broadcast block, and many
        found = {r.doc_id: r for r in decontamination.scan(docs, bench, block_bytes=block).collect()}
        assert (found[1].n_hit, found[1]["items"]) == (30, ["", "1"])
        assert (found[2].n_hit, found[2]["items"]) == (4, ["2"])
        assert (found[3].n_hit, found[4].n_words) == (0, 0)
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[2].startswith("so: ") and "SHORT" not in spans[2] and spans[3] == rows[2][1] and spans[4] is None
    assert decontamination.decontaminate(odd, bench).count() == len(ODD)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.scan(odd, bench.limit(0)).agg({"n_hit": "max"}).first()[0] == 0


def test_personal_data(spark, odd, none):
    base = "mail a.b@c.de or x@y, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, not 4111111111111112, call +49 (30) 1234567."
    assert [base[a:b] for _, a, b in personal.base_spans(base)] == ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234567"]
    known = [f"please write to user{i}@host.org today" for i in range(30)]
    rows = [*enumerate(known), (90, "please write to hidden(at)host.org today"), (91, "number 12 of 40"), (92, "é" * 9 + " a@b.cd")]
    found = {r._id: r for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[90].base == [] and [(s.kind, s.start) for s in found[90].spans] == [(0, 16)]
    assert found[91].spans == [] and (found[92].spans[0].start, found[92].spans[0].stop) == (10, 16)
    assert personal.find(odd).count() == len(ODD) and personal.find(none).count() == 0


# The forms of base identifiers, as the contract spells them.
BASE_FORMS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B9", "@", ".", "-", "%", "c.de", "1.2.3.4", "256", "0", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "+", "+49 30 ", "12345", "(0)", "é", "\n", "300.1.1.1"]), max_size=14))
def test_base_spans_equal_the_plain_forms(parts):
    text = "".join(parts)
    want = [(k, m.start(), m.end()) for k, (form, valid) in enumerate(BASE_FORMS) for m in re.finditer(form, text) if valid(m[0])]
    assert personal.base_spans(text) == want


def discovered(spark, rows):
    found = personal.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    return {r._id: [rows[r._id][s.start : s.stop] for s in r.spans if s not in r.base] for r in found}


def test_unseen_forms_do_not_speak_for_themselves(spark):
    """A context with a fifth or a third of unseen forms finds them, one with few seeds does not."""
    for seeds, unseen, expected in ((80, 20, True), (66, 33, True), (10, 100, False), (4, 1, False)):
        rows = [f"please write to user{i}@host{i}.org today" for i in range(seeds)]
        rows += [f"please write to hidden{i}(at)host{i}.org today" for i in range(unseen)]
        found = discovered(spark, rows)
        assert [bool(found[i]) for i in range(seeds, seeds + unseen)] == [expected] * unseen
        assert not any(found[i] for i in range(seeds))


def test_forms_that_fail_speak_against_their_context(spark):
    valid = [f"4{i:014d}" for i in range(300)]
    valid = [v + str(next(d for d in range(10) if luhn(v + str(d)))) for v in valid]
    fails = [v[:-1] + str((int(v[-1]) + 1) % 10) for v in valid]
    address = lambda i: f"10.0.{i % 250}.{i // 250 + 1}"
    rows = [f"card number {v} expires" for v in valid[:60]] + [f"part number {v} shipped" for v in [*valid[60:70], *fails[:200]]]
    rows += [f"host at {address(i)} is up" for i in range(40)] + ["host at 10-0-0-77 is up", "host at 10.0.0.999 is up"]
    found = discovered(spark, rows)
    by_text = {rows[i]: v for i, v in found.items()}
    assert by_text["host at 10-0-0-77 is up"] == ["10-0-0-77"] and by_text["host at 10.0.0.999 is up"] == []
    assert not any(found[i] for i in range(60, 270))


def test_mixing(spark, odd, none):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en" if i % 3 else "de", "a" if i < 400 else "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"lang": {"en": 1.0, "de": 3.0}, "source": {"b": 9.0}}
    tokens = collections.Counter()
    for i, t, lang, source in rows:
        tokens[lang, source] += len(t.split())
    out = mixing.mix(docs, weights, budget=2600, epochs=2).collect()
    used = collections.Counter()
    for r in out:
        used[r.lang, r.source] += len(r.text.split())
    # German is exhausted by two epochs and leaves the rest to English; inside that, b is
    # exhausted as well and leaves its rest to a.
    for leaf in (("de", "a"), ("de", "b"), ("en", "b")):
        assert used[leaf] == 2 * tokens[leaf]
    assert 2600 - 7 < sum(used.values()) <= 2600
    assert sorted((r.doc_id, r.epoch) for r in out) == sorted((r.doc_id, r.epoch) for r in mixing.mix(docs.repartition(7), weights, budget=2600, epochs=2).collect())
    everything = mixing.mix(odd, {"lang": {}, "source": {}}, share=1.0, epochs=1).collect()
    assert len(everything) == len(ODD) and {r.epoch for r in everything} == {0}
    assert mixing.mix(none, {"lang": {}}).count() == 0
    assert mixing.mix(docs, {"lang": {"en": 0.0}}, budget=300).filter("lang = 'en'").count() == 0


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok &lt;| &amp; <\n|im"
    rows = [
        (1, 0, "system", odd), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "user", "b"), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
        (2, 0, "user", "no reply"), (3, 1, None, "x"), (3, 1, "a\nb<|", "y"), (None, 0, "assistant", "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = collections.defaultdict(list)
    from pyspark.sql import functions as F

    read = chat.examples(df).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")
    )
    for r in read.collect():
        out[r.conv_id].append(r)
    one = sorted(out[1], key=lambda r: r.example)
    assert [r.loss for r in one] == [odd, "", ""] and [len(r.turns) for r in one] == [3, 5, 6]
    assert [tuple(t) for t in one[-1].turns] == [(role or "", text or "") for _, _, role, text in rows[:6]]
    assert one[0].formatted[one[0].loss_start : one[0].loss_end].count("<|") == 0
    assert out[2][0].loss_end is None and [tuple(t) for t in out[3][0].turns] == [("", "x"), ("a\nb<|", "y")]
    assert out[None][0].loss == "z"
    assert chat.examples(df.limit(0)).count() == 0


def test_simhash_odd_cases(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    of = {r._id: r.component_id for r in rows if r._id is not None}
    assert of[1] == of[2] == of[3] == 1 and of[7] == of[8] == 7
    assert {r.fp for r in rows if r._id in (1, 2, 3)} == {0}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6, 7, 9, 11)] + [(True, 0)]
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 38), max_size=5)), min_size=1, max_size=60), st.integers(0, 3))
def test_trie_join_equals_brute_force(flips, seed):
    centre = random.Random(seed).getrandbits(39)
    rows = set()
    for key, bits in flips:
        value = centre
        for b in bits:
            value ^= 1 << b
        rows.add((key, value))
    keys = np.array([k for k, _ in sorted(rows)], np.int64)
    rest = np.array([v for _, v in sorted(rows)], np.uint64)
    label = simhash.close_trees(keys, rest)
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if keys[i] == keys[j] and bin(int(rest[i]) ^ int(rest[j])).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    root = lambda x: root(label[x]) if label[x] != x else x
    assert [int(root(i)) for i in range(len(keys))] == [find(i) for i in range(len(keys))]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 201)]
    random.Random(1).shuffle(chain)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[i] for i in range(100, 140)} == {100} and roots[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_the_letter():
    from xxhash import xxh64

    text = "A b C d\x0be É"
    words = ["a", "b", "c", "d", "e", "É"]
    hashes = [xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == want


def test_repeat_hash_is_stable():
    assert hashlib.sha256(passages.gram_hashes(np.arange(50, dtype=np.uint64), 5).tobytes()).hexdigest()
    same = passages.gram_hashes(np.array([1, 2, 3, 9, 1, 2, 3], np.uint64), 3)
    assert same[0] == same[4] and len(set(same.tolist())) == 4
