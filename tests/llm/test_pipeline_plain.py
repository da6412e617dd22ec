"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import pytest

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = ("length", "word_length", "symbols", "repeats", "lines", "punctuation", "capitals", "variety")


def votes(text):
    """The rules' votes, or None where the base rule fails."""
    w = WORD.findall(text)
    n, chars = len(w), sum(map(len, w))
    starts = defaultdict(list)
    for i in range(n - 4):
        starts[tuple(w[i : i + 5])].append(i)
    repeat = len({i + k for at in starts.values() if len(at) > 1 for i in at for k in range(5)})
    if n < 10 or 100 * repeat > 20 * n:
        return None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = len(lines) - len(set(lines))
    symbols, upper = sum(c in "#*$%&|<>" for c in text), sum("A" <= c <= "Z" for c in text)
    marks = sum(33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 for c in text)
    say = lambda bad, good: -1 if bad else int(good)
    return (
        say(n < 15, n >= 40),
        say(chars < 3 * n or chars > 11 * n, 3.5 * n <= chars <= 9 * n),
        say(10 * symbols > chars, 50 * symbols < chars),
        say(10 * repeat > n, 50 * repeat < n),
        say(50 * dup > n, dup == 0),
        say(5 * marks > 2 * n and n >= 20, 10 * marks < 3 * n),
        say(10 * upper > 4 * chars, 10 * upper < chars),
        say(10 * len(set(w)) < n, 10 * len(set(w)) > 3 * n),
    )


def quality_rules(docs):
    said = {d["doc_id"]: votes(d["text"]) for d in docs}
    patterns = Counter(v for v in said.values() if v)
    good, rates = 0.9, [(0.98, 0.5)] * len(RULES)

    def chance(v):
        odds = math.log(good / (1 - good))
        for x, (g, b) in zip(v, rates):
            odds += math.log(g / b) if x == 1 else math.log((1 - g) / (1 - b)) if x == -1 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(15):
        p = {v: chance(v) for v in patterns}
        new = []
        for r in range(len(RULES)):
            side = lambda keep, part: sum(n * part(p[v]) for v, n in patterns.items() if keep(v[r]))  # noqa: B023, E731
            gy, gs = side(lambda x: x == 1, lambda q: q), side(lambda x: x != 0, lambda q: q)
            by, bs = side(lambda x: x == 1, lambda q: 1 - q), side(lambda x: x != 0, lambda q: 1 - q)
            new.append((round(min(max((gy + 1.96) / (gs + 2), 0.5), 0.9999), 6), round(min(max((by + 1) / (bs + 2), 0.01), 0.999), 6)))
        moved = max(abs(a - b) for x, y in zip(new, rates) for a, b in zip(x, y))
        good = round(min(max(sum(n * p[v] for v, n in patterns.items()) / sum(patterns.values()), 0.05), 0.99), 6)
        rates = new
        if moved < 1e-4:
            break
    return [d for d in docs if said[d["doc_id"]] and chance(said[d["doc_id"]]) >= 0.5]


def cut_chunks(text):
    lines = text.split("\n")
    v = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    at = lambda i: v[i] if i >= 0 else 0
    stops = [i + 1 for i in range(len(lines)) if i + 1 == len(lines) or (at(i) + 31 * at(i - 1) + 961 * at(i - 2)) % 1000003 % 4 == 0]
    full = lambda a, b: sum(bool(WORD.search(x)) for x in lines[a:b])
    kept = [b for a, b in zip([0, *stops], stops) if full(a, b) > 1]
    kept = [*kept[:-1], len(lines)]
    return [("\n".join(lines[a:b]), full(a, b) > 1) for a, b in zip([0, *kept], kept)]


def line_dedup(docs):
    seen, out = set(), []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        left = []
        for chunk, many in cut_chunks(d["text"]):
            if not (many and chunk in seen):
                left.append(chunk)
            if many:
                seen.add(chunk)
        text = "\n".join(left)
        if text == d["text"]:
            out.append(d)
        elif WORD.search(text):
            out.append({**d, "text": text, "n_chars": len(text)})
    return out


def near_dedup(docs):
    import xxhash

    def fingerprint(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {d["doc_id"]: fingerprint(d["text"]) for d in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def decontaminate(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    windows = set()
    for item in items:
        w = words(item["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for d in docs:
        w = words(d["text"])
        hit = {i + k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


def mix(docs):
    from tallybrook.llm.registered import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS

    groups = {"web": range(0, 5), "reference": range(5, 10), "forum": range(10, 15)}
    domain = lambda s: next((g for g, r in groups.items() if s in [f"src{i}" for i in r]), "code")
    size = lambda d: len(WORD.findall(d["text"]))
    leaves = defaultdict(list)
    for d in docs:
        leaves[domain(d["source"]), d["lang"], d["source"]].append(d)
    supply = {leaf: float(MIX_EPOCHS * sum(map(size, rows))) for leaf, rows in leaves.items()}

    def given(path, budget):
        """Budgets of the leaves below ``path``."""
        if len(path) == 3:
            return {path: budget}
        children = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path})
        weight = {c: list(MIX_WEIGHTS.values())[len(path)].get(c[-1], 1.0) for c in children}
        holds = {c: sum(s for leaf, s in supply.items() if leaf[: len(c)] == c) for c in children}
        full, out = set(), {}
        while True:
            rest = budget - sum(holds[c] for c in full)
            open_ = [c for c in children if c not in full]
            parts = {c: rest * weight[c] / sum(weight[x] for x in open_) for c in open_}
            more = {c for c in open_ if holds[c] <= parts[c]}
            if not more:
                break
            full |= more
        for c in children:
            out |= given(c, holds[c] if c in full else parts[c])
        return out

    total = sum(size(d) for d in docs) * MIX_SHARE
    out = []
    for leaf, budget in given((), total).items():
        rows, tokens = leaves[leaf], sum(map(size, leaves[leaf]))
        budget = math.floor(budget + 1e-6)
        whole = budget // max(tokens, 1)
        draw = lambda d: (int(hashlib.md5(f"{MIX_SEED}:{whole}:{d['doc_id']}".encode()).hexdigest()[:13], 16), str(d["doc_id"]))  # noqa: B023, E731
        upto = 0
        for d in sorted(rows, key=draw):
            upto += size(d)
            copies = min(MIX_EPOCHS, whole + (upto <= budget - whole * tokens))
            out += [(d["doc_id"], d["text"], d["n_chars"], leaf[0], e) for e in range(copies)]
    return out


def plain(docs, items):
    for stage in (quality_rules, line_dedup, near_dedup, lambda d: decontaminate(d, items)):
        docs = stage(docs)
    return docs, sorted(mix(docs))


def fixture(spark):
    """The small tables, with multi-line copies, near copies and benchmark text added."""
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rng, long = random.Random(2), [d for d in docs if d["text"].count("\n") > 5]
    for k in range(40):
        d, other = rng.choice(long), rng.choice(long)
        text = d["text"]
        if k % 4 == 1:
            text = other["text"].split("\n")[0] + "\n" + text
        elif k % 4 == 2:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif k % 4 == 3:
            text = rng.choice(items)["text"] + "\n" + text
        docs.append({**d, "doc_id": 10_000 + k, "text": text, "n_chars": len(text), "source": rng.choice(["src0", "src7", "src12", "src19"])})
    return docs, items


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_pipeline_equals_the_plain_one(spark, tmp_path):
    import corpus_pipeline

    docs, items = fixture(spark)
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    order = read("documents").columns
    spark.createDataFrame([tuple(d[c] for c in order) for d in docs], read("documents").schema).write.parquet(f"{tmp_path}/documents.parquet")
    read("benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, want = plain(docs, items)
    assert 50 < len(left) < len(docs) - 30
    got = sorted((r.doc_id, r.text, r.n_chars, r.domain, r.epoch) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
