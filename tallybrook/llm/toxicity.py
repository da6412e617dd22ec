"""Toxicity by the nearest labelled examples.

1. A bounded sample of labelled documents (the examples) is drawn by a hash of the id.
2. Terms are runs of 4 to 7 characters of a word, its borders counted in, that lean to toxic
   examples.  They find inflected and compounded words as well as whole ones.  A term stands
   behind several different words, so that a group of copies makes none.
3. Every document becomes a sparse vector over the terms; an automaton reads its whole text
   once.  Terms that do not lean so among all labelled rows are dropped.  Document
   frequencies are those of all documents.
4. The examples are laid out as an inverted index in blocks, with the greatest weight of
   each term in each block.  A document's cosine with a block's examples is at most the
   product with these weights; blocks are opened in order of that bound until the k-th best
   cosine found is above all that is left.  Results are those of comparing every example.
5. Votes weigh by nearness and by what an example stands for among all labelled rows, and
   are fitted to probabilities over the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked
from tallybrook.llm.store import written

EXAMPLES = 2_000  # labelled documents of each class that are fitted to, at most
TERMS = 2_000  # at most
SIZES = (4, 5, 6, 7)
LEAST_SHARE, LEAST_CHI = 0.75, 25.0  # how far a term leans to toxic examples
LEAST_CONTEXTS = 4  # of 64 classes of words that a term stands behind
NEIGHBOURS = 15
BLOCK = 32  # examples of a block
NEAR = 0.05  # distance at which a vote has half the weight of an equal text's
PREDICTED_FROM = 0.5
SHOWN = 5  # neighbours shown as evidence
KNOWN = 50_000  # results of equal vectors that a task remembers
TASK_ROWS = 20_000  # documents that one task compares, about

_OTHER = re.compile(r"[\W\d_]+")

Vector = tuple[np.ndarray, np.ndarray]  # term numbers ascending, and their values


def letters(text: str) -> str:
    """The text in lower case, its words between single blanks, begun and ended by one."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def grams(word: str) -> set[str]:
    bordered = f" {word} "
    return {bordered[k : k + size] for size in SIZES for k in range(len(bordered) - size + 1)}


def _contexts(words: list[str]) -> dict[str, int]:
    """The grams of a text, each with the classes of the words that it stands behind."""
    from xxhash import xxh32_intdigest

    found: dict[str, int] = {}
    before = 0
    for word in words:
        for gram in grams(word):
            found[gram] = found.get(gram, 0) | (1 << before)
        before = xxh32_intdigest(word) % 64
    return found


def _text(value: pa.Scalar) -> str:
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else ""


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean, contexts = Counter(), Counter(), {}
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            words = letters(_text(text)).split()
            if label:
                found = _contexts(words)
                toxic.update(found.keys())
                for gram, classes in found.items():
                    contexts[gram] = contexts.get(gram, 0) | classes
            else:
                clean.update(set().union(*map(grams, set(words))))
        terms = list(toxic.keys() | clean.keys())
        for at in range(0, len(terms), 100_000):
            part = terms[at : at + 100_000]
            columns = [
                pa.array(part, pa.string()),
                *[pa.array([side[g] for g in part], pa.int64()) for side in (toxic, clean)],
                pa.array(np.array([contexts.get(g, 0) for g in part], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean", "contexts"])


def sample(labels: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", size: int = EXAMPLES) -> DataFrame:
    """(id, toxic, text) of ``size`` labelled documents of each class at most, chosen by a hash
    of the id.  Null ids and labels are left out; an id with both labels is toxic, of several
    texts of an id the least is taken, and of several ids of a text the least."""
    rows = labels.filter(named(id_col).isNotNull() & named(label_col).isin(0, 1))
    rows = rows.groupBy(named(id_col).alias("id")).agg(F.max(named(label_col).cast("int")).alias("toxic"))
    chosen = None
    for toxic in (0, 1):
        part = rows.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(size)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen, "toxicity-ids")
    texts = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    one = texts.join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return one.groupBy("text", "toxic").agg(F.min("id").alias("id")).select("id", "toxic", "text")


def _leaning(counts: DataFrame, toxic: float, clean: float) -> DataFrame:
    """Rows (term, t, c) with ``chi``, of terms that lean to the toxic ones of all rows."""
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    lean = (t / toxic) / (t / toxic + c / clean)
    both, none = t + c, toxic + clean - t - c
    chi = (toxic + clean) * (t * (clean - c) - c * (toxic - t)) ** 2 / (toxic * clean * both * F.greatest(none, F.lit(1.0)))
    return counts.withColumn("chi", chi).filter((lean >= LEAST_SHARE) & (F.col("chi") >= LEAST_CHI))


def terms(examples: DataFrame, *, most: int = TERMS) -> list[str]:
    """The terms that lean most to toxic examples, by chi-square, ties by the term."""
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    counts = examples.select(F.col("text").cast("binary"), "toxic").mapInArrow(_gram_counts, "term string, toxic bigint, clean bigint, contexts bigint")
    found = counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.bit_or("contexts").alias("contexts"))
    wide = found.filter(F.bit_count("contexts") >= LEAST_CONTEXTS)
    rows = _leaning(wide, float(sizes[1]), float(sizes[0])).orderBy(F.desc("chi"), "term").limit(most).select("term").collect()
    return sorted(r["term"] for r in rows)


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (document, text) become (document, terms, counts)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, term in enumerate(vocabulary):
        machine.add_word(term, number)
    if vocabulary:
        machine.make_automaton()
    for batch in batches:
        steps, numbers, counts = [0], [], []
        for text in batch.column(1):
            seen = Counter(n for _, n in machine.iter(letters(_text(text)))) if vocabulary else {}
            for number in sorted(seen):
                numbers.append(number)
                counts.append(seen[number])
            steps.append(len(numbers))
        offsets = pa.array(steps, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (numbers, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["_doc", "_terms", "_counts"])


def vectors(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(_doc, _text) as (_doc, _terms, _counts): numbers of the terms in each whole text."""
    kind = dict(rows.dtypes)["_doc"]
    return rows.select("_doc", "_text").mapInArrow(partial(_counted, vocabulary=vocabulary), f"_doc {kind}, _terms array<int>, _counts array<int>")


@dataclass
class Index:
    """Unit vectors of examples as postings by term and block, with the greatest weight of
    each term in each block."""

    ids: np.ndarray  # of the examples, in the order of the index
    toxic: np.ndarray
    share: np.ndarray  # of each class: labelled rows that an example stands for
    idf: np.ndarray
    starts: np.ndarray  # of the postings of a term in a block: term x (blocks + 1)
    places: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # term x block
    base_rate: float  # of toxic rows among those without any term
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def build(cls, examples: list[tuple[int, int, Vector]], idf: np.ndarray, totals: tuple[float, float], block: int = BLOCK) -> Index:
        """From (id, toxic, counts) of examples and the labelled rows of both classes.

        Examples with the same heaviest term are neighbours, so that bounds are tight.
        """
        sizes = np.array([max(1, sum(1 for _, y, _ in examples if y == side)) for side in (0, 1)])
        share = np.array(totals, float) / sizes
        rows, bare = [], np.zeros(2)
        for number, toxic, counts in examples:
            unit = weighted(counts, idf)
            if len(unit[0]):
                rows.append((int(unit[0][np.argmax(unit[1])]), number, toxic, unit))
            else:
                bare[toxic] += share[toxic]
        rows.sort(key=lambda r: r[:2])
        blocks = -(-len(rows) // block)
        per_term: list[list[tuple[int, float]]] = [[] for _ in idf]
        most = np.zeros((len(idf), blocks))
        for place, (_, _, _, (numbers, values)) in enumerate(rows):
            for t, w in zip(numbers.tolist(), values.tolist()):
                per_term[t].append((place, w))
                most[t, place // block] = max(most[t, place // block], w)
        places = np.array([p for one in per_term for p, _ in one], np.int64)
        begins = np.cumsum([0, *map(len, per_term)])
        edges = np.arange(blocks + 1) * block
        starts = np.array([begins[t] + np.searchsorted(places[begins[t] : begins[t + 1]], edges) for t in range(len(idf))], np.int64).reshape(len(idf), blocks + 1)
        return cls(
            np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), share, idf, starts, places,
            np.array([w for one in per_term for _, w in one]), most, float((bare[1] + 0.5) / (bare.sum() + 1)),
        )

    def _cosines(self, query: Vector, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the examples of ``blocks`` that share a term with the query.

        The terms of an example are added in their order, whatever blocks are opened."""
        first = self.starts[np.ix_(query[0], blocks)]
        sizes = self.starts[np.ix_(query[0], blocks + 1)] - first
        flat = sizes.ravel()
        at = np.repeat(first.ravel() - np.cumsum(flat) + flat, flat) + np.arange(flat.sum())
        each = np.repeat(query[1], sizes.sum(axis=1)) * self.weights[at]
        found = np.bincount(self.places[at], weights=each, minlength=len(self.ids))
        places = np.flatnonzero(found)
        return places, found[places]

    def nearest(self, query: Vector, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` examples nearest to a unit vector, the greatest
        first, ties by id; only cosines above 0, and not the example ``without``.

        The blocks with the greatest bounds are opened until ``k`` cosines are known, then
        all blocks whose bound reaches the least of these.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(query[0]) or not len(self.ids):
            return none
        bounds = query[1] @ self.most[query[0]]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        least, opened, found = -1.0, 0, none
        while opened < len(order):
            # As many blocks again as are open, or all that the least cosine leaves.
            stop = max(1, 2 * opened) if least < 0 else len(order)
            # A bound and a cosine may be rounded apart.
            stop = min(stop, int(np.searchsorted(-bounds[order], 1e-9 - least, side="right")))
            if stop <= opened:
                break
            more = self._cosines(query, np.sort(order[opened:stop]))
            places, near = (np.concatenate(x) for x in zip(found, more))
            ids = self.ids[places]
            keep = np.lexsort((ids, -near))
            keep = keep[ids[keep] != without] if without is not None else keep
            keep = keep[:k]
            found = places[keep], near[keep]
            least = float(found[1][-1]) if len(keep) == k else -1.0
            opened = stop
        return found

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic share of the votes; without neighbours that of rows without terms."""
        toxic = self.toxic[places]
        weight = self.share[toxic] / (np.maximum(0.0, 1 - cosines) + NEAR)
        prior = 1.0  # one vote at the base rate, from far away
        return float((weight @ toxic + prior * self.base_rate) / (weight.sum() + prior))

    def score(self, vote: float) -> float:
        odds = np.log(vote / (1 - vote)) if 0 < vote < 1 else np.copysign(40.0, vote - 0.5)
        return float(1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -40, 40))))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray, steps: int = 50) -> None:
        """Fits the logistic curve from votes to labels, drawn to the votes themselves."""
        if not len(votes):
            return
        odds = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
        weight = self.share[toxic] / self.share[toxic].mean()
        x = np.stack([odds, np.ones(len(odds))])
        start = values = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(values @ x, -40, 40)))
            slope = x @ (weight * (toxic - p)) - 5.0 * (values - start)
            curve = (x * (weight * p * (1 - p))) @ x.T + 5.0 * np.eye(2)
            values = values + np.clip(np.linalg.solve(curve, slope), -1, 1)
        self.slope, self.shift = max(0.1, float(values[0])), float(values[1])


def weighted(counts: Vector, idf: np.ndarray) -> Vector:
    """The unit vector of term counts, damped by their logarithm, times the rarity of terms."""
    numbers, times = np.asarray(counts[0], np.int64), np.asarray(counts[1], float)
    known = idf[numbers] > 0
    numbers = numbers[known]
    values = (1 + np.log(times[known])) * idf[numbers]
    return numbers, values / np.sqrt(values @ values) if len(values) else values


def train(examples: DataFrame, rows: DataFrame, total: int, labels: DataFrame, vocabulary: list[str]) -> Index:
    """The index of ``examples`` (id, toxic, text), with document frequencies of all ``total``
    ``rows`` (_id, _terms); terms that do not lean to toxic ones among all ``labels`` (id, toxic) weigh
    nothing."""
    each = rows.select("_id", F.explode("_terms").alias("term"))
    of_all = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    totals = {r["toxic"]: float(r["n"]) for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = F.col("toxic").cast("long")
    sides = each.join(labels, F.col("_id") == F.col("id")).groupBy("term").agg(F.sum(toxic).alias("t"), F.sum(1 - toxic).alias("c"))
    known = _leaning(sides, totals.get(1, 1.0), totals.get(0, 1.0)).select("term").collect()
    df = np.zeros(len(vocabulary))
    for r in of_all:
        df[r["term"]] = r["df"]
    idf = np.zeros(len(vocabulary))
    kept = [r["term"] for r in known]
    idf[kept] = 1 + np.log((total + 1) / (df[kept] + 1))
    texts = examples.select(F.struct("id", "toxic").alias("_doc"), F.col("text").cast("binary").alias("_text"))
    found = sorted(((r["_doc"]["id"], r["_doc"]["toxic"], (r["_terms"], r["_counts"])) for r in vectors(texts, vocabulary).collect()), key=lambda r: r[:2])
    index = Index.build(found, idf, (totals.get(0, 0.0), totals.get(1, 0.0)))
    marked = [(number, label, weighted(counts, idf)) for number, label, counts in found]
    marked = [r for r in marked if len(r[2][0])]
    votes = [index.vote(*index.nearest(unit, without=number)) for number, _, unit in marked]
    index.calibrate(np.array(votes), np.array([label for _, label, _ in marked], np.int64))
    return index


def _scored(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Rows (document, id, terms, counts) become (document, score, nearest examples)."""
    bare = index.score(index.base_rate)
    examples = set(index.ids.tolist())
    known: dict[tuple, tuple[np.ndarray, np.ndarray, float]] = {}  # of equal vectors
    for batch in batches:
        scores, steps, shown = [], [0], []
        for number, one, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            without = number if number in examples else None
            key = (tuple(one), tuple(counts), without)
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                unit = weighted((one, counts), index.idf)
                places, near = index.nearest(unit, without=without)
                known[key] = places[:SHOWN], near[:SHOWN], index.score(index.vote(places, near)) if len(unit[0]) else bare
            places, near, score = known[key]
            scores.append(score)
            shown.append((places, near))
            steps.append(steps[-1] + len(places))
        places = np.concatenate([p for p, _ in shown]) if shown else np.zeros(0, np.int64)
        near = np.concatenate([n for _, n in shown]) if shown else np.zeros(0)
        entries = pa.StructArray.from_arrays(
            [pa.array(index.ids[places]), pa.array(near), pa.array(index.toxic[places], pa.int32())], names=["doc_id", "cosine", "toxic"]
        )
        lists = pa.ListArray.from_arrays(pa.array(steps, pa.int32()), entries)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), lists], names=["_doc", "score", "evidence"])


def classify(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = EXAMPLES
) -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1), ``predicted`` (0 or 1) and
    ``evidence``: the nearest labelled examples, their cosine and label.

    ``labels`` are the rows to learn from (id, label 0 or 1; others are left out); ids are
    whole numbers.  A null text is an empty one.  A text without any term has no neighbours
    and the rate of such rows as its score; so has every text if a class has no label.
    A document is never its own neighbour.  Repeated rows are scored alike; an empty table
    has no rows.  Input columns named like an added one are replaced.
    """
    examples = written(sample(labels, docs, id_col=id_col, label_col=label_col, text_col=text_col, size=size), "toxicity-examples")
    vocabulary = terms(examples)
    rest = others(docs, text_col, "score", "predicted", "evidence")
    rows = docs.select(
        F.struct(packed(rest), named(id_col).cast("bigint").alias("id")).alias("_doc"), named(text_col).cast("binary").alias("_text")
    )
    found = written(vectors(rows, vocabulary), "toxicity-vectors")
    sides = labels.filter(named(id_col).isNotNull() & named(label_col).isin(0, 1)).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col).cast("int")).alias("toxic"))
    wanted = found.select(F.col("_doc._doc").alias("_doc"), F.col("_doc.id").alias("_id"), "_terms", "_counts")
    total = wanted.count()
    index = train(examples, wanted, total, sides, vocabulary)
    # Vectors are much smaller than texts: a task of equal bytes would compare too many.
    wanted = wanted.repartition(1 + total // TASK_ROWS)
    shown = "array<struct<doc_id: bigint, cosine: double, toxic: int>>"
    out = wanted.mapInArrow(partial(_scored, index=index), f"_doc {dict(wanted.dtypes)['_doc']}, score double, evidence {shown}")
    return out.select(*unpacked(rest), "score", predicted().alias("predicted"), "evidence")


def predicted() -> Column:
    return (F.col("score") >= PREDICTED_FROM).cast("int")
