"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad.  Its features are measures of the line and of both neighbours;
neighbouring labels attract each other by fitted weights.  Forward-backward gives every
line's chance of being good, and the document's score is their mean by line length.
The model is fitted to whole documents, each line labelled like its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked
from tallybrook.llm.passages import _BASE, _mix, _power
from tallybrook.llm.store import written

TRAIN_DOCS = 4000  # labelled documents that the model is fitted to, at most
TRAIN_LINES = 2000  # of a document that the model is fitted to, at most
STEPS = 250
PIECE_BYTES = 1 << 21  # of texts measured at a time; a longer one is measured in parts
PART_LINES = 1 << 16  # lines of a long text whose odds are taken at a time
PREDICTED_FROM = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "mark": b"!\"'()+,-./:;=?@[\\]^_`{}~",
    "bar": b"|",
    "end": b".!?",
    "shout": b"!",
}
_MASKS = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASSES.items()}
_GAP = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_TEXT = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
MEASURES = 15


# What is counted of a line, byte by byte.
COUNTED = ("chars", "n_words", "upper", "digit", "symbol", "mark", "bar", "end", "shout", "same", "bare", "length")


def _line_counts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, heads: np.ndarray, before: np.uint64 | None) -> tuple[np.ndarray, np.ndarray, np.uint64 | None]:
    """The counts of every line from ``starts`` to ``stops``, a hash of each not mixed yet, and
    the hash of the last word.

    A word is compared with the one before it, ``before`` for the first of all, but not where
    a text begins (``heads``).
    """

    def total(flags: np.ndarray, first=starts, last=stops) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[last] - sums[first]

    gap = _GAP[data]
    word_first = np.flatnonzero(~gap & np.append(True, gap[:-1])) if len(data) else np.zeros(0, np.int64)
    word_stop = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1 if len(data) else np.zeros(0, np.int64)
    power, inverse = _power(len(data) + 1)
    sums = np.append(np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)]))
    word = _mix((sums[word_stop] - sums[word_first]) * inverse[word_first])
    line = (sums[stops] - sums[starts]) * inverse[starts]
    words_upto = np.searchsorted(word_first, np.stack([starts, stops]))
    same = np.append(False, word[1:] == word[:-1])[: len(word)]
    if before is not None and len(word):
        same[0] = word[0] == before
    first_words = np.searchsorted(word_first, heads)
    same[first_words[first_words < len(word)]] = False
    bare = total(~_MASKS["symbol"][data] & ~_MASKS["mark"][data] & ~gap, word_first, word_stop) == 0
    word_total = lambda flags: total(flags, words_upto[0], words_upto[1])
    counts = [
        total(_TEXT[data] & ~gap), words_upto[1] - words_upto[0], *[total(_MASKS[k][data]) for k in COUNTED[2:9]],
        word_total(same), word_total(bare), stops - starts,
    ]
    return np.stack(counts, axis=1), line, word[-1] if len(word) else before


def _as_measures(counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """MEASURES numbers per line from its counts and whether its text had the line before."""
    of = dict(zip(COUNTED, counts.T.astype(np.float64)))
    many_chars, many_words = np.maximum(of["chars"], 1), np.maximum(of["n_words"], 1)
    share = {k: of[k] / many_chars for k in ("upper", "digit", "symbol", "mark", "bar", "shout")}
    columns = [
        np.log1p(of["chars"]), np.log1p(of["n_words"]), of["chars"] / many_words, share["upper"], share["digit"], share["symbol"], share["mark"],
        share["bar"], of["end"] / many_words, share["shout"], of["same"] / many_words,
        of["bare"] / many_words, seen & (of["n_words"] > 0), of["n_words"] == 0, np.minimum(share["symbol"] * 5, 1),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _repeated(line: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Lines that their text had before: same text and hash, and not the first of them."""
    order = np.lexsort((np.arange(len(line)), line, text_of))
    seen = np.zeros(len(line), bool)
    seen[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    return seen


def line_measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line of every text, lines per text, and length of each line.

    A text has one line more than line feeds, so an empty one has one empty line.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    stops = np.flatnonzero(data == 10)
    starts = np.append(0, stops[:-1] + 1)
    text_stops = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.append(0, np.searchsorted(stops, text_stops)))
    counts, line, _ = _line_counts(data, starts, stops, np.append(0, text_stops[:-1]), None)
    seen = _repeated(_mix(line), np.repeat(np.arange(len(texts)), per_text))
    return _as_measures(counts, seen), per_text, stops - starts


def long_counts(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of every line of one text and which lines it had before, from parts of about
    ``size`` bytes.  A word without an end in half a part counts as several."""
    held, hashes, word, start, open_line = [], [], None, 0, False
    while start < len(text) or not held:
        stop = min(start + size, len(text))
        if stop < len(text):
            ends = np.flatnonzero(_GAP[np.frombuffer(text, np.uint8, stop - start, start)])
            stop = start + int(ends[-1]) + 1 if len(ends) and ends[-1] >= size // 2 else stop
        data = np.frombuffer(text, np.uint8, stop - start, start)
        stops = np.flatnonzero(data == 10)
        starts = np.append(0, stops + 1)
        stops = np.append(stops, len(data))
        if stop < len(text) and data[-1] == 10:  # the line after it begins in the next part
            starts, stops = starts[:-1], stops[:-1]
        heads = np.zeros(0, np.int64) if held else np.zeros(1, np.int64)
        counts, line, word = _line_counts(data, starts, stops, heads, word)
        if open_line:
            upto = int(held[-1][-1, COUNTED.index("length")])
            hashes[-1][-1:] += line[:1] * np.uint64(pow(_BASE, upto, 1 << 64))
            held[-1][-1] += counts[0].astype(np.int32)
            counts, line = counts[1:], line[1:]
        if len(counts):
            held.append(counts.astype(np.int32))
            hashes.append(line.copy())
        open_line = stop < len(text) and data[-1] != 10
        start = stop
    line = _mix(np.concatenate(hashes))
    return np.concatenate(held), _repeated(line, np.zeros(len(line), np.int64))


def with_neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Measures of a line, the one before and the one after, with flags at the ends."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(per_text) - per_text] = True
    last = np.append(first[1:], True)
    before = np.where(first[:, None], 0, np.roll(x, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(x, -1, axis=0))
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))])


def marginals(odds: np.ndarray, per_text: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of a good label per line, and the expected label pairs of each text (2 by 2).

    ``odds`` are the log odds of good by the line's own features, ``pull`` the logarithms
    of the weights of label pairs.  All texts advance together, one line per step.
    """
    n_texts, factor = len(per_text), np.exp(pull)
    order = np.argsort(-per_text, kind="stable")
    begin = (np.cumsum(per_text) - per_text)[order]
    steps = int(per_text.max()) if n_texts else 0
    active = np.searchsorted(-per_text[order], -np.arange(steps), side="left")  # texts with more lines than t
    good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    own = np.stack([1 - good, good], axis=1)
    forward, backward = np.empty_like(own), np.empty_like(own)
    for t in range(steps):
        at = begin[: active[t]] + t
        now = own[at] if t == 0 else (forward[at - 1] @ factor) * own[at]
        forward[at] = now / now.sum(axis=1, keepdims=True)
    pairs = np.zeros((n_texts, 2, 2))
    for t in range(steps - 1, -1, -1):
        at = begin[: active[t]] + t
        backward[at] = 0.5
        if t + 1 < steps and active[t + 1]:
            on = at[: active[t + 1]]
            back = (own[on + 1] * backward[on + 1]) @ factor.T
            backward[on] = back / back.sum(axis=1, keepdims=True)
            both = forward[on][:, :, None] * factor * (own[on + 1] * backward[on + 1])[:, None, :]
            pairs[order[: len(on)]] += both / both.sum(axis=(1, 2), keepdims=True)
    chance = forward * backward
    return chance[:, 1] / chance.sum(axis=1), pairs


@dataclass(frozen=True)
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pull: np.ndarray

    def odds(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, per_text) @ self.weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, per_text, lengths = line_measures(texts)
        good, _ = marginals(self.odds(x, per_text), per_text, self.pull)
        weight = np.maximum(lengths, 1)
        begin = np.cumsum(per_text) - per_text
        return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)

    def long_score(self, text: bytes, size: int) -> float:
        """The score of one text of any length, measured in parts of about ``size`` bytes."""
        counts, seen = long_counts(text, size)
        n, odds = len(counts), []
        for low in range(0, n, PART_LINES):
            high = min(low + PART_LINES, n)
            first, stop = max(0, low - 1), min(n, high + 1)  # with both neighbours
            x = _as_measures(counts[first:stop], seen[first:stop])
            full = with_neighbours((x - self.mean) / self.scale, np.array([stop - first]))[low - first : high - first]
            odds.append(full @ self.weights)
        good, _ = marginals(np.concatenate(odds), np.array([n]), self.pull)
        weight = np.maximum(counts[:, COUNTED.index("length")], 1)
        return float((good @ weight) / weight.sum())


def fit(texts: list[tuple[np.ndarray, int]], steps: int = STEPS) -> Field:
    """The field that makes the labels likeliest, from (line measures, label) of documents.

    Gradient steps with momentum by coordinate; a document counts with the root of its
    lines, and weights are drawn to zero.  Without documents every line is even.
    """
    size = 3 * MEASURES + 3
    if not texts:
        return Field(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(size), np.zeros((2, 2)))
    x = np.concatenate([m for m, _ in texts])
    per_text = np.array([len(m) for m, _ in texts])
    label = np.array([y for _, y in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    full = with_neighbours((x - mean) / scale, per_text)
    of_line = np.repeat(np.arange(len(texts)), per_text)
    weight = 1 / np.sqrt(per_text)
    weight /= (weight * per_text).sum()
    seen = np.zeros((len(texts), 2, 2))
    seen[np.arange(len(texts)), label, label] = per_text - 1
    values = np.zeros(size + 4)
    drift, spread = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        pull = values[size:].reshape(2, 2)
        good, pairs = marginals(full @ values[:size], per_text, pull)
        slope = full.T @ ((label[of_line] - good) * weight[of_line])
        slope_pull = ((seen - pairs) * weight[:, None, None]).sum(axis=0)
        gradient = np.append(slope, slope_pull.ravel()) - 1e-3 * values
        drift = 0.9 * drift + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        values = values + 0.05 * (drift / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, values[:size], values[size:].reshape(2, 2))


def _raw(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [line_measures([t])[0].tobytes() for t in _raw(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["measures", "label"])


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", steps: int = STEPS) -> Field:
    """Fits the field to ``labelled``, a sample of bounded size; null labels are left out."""
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(text_col), F.col(label_col).cast("int").alias("label"))
    found = rows.mapInArrow(_measured, "measures binary, label int").collect()
    texts = [(np.frombuffer(bytes(r["measures"]), np.float64).reshape(-1, MEASURES), r["label"]) for r in found]
    return fit(sorted(texts, key=lambda t: (t[1], len(t[0]), t[0].tobytes())), steps)


def sample(labels: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", size: int = TRAIN_DOCS) -> DataFrame:
    """``size`` labelled documents at most, chosen by a hash of the id; of these, the ones with
    no more than TRAIN_LINES lines."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).alias("label"))
    chosen = written(chosen.orderBy(F.xxhash64(id_col), id_col, "label").limit(size), "crf-sample")
    short = F.size(F.split(F.coalesce(named(text_col).cast("string"), F.lit("")), "\n")) <= TRAIN_LINES
    return docs.select(id_col, text_col).join(chosen, id_col).filter(short).select(text_col, "label")


def _scored(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, scores = _raw(batch.column(1)), []
        start = 0
        while start < len(texts):
            if len(texts[start]) >= PIECE_BYTES:
                scores.append([field.long_score(texts[start], PIECE_BYTES)])
                start += 1
                continue
            stop, size = start, 0
            while stop < len(texts) and len(texts[stop]) < PIECE_BYTES and (stop == start or size + len(texts[stop]) < PIECE_BYTES):
                size += len(texts[stop])
                stop += 1
            scores.append(field.scores(texts[start:stop]))
            start = stop
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["_doc", "score"])


def classify(docs: DataFrame, field: Field, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score`` (0 to 1) and ``predicted`` (0 or 1).

    A null text is an empty one, which is scored as one empty line; a long text is measured in
    parts, with the same result (but for words of megabytes).  Every row is scored
    on its own; input columns named like an added one are replaced.
    """
    rest = others(docs, text_col, "score", "predicted")
    rows = docs.select(packed(rest), named(text_col))
    out = rows.mapInArrow(partial(_scored, field=field), f"_doc {dict(rows.dtypes)['_doc']}, score double")
    return out.select(*unpacked(rest), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
