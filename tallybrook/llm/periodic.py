"""Runs of words that repeat with a period, by a dictionary of basic factors.

The factors of length 1, 2, 4, ... of a text are named, equal factors alike; names of one
length come from pairs of names of half of it.  At length L, occurrences of a factor whose
successor is at most 2 L further on form arithmetic progressions, and their differences are
proposed as periods.  A run of period q and exponent 4 or more has such a progression at the
length L with q <= L < 2 q: by the periodicity lemma the successor of each of its factors is
exactly q further on.  Proposals are extended to maximal runs by comparing words; of those
with equal bounds the smallest period stays.

Factors that occur once take no part in longer ones, so later lengths cost little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked

LEAST_WORDS, LEAST_EXPONENT = 6, 4
PIECE = 1 << 17  # about so many words of texts are handled at a time
SLICE = 1 << 22  # bytes of a text that are words at a time
OUT_BYTES = 4_000_000  # about so much text is handed over at a time
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, as many at a time as stand in SLICE bytes."""
    start = 0
    while start < len(text):
        cut = _SEPARATOR.search(text, start + SLICE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop].split()  # on bytes: at the ASCII separators
        start = stop


def codes(text: bytes) -> np.ndarray:
    """A number per word of the text, the same for equal words."""
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(w, len(known)) for w in words], np.int32) for words in _slices(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equal keys, by position within them, and where they change in it."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.append(True, ranked[1:] != ranked[:-1]) if len(keys) else np.zeros(0, bool)


def _proposed(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places and periods that progressions of equal factors propose.

    ``edges`` are the ends of the texts that ``keys`` holds one after the other; keys of
    different texts differ.  Neighbouring places with one difference are one proposal.
    """
    total = len(keys)
    # Position of a factor's place in the arrays of its length; the places ascend.
    place, name, length = np.arange(total), keys, 1
    longest = int(np.diff(np.append(0, edges)).max(initial=0))
    while len(place) and length < max(2, longest // 2):
        order, new = _named(name)
        at = place[order]
        step = np.zeros(len(at), np.int64)  # to the successor
        step[:-1] = np.where(new[1:], 0, at[1:] - at[:-1])
        near = (step > 0) & (step <= 2 * length)
        again = near.copy()  # the successor has the same difference: three terms
        again[:-1] &= (step[:-1] == step[1:]) & near[1:]
        again[-1:] = False
        hit = np.flatnonzero(again)
        if len(hit):
            places, steps = at[hit], step[hit]
            by = np.lexsort((places, steps))
            places, steps = places[by], steps[by]
            head = np.append(True, (steps[1:] != steps[:-1]) | (places[1:] != places[:-1] + 1))
            yield from zip(places[head].tolist(), steps[head].tolist())
        # Factors of twice the length: both halves occur more than once.
        many = ~new
        many[:-1] |= ~new[1:]
        label = np.empty(len(name), np.int64)
        label[order] = np.cumsum(new) - 1
        often = np.zeros(len(name), bool)
        often[order] = many
        slot = np.full(total + length, -1, np.int64)
        slot[place[often]] = label[often]
        first = place[often]
        second = slot[first + length]
        both = second >= 0
        place, name = first[both], slot[first[both]] * (len(name) + 1) + second[both]
        # A factor that crosses the end of its text has parts of two texts.
        inside = edges[np.searchsorted(edges, place, side="right")] >= place + 2 * length
        place, name = place[inside], name[inside]
        length *= 2


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values the two have in common at their beginning."""
    done, size, most = 0, 16, min(len(a), len(b))
    while done < most:
        stop = min(done + size, most)
        differ = np.flatnonzero(a[done:stop] != b[done:stop])
        if len(differ):
            return done + int(differ[0])
        done += size
        size *= 2
    return most


def runs(keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in the texts, by start, then period.

    A run has LEAST_WORDS words and LEAST_EXPONENT periods at least, its period is its
    smallest, and no neighbouring word of its text extends it.
    """
    found: dict[tuple[int, int], int] = {}
    begins = np.append(0, edges)
    last: dict[int, int] = {}  # where the last run of a period ends
    for place, period in sorted(set(_proposed(keys, edges))):
        if place < last.get(period, 0):
            continue  # inside a run that was found
        text = int(np.searchsorted(edges, place, side="right"))
        low, high = int(begins[text]), int(edges[text])
        forward = _same(keys[place : high - period], keys[place + period : high])
        back = _same(keys[low:place][::-1], keys[low + period : place + period][::-1])
        start, length = place - back, forward + back + period
        last[period] = max(last.get(period, 0), place + forward)
        if length >= max(LEAST_WORDS, LEAST_EXPONENT * period):
            bounds = (start, length)
            found[bounds] = min(period, found.get(bounds, period))
    rows = sorted((start, period, length) for (start, length), period in found.items())
    return np.array([(s, n, p) for s, p, n in rows], np.int64).reshape(-1, 3)


def _collapsed(text: bytes, found: np.ndarray) -> bytes:
    """The words that are not dropped, joined by one space: of a run its first period stays."""
    if not len(found):
        return b" ".join(b" ".join(words) for words in _slices(text) if words)
    kept, at = [], 0
    stop = int((found[:, 0] + found[:, 1]).max())
    steps = np.zeros(stop + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    stay = np.cumsum(steps[:-1]) == 0
    for words in _slices(text):
        flags = stay[at : at + len(words)].tolist()
        kept += [w for w, f in zip(words, flags) if f] + words[len(flags) :]
        at += len(words)
    return b" ".join(kept)


def _pieces(column: pa.Array) -> Iterator[list[tuple[bytes | None, np.ndarray]]]:
    """Texts and their word numbers, as many at a time as hold about PIECE words."""
    held, words = [], 0
    for value in column:
        text = value.as_buffer().to_pybytes() if value.is_valid else None
        held.append((text, codes(text or b"")))
        words += len(held[-1][1])
        if words >= PIECE:
            yield held
            held, words = [], 0
    if held:
        yield held


def _found(coded: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each text, places counted from its first word."""
    ends = np.cumsum([len(c) for c in coded])
    sizes = [int(c.max(initial=-1)) + 1 for c in coded]
    apart = np.repeat(np.cumsum([0, *sizes[:-1]]), [len(c) for c in coded])
    rows = runs(np.concatenate(coded) + apart, ends)
    parts = np.split(rows, np.searchsorted(rows[:, 0], ends[:-1]))
    return [part - [int(end) - len(c), 0, 0] for part, end, c in zip(parts, ends, coded)]


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document, text) become (document, text, words, runs)."""
    for batch in batches:
        texts, words, found, size, first = [], [], [], 0, 0

        def done() -> pa.RecordBatch:
            steps = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found)
            triples = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(steps, pa.int32()), triples)
            columns = [batch.column(0).slice(first, len(texts)), pa.array(texts, pa.binary()), pa.array(words, pa.int64()), lists]
            return pa.RecordBatch.from_arrays(columns, names=["_doc", "_text", "n_words", "runs"])

        for piece in _pieces(batch.column(1)):
            for (text, coded), own in zip(piece, _found([coded for _, coded in piece])):
                texts.append(None if text is None else _collapsed(text, own))
                words.append(len(coded))
                found.append(own)
                size += len(text or b"")
                if size >= OUT_BYTES:
                    yield done()
                    first += len(texts)
                    texts, words, found, size = [], [], [], 0
        if texts:
            yield done()


def collapse_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period in words, by start, then
    period) and the text without the repeats: words joined by one space, of every run the
    first period only.  A word goes if any run holds it behind its first period.

    A null text stays null and has no words or runs; an empty one stays empty.  Every row is
    handled on its own, so repeated rows have equal results.  A text is held by one task with
    about 60 bytes a word.  Input columns named like an added one are replaced.
    """
    rest = others(docs, text_col, "n_words", "runs")
    rows = docs.select(packed(rest), named(text_col).cast("binary").alias("_text"))
    out = rows.mapInArrow(_detected, f"_doc {dict(rows.dtypes)['_doc']}, _text binary, n_words bigint, runs {RUNS}")
    return out.select(*unpacked(rest), F.col("_text").cast("string").alias(text_col), "n_words", "runs")
