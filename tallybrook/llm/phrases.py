"""Substring dedup with repeated-phrase automata.

1. Recurring passages are confirmed among the pieces that share an anchor and written.
2. They are compiled into Aho-Corasick automata of bounded size, sharded by that anchor, and
   the pieces of all documents with the anchor are streamed through the shard's automaton.
   What the automaton finds is what recurs in a piece; equal pieces are streamed once.

Automata run over words: each word of a shard is one character of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.passages import RUN, Passage, in_shards, run_batch, without_recurring
from tallybrook.llm.store import written

LENGTH, GRAM = 35, 12
AUTOMATON_UNITS = 500_000  # words of the phrases in one automaton


def _letters(texts: list[bytes], known: dict[bytes, str]) -> list[str]:
    """Texts of words as strings with a character per word, the same for equal words."""

    def letter(word: bytes) -> str:
        if word not in known:
            place = len(known) + 1
            known[word] = chr(place if place < 0xD800 else place + 0x800)  # no surrogates
        return known[word]

    return ["".join(map(letter, t.split(b" "))) for t in texts]


def passages_of(texts: list[bytes], counts: list[int], length: int) -> list[bytes]:
    """The stretches of windows that occur more than once in these texts with their counts;
    the texts differ, and a text by itself has the windows it was counted with."""
    if len(texts) == 1:
        return texts if counts[0] > 1 else []
    coded = _letters(texts, {})
    seen: Counter[str] = Counter()
    for text, count in zip(coded, counts):
        for k in range(len(text) - length + 1):
            seen[text[k : k + length]] += count
    found: set[bytes] = set()
    for text, raw in zip(coded, texts):
        words, begin = None, -1
        for k in range(len(text) - length + 2):
            if k <= len(text) - length and seen[text[k : k + length]] > 1:
                begin = k if begin < 0 else begin
            elif begin >= 0:
                words = words or raw.split(b" ")
                found.add(b" ".join(words[begin : k - 1 + length]))
                begin = -1
    return sorted(found)


def _confirmed(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by group become the passages that recur in each group."""
    for table in in_shards(batches, p.shard_bytes):
        groups = table.column("_group").to_numpy()
        texts, counts = table.column("_text").to_pylist(), table.column("_n").to_pylist()
        edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
        names, phrases = [], []
        for first, stop in zip(edges, edges[1:]):
            found = passages_of(texts[first:stop], counts[first:stop], p.length)
            names += [int(groups[first])] * len(found)
            phrases += found
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(phrases, pa.binary())], names=["_group", "_text"])


def _automata(phrases: list[str]) -> Iterator:
    """Automata over the phrases, each with AUTOMATON_UNITS characters or one phrase more."""
    import ahocorasick

    machine, units = ahocorasick.Automaton(), 0
    for phrase in phrases:
        machine.add_word(phrase, len(phrase))
        units += len(phrase)
        if units >= AUTOMATON_UNITS:
            machine.make_automaton()
            yield machine
            machine, units = ahocorasick.Automaton(), 0
    if units:
        machine.make_automaton()
        yield machine


def locate(phrases: list[bytes], texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """Runs (text number, first and last window) of the windows that the phrases cover, wherever
    the automata find them in the texts."""
    known: dict[bytes, str] = {}
    patterns, coded = _letters(phrases, known), _letters(texts, known)
    steps = [[0] * (len(t) - length + 2) for t in coded]
    for machine in _automata(patterns):
        for text, marks in zip(coded, steps):
            for end, size in machine.iter(text):
                marks[end - size + 1] += 1
                marks[end - length + 2] -= 1
    found = []
    for number, marks in enumerate(steps):
        depth, begin = 0, -1
        for k, step in enumerate(marks):
            depth += step
            if depth > 0 and begin < 0:
                begin = k
            elif depth == 0 and begin >= 0:
                found.append((number, begin, k - 1))
                begin = -1
    return found


def _located(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Phrases and pieces, sorted by group, become the runs of the phrases in the pieces."""
    for table in in_shards(batches, p.shard_bytes):
        is_phrase = table.column("_phrase").to_numpy(zero_copy_only=False)
        texts = table.column("_text").to_pylist()
        pieces = np.flatnonzero(~is_phrase)
        found = locate([texts[k] for k in np.flatnonzero(is_phrase)], [texts[k] for k in pieces], p.length)
        rows = np.array(found, np.int64).reshape(-1, 3)
        yield run_batch(table, pieces[rows[:, 0]], rows[:, 1], rows[:, 2], np.zeros(len(rows), bool))


def confirmed(pieces: DataFrame, p: Passage) -> DataFrame:
    """The recurring passages (_group, _text) of each group of pieces."""
    dealt = pieces.select("_group", "_text", "_n").repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInArrow(partial(_confirmed, p=p), "_group bigint, _text binary")


def located(phrases: DataFrame, pieces: DataFrame, p: Passage) -> DataFrame:
    """Runs of windows in the pieces where an automaton finds a phrase of their group."""
    no = F.lit(0).cast("long")
    patterns = phrases.select("_group", no.alias("_sub1"), no.alias("_sub2"), "_text", F.lit(True).alias("_phrase"))
    rows = patterns.unionByName(pieces.select("_group", "_sub1", "_sub2", "_text", F.lit(False).alias("_phrase")))
    return rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(partial(_located, p=p), RUN)


def decide(pieces: DataFrame, p: Passage) -> DataFrame:
    """Runs of recurring windows by automata over confirmed passages; see ``passages``."""
    return located(written(confirmed(pieces, p), "phrases"), pieces, p)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without every word that a window of ``length`` words covers which also starts
    anywhere else; see ``passages.without_recurring`` for the columns and odd cases.
    ``options`` are further fields of ``Passage``."""
    return without_recurring(docs, Passage(length, gram, words=True, **options), decide, id_col=id_col, text_col=text_col)
