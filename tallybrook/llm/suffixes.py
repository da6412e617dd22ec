"""Suffix-array dedup by longest-previous-factor arrays.

The suffixes of the candidate pieces are sorted, and the longest common prefixes of
neighbours in that order taken.  For every suffix the previous and the next one with a
smaller position in the corpus are found with a stack; the longer of the prefixes shared
with the two is its longest previous factor.  A window of the wanted length occurs earlier
exactly if the factor is as long, and it occurs later if it is itself such an earlier match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallybrook.llm.passages import RUN, Passage, in_shards, run_batch, without_recurring

LENGTH, GRAM = 400, 64
PLACE = 1 << 40  # a document's places are numbered from a multiple of this


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit keys, from 1."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.append(1, ranked[1:] != ranked[:-1])
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ``starts`` in the order of their suffixes' first ``length`` values, equal ones
    by number, and the common prefix of each with the one before it, at most ``length``.

    Values are below 255.  Prefix doubling: the ranks of strings of twice the size come from
    pairs of ranks; the ranks of all sizes tell how far two neighbours agree.  A suffix
    that ends before is less than all that go on.
    """
    n = len(data)
    ranks = np.append(data.astype(np.uint64) + np.uint64(1), np.zeros(length, np.uint64))
    levels, size = [(1, ranks.astype(np.uint32))], 1
    while size < 4 and size * 2 <= length:  # up to 4 values are their own key
        ranks = (ranks[: len(ranks) - size] << np.uint64(16 * size)) | ranks[size:]
        size *= 2
    if size > 1:
        ranks = _ranks(ranks)
        levels.append((size, ranks.astype(np.uint32)))
    while size * 2 <= length:
        ranks = _ranks((ranks[: len(ranks) - size] << np.uint64(32)) | ranks[size:])
        size *= 2
        levels.append((size, ranks.astype(np.uint32)))
    whole = ranks if size == length else _ranks((ranks[: len(ranks) - (length - size)] << np.uint64(32)) | ranks[length - size :])
    wanted = whole[:n][starts]
    order = np.argsort(wanted, kind="stable")
    shared = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        equal = np.flatnonzero(wanted[order[1:]] == wanted[order[:-1]]) + 1
        differ = np.setdiff1d(np.arange(1, len(starts)), equal, assume_unique=True)
        a, b = starts[order[differ - 1]].copy(), starts[order[differ]].copy()
        common = np.zeros(len(differ), np.int64)
        for size, ranked in reversed(levels):
            # A size more than once: 4 values are the next size above single ones.
            for _ in range(3 if size == 1 else 1):
                inside = (a < n) & (b < n)
                same = np.zeros(len(a), bool)
                same[inside] = ranked[a[inside]] == ranked[b[inside]]
                step = np.where(same, size, 0)
                common, a, b = common + step, a + step, b + step
        shared[differ], shared[equal] = np.minimum(common, length), length
        ends = np.minimum(n - starts[order[differ - 1]], n - starts[order[differ]])
        shared[differ] = np.minimum(shared[differ], ends)
    return order, shared


def longest_previous(position: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in their order: the longest previous factor, and whether the suffix is an
    earlier match, of ``length`` at least, of another.

    ``position`` are the suffixes' places in the corpus, ``shared`` the common prefix of each
    with the one before it.  A stack holds the suffixes whose next smaller position has not
    come yet, each with the prefix it shares with the one below, its previous smaller one.
    """
    places, common = position.tolist(), shared.tolist()
    factor, matched = [0] * len(places), [False] * len(places)
    stack: list[tuple[int, int]] = []
    for k, place in enumerate(places):
        low = common[k] if k else 0
        while stack and places[stack[-1][0]] > place:
            top, under = stack.pop()
            factor[top] = max(factor[top], low)
            matched[k] |= low >= length
            low = min(low, under)
        if stack:
            factor[k] = max(factor[k], low)
            matched[stack[-1][0]] |= low >= length
        stack.append((k, low))
    return np.array(factor, np.int64), np.array(matched, bool)


def _edges(flags: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last numbers of the runs of set flags within a text."""
    next_too = np.append(flags[1:] & (text[1:] == text[:-1]), False)
    before_too = np.append(False, next_too[:-1] & flags[:-1])
    return np.flatnonzero(flags & ~before_too), np.flatnonzero(flags & ~next_too)


def confirm(texts: list[bytes], counts: np.ndarray, docs: np.ndarray, firsts: np.ndarray, length: int) -> list[tuple[np.ndarray, ...]]:
    """Runs (text number, first and last window) of the windows that recur, and of those that
    occur earlier than in the text's first place, which is in document ``docs`` at ``firsts``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(texts)), windows)
    window = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(sizes) - sizes)[text] + window
    order, shared = suffix_order(data, starts, length)
    # Only neighbours with a common window can have a factor of that length.
    close = shared >= length
    kept = close | np.append(close[1:], False)
    chosen = order[kept]
    position = (docs[text] * PLACE + firsts[text] + window)[chosen]
    factor, matched = longest_previous(position, np.where(close, shared, 0)[kept], length)
    earlier, later = np.zeros(len(text), bool), np.zeros(len(text), bool)
    earlier[chosen] = factor >= length
    later[chosen] = matched
    out = []
    for flags in (earlier | later | (counts > 1)[text], earlier):
        first, last = _edges(flags, text)
        out.append((text[first], window[first], window[last]))
    return out


def _confirmed(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by group, document, hash and place become their runs.

    A piece that is alone in its group shares no window; it recurs as often as it was counted.
    """
    for table in in_shards(batches, p.shard_bytes):
        groups, counts = table.column("_group").to_numpy(), table.column("_n").to_numpy()
        other = np.append(True, groups[1:] != groups[:-1])
        alone = other & np.append(other[1:], True)
        copies = np.flatnonzero(alone & (counts > 1))
        sizes = pc.binary_length(table.column("_text")).to_numpy()
        yield run_batch(table, copies, np.zeros(len(copies), np.int64), sizes[copies] - p.length, np.zeros(len(copies), bool))
        rows = np.flatnonzero(~alone)
        if not len(rows):
            continue
        several = table.take(pa.array(rows)).combine_chunks()
        ids, hashes = several.column("_id").to_pylist(), several.column("_th").to_numpy()
        changed = [a != b for a, b in zip(ids[1:], ids[:-1])]
        # In the order of a group; what numbers other groups have does not matter.
        docs = np.append(0, np.cumsum((hashes[1:] != hashes[:-1]) | np.array(changed, bool)))
        found = confirm(several.column("_text").to_pylist(), counts[rows], docs, several.column("_first").to_numpy(), p.length)
        for flag, (numbers, first, last) in zip((False, True), found):
            yield run_batch(several, numbers, first, last, np.full(len(numbers), flag))


def decide(pieces: DataFrame, p: Passage) -> DataFrame:
    """Runs of recurring windows by longest previous factors; see ``passages``."""
    dealt = pieces.repartition("_group").sortWithinPartitions("_group", "_id", "_th", "_first")
    return dealt.mapInArrow(partial(_confirmed, p=p), RUN)


def remove_repeats(
    docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` without every byte that a string of ``length`` bytes covers which also starts
    anywhere else, or with ``keep_first`` which also starts earlier; see
    ``passages.without_recurring`` for the columns and odd cases.  ``options`` are further
    fields of ``Passage``."""
    wanted = Passage(length, gram, words=False, **options)
    return without_recurring(docs, wanted, decide, id_col=id_col, text_col=text_col, keep_first=keep_first)
