"""Passages of a fixed length that occur more than once, over all documents.

A document is a sequence of units (words or bytes).  Every window of ``length`` units picks
an anchor: the gram of ``gram`` units in it with the smallest hash, the leftmost of equals.
The choice depends on the window's content only, so equal windows have equal anchors, and
runs of neighbouring windows that share one anchor form a segment.  Equal segments that
follow one another in a document are one row from the start.

1. Segments are marked by anchor and a digest of their text, and counted by anchor over all
   documents.  An anchor seen once ends here.
2. Segments are cut out (one for all where those of an anchor are equal), and equal ones
   become one row with a count, so that a group of copies is one row however large it is.
   The different pieces of a group are decided together in one task (the ``decide``
   function of an operator).
3. The pieces of groups with more than ``group_bytes`` are split first: the windows of a piece
   are dealt into a few ranges by their distance from the anchor, and what the windows of a
   range have in common makes the new group.  Equal pieces become one row again.  This goes
   on until every group is small, at the latest when a range is one window and all pieces of
   a group are equal; so no task holds a group without bound, and a piece becomes a few rows
   where it differs from others, never one for each window.
4. Recurring windows go back to the documents as spans of units.

Equal segments, pieces and ranges are those with equal 128-bit digests; what recurs among
different pieces is decided by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked
from tallybrook.llm.store import written

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACE_BITS = 18  # of an order key: the gram's place in its part of the text; the others are its hash
PIECE = 1 << 17  # windows handled at a time
CUT_BYTES = 32_000_000  # about so much text of segments is handed over at a time
ROWS = 100_000  # about so many rows are handed over at a time
SPLIT = 8  # ranges that the windows of a piece are dealt into

#: From the different pieces of groups (_group, _sub1, _sub2, _text, _n, _id, _th, _first), the
#: runs of recurring windows in them (_group, _sub1, _sub2, _from, _to, _earlier).
Decide = Callable[[DataFrame, "Passage"], DataFrame]
RUN = "_group bigint, _sub1 bigint, _sub2 bigint, _from bigint, _to bigint, _earlier boolean"


@dataclass(frozen=True)
class Passage:
    """What is looked for: windows of ``length`` units with anchors of ``gram`` units."""

    length: int
    gram: int
    words: bool  # units are words, else bytes
    shard_bytes: int = 500_000  # of different pieces decided at a time
    group_bytes: int = 250_000  # of different pieces of one group; they are split beyond

    def units(self, text: bytes) -> tuple[np.ndarray, list[bytes] | bytes]:
        """A 64-bit value per unit, and the units."""
        if not self.words:
            return _BYTE_VALUES[np.frombuffer(text, np.uint8)], text
        from xxhash import xxh3_64_intdigest

        words = text.split()  # on bytes: at the ASCII separators
        return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)), words

    def apart(self, text: bytes) -> list[bytes] | bytes:
        """The units alone."""
        return text.split() if self.words else text

    def cut(self, units: list[bytes] | bytes, first: int, end: int) -> bytes:
        return b" ".join(units[first:end]) if self.words else units[first:end]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(1 << n.bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of ``size`` values, from running sums of PIECE values or a gram."""
    n, most = len(values), max(PIECE, 2 * size)
    if n > most:
        step = most - size + 1
        return np.concatenate([gram_hashes(values[k : k + most], size) for k in range(0, n - size + 1, step)])
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def segments(values: np.ndarray, p: Passage) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window of each segment of one document."""
    found = []
    place = np.uint64((1 << PLACE_BITS) - 1)
    for start in range(0, len(values) - p.length + 1, PIECE):
        piece = values[start : start + PIECE + p.length - 1]
        hashes = gram_hashes(piece, p.gram)
        keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_sliding_min(keys, p.length - p.gram + 1) & place).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:], len(anchor)) - 1
        found.append((hashes[anchor[first]].view(np.int64), first + start, last + start))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def runs(values: np.ndarray, units: list[bytes] | bytes, p: Passage) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``segments`` with equal ones that follow one another as one: anchor hash, first and
    last window of the first of them, and how many they are.

    In a text with a period shorter than a window every period is a segment.
    """
    anchor, first, last = segments(values, p)
    width = last - first + 1
    same = np.zeros(len(anchor) + 1, bool)  # as the one before
    same[1:-1] = (anchor[1:] == anchor[:-1]) & (width[1:] == width[:-1])
    begins, ends = np.flatnonzero(same[1:] & ~same[:-1]) + 1, np.flatnonzero(same[:-1] & ~same[1:])
    for a, b in zip(begins.tolist(), ends.tolist()):
        w, low = int(width[a]), int(first[a - 1])
        piece = values[low : last[b] + p.length]
        equal = np.append(0, np.cumsum(piece[w:] == piece[:-w]))
        at, size = first[a - 1 : b] - low, w + p.length - 1
        same[a : b + 1] = equal[at + size] - equal[at] == size
        if p.words:  # values of words are hashes
            for k in np.flatnonzero(same[a : b + 1]).tolist():
                start = low + int(at[k])
                same[a + k] = units[start : start + size] == units[start + w : start + w + size]
    head = ~same[:-1]
    return anchor[head], first[head], last[head], np.bincount(np.cumsum(head) - 1, minlength=int(head.sum()))


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _digest(text: bytes) -> bytes:
    return blake2b(text, digest_size=16).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """Digests as two columns of whole numbers, which aggregate without objects."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)]


def _marked(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Rows (document, hash, text) become a row per segment."""
    for batch in batches:
        rows, parts, digests, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            row = pa.array(np.concatenate(rows))
            anchor, first, last, times = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
            columns = [batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, (anchor, first, last - first + 1, times))]
            return pa.RecordBatch.from_arrays([*columns, *_halves(digests)], names=["_id", "_th", "_anchor", "_first", "_windows", "_times", "_s1", "_s2"])

        for row, text in enumerate(batch.column(2)):
            values, units = p.units(_bytes(text))
            found = runs(values, units, p)
            if not len(found[0]):
                continue
            rows.append(np.full(len(found[0]), row))
            parts.append(found)
            digests += [_digest(p.cut(units, a, b + p.length)) for a, b in zip(found[1].tolist(), found[2].tolist())]
            size += len(found[0])
            if size >= ROWS:
                yield done()
                rows, parts, digests, size = [], [], [], 0
        if rows:
            yield done()


def _cut_segments(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Rows (document, hash, text, segments) become a row per segment with its text, in
    batches of about CUT_BYTES."""
    for batch in batches:
        rows, parts, texts, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            row = pa.array(rows, pa.int32())
            wanted = pa.array(parts, batch.schema.field(3).type.value_type)
            columns = [batch.column(0).take(row), batch.column(1).take(row), wanted, pa.array(texts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "_part", "_text"])

        for row, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3))):
            units = p.apart(_bytes(text))
            for part in wanted.as_py():
                first = part["_first"]
                rows.append(row)
                parts.append(part)
                texts.append(p.cut(units, first, first + part["_windows"] + p.length - 1))
                size += len(texts[-1])
                if size >= CUT_BYTES:
                    yield done()
                    rows, parts, texts, size = [], [], [], 0
        if rows:
            yield done()


def in_shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """Rows sorted by ``_group`` as tables of whole groups of about ``shard_bytes`` of ``_text``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= shard_bytes:
            table = pa.Table.from_batches(held)
            groups = table.column("_group").to_numpy()
            # Whole groups up to the last one, which may go on; several shards if the batch is large.
            edge = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if groups[0] != groups[-1] else 0
            starts = np.flatnonzero(np.append(True, groups[1:edge] != groups[: edge - 1])) if edge else np.zeros(0, np.int64)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(table.column("_text")), 0).to_numpy()[:edge])
            at = 0
            while at < edge:
                target = (sizes[at - 1] if at else 0) + shard_bytes
                stop = int(np.searchsorted(sizes, target)) + 1
                later = starts[starts >= min(stop, edge)]
                stop = int(later[0]) if len(later) else edge
                yield table.slice(at, stop - at).combine_chunks()
                at = stop
            held = table.slice(edge).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_batch(table: pa.Table, numbers: np.ndarray, first: np.ndarray, last: np.ndarray, earlier: np.ndarray) -> pa.RecordBatch:
    """Runs of windows in the pieces with these row numbers of ``table``."""
    row = pa.array(numbers, pa.int64())
    keys = [table.column(c).combine_chunks().take(row) for c in ("_group", "_sub1", "_sub2")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(earlier, pa.bool_())], names=["_group", "_sub1", "_sub2", "_from", "_to", "_earlier"])


def anchor_place(values: np.ndarray, p: Passage) -> int:
    """Where the anchor of a segment's windows begins."""
    keys = gram_hashes(values[: p.length], p.gram) >> np.uint64(PLACE_BITS)
    return int(np.argmin(keys))


def _split(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Pieces with windows from ``_low`` to ``_high`` units before their anchor become one
    piece for each part of that range in which they have windows.

    ``_at`` is the place of the anchor in the piece, -1 if not known yet; the windows of a part
    all hold the units from its lowest window's first to its highest one's last, the core.
    """
    names = ["_anchor", "_s1", "_s2", "_low", "_high", "_shift", "_at", "_n", "_id", "_th", "_first"]
    for batch in batches:
        kept = batch.column("_id"), batch.column("_th"), batch.column("_anchor"), batch.column("_s1"), batch.column("_s2"), batch.column("_n")
        rows, numbers, digests, groups, texts, size = [], [], [], [], [], 0

        def done() -> pa.RecordBatch:
            row = pa.array(rows, pa.int32())
            table = np.array(numbers, np.int64).reshape(-1, 5)
            low, high, shift, at, first = (pa.array(np.ascontiguousarray(table[:, k])) for k in range(5))
            id_, th, anchor, s1, s2, n = (c.take(row) for c in kept)
            columns = [anchor, s1, s2, low, high, shift, at, n, id_, th, first, *_halves(digests), pa.array(groups, pa.int64()), pa.array(texts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "_sub1", "_sub2", "_group", "_text"])

        columns = [batch.column(c).to_pylist() for c in ("_anchor", "_low", "_high", "_shift", "_at", "_first")]
        for row, (text, anchor, low, high, shift, at, first) in enumerate(zip(batch.column("_text"), *columns)):
            raw = _bytes(text)
            if at < 0:
                values, units = p.units(raw)
                at = anchor_place(values, p)
            else:
                units = p.apart(raw)
            step = -(-(high - low + 1) // SPLIT)
            for a in range(low, high + 1, step):
                b = min(a + step - 1, high)
                begin, end = max(0, at - b), min(len(units) - p.length, at - a)
                if begin > end:
                    continue
                piece = p.cut(units, begin, end + p.length)
                core = p.cut(units, at - a, at - b + p.length)
                mark = blake2b(core, digest_size=8, key=f"{anchor}:{a}:{b}".encode()).digest()
                rows.append(row)
                numbers.append((a, b, shift + begin, at - begin, first + begin))
                digests.append(_digest(piece))
                groups.append(int.from_bytes(mark, "little", signed=True))
                texts.append(piece)
                size += len(piece)
            if size >= CUT_BYTES:
                yield done()
                rows, numbers, digests, groups, texts, size = [], [], [], [], [], 0
        if rows:
            yield done()


def _place() -> Column:
    return F.struct("_id", "_th", "_first")


def _decided(pieces: DataFrame, p: Passage, decide: Decide) -> DataFrame:
    """Runs of recurring windows per segment (_anchor, _s1, _s2, _from, _to, _earlier).

    ``_earlier`` runs are those with an earlier place than the segment's first, in documents by
    id and hash; the others have any other place.
    """
    kind = dict(pieces.dtypes)["_id"]
    split = (
        f"_anchor bigint, _s1 bigint, _s2 bigint, _low bigint, _high bigint, _shift bigint, _at bigint, _n bigint, _id {kind}, _th bigint, "
        "_first bigint, _sub1 bigint, _sub2 bigint, _group bigint, _text binary"
    )
    span = p.length - p.gram
    current = pieces.select(
        "_anchor", "_s1", "_s2", F.lit(0).cast("long").alias("_low"), F.lit(span).cast("long").alias("_high"), F.lit(0).cast("long").alias("_shift"),
        F.lit(-1).cast("long").alias("_at"), "_n", "_id", "_th", "_first", F.col("_s1").alias("_sub1"), F.col("_s2").alias("_sub2"),
        F.col("_anchor").alias("_group"), "_text",
    )
    found, key = None, ["_group", "_sub1", "_sub2"]
    while True:
        current = written(current, "pieces")
        different = current.withColumn("_at_first", _place())
        if found is not None:  # before, every piece is a segment of its own
            different = different.groupBy(*key).agg(
                F.first("_text").alias("_text"), F.sum("_n").alias("_n"), F.min("_at_first").alias("_at_first"), F.max("_high").alias("_high"), F.max("_low").alias("_low")
            )
            different = written(different, "different-pieces")
        different = different.select(*key, "_text", "_n", "_at_first.*", (F.col("_high") > F.col("_low")).alias("_wide"))
        sizes = different.groupBy("_group").agg(F.sum(F.length("_text")).alias("_bytes"), F.count(F.lit(1)).alias("_pieces"), F.bool_and("_wide").alias("_wide"))
        more = written(sizes.filter((F.col("_bytes") > p.group_bytes) & (F.col("_pieces") > 1) & F.col("_wide")).select("_group"), "large-groups")
        last = more.isEmpty()
        ready = different.drop("_wide") if last else different.drop("_wide").join(more, "_group", "left_anti")
        runs = written(decide(ready, p), "runs")
        mine = current.select("_anchor", "_s1", "_s2", "_shift", *key, _place().alias("_own"))
        first = different.select(*[F.col(c).alias(f"_of{c}") for c in key], _place().alias("_at_first"))
        same = [F.col(c) == F.col(f"_of{c}") for c in key]
        at = mine.join(runs, key).join(first, same) if found is not None else mine.join(runs, key).withColumn("_at_first", F.col("_own"))
        # Where the piece's first place is another segment's, all its recurring windows are later copies.
        is_first = F.col("_own").eqNullSafe(F.col("_at_first"))
        flags = F.when(F.col("_earlier"), F.when(is_first, F.array(F.lit(True)))).otherwise(
            F.when(is_first, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        )
        part = at.select(
            "_anchor", "_s1", "_s2", (F.col("_from") + F.col("_shift")).alias("_from"), (F.col("_to") + F.col("_shift")).alias("_to"), F.explode(flags).alias("_earlier")
        )
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        current = current.join(more, "_group", "left_semi").mapInArrow(partial(_split, p=p), split)


def recurring_spans(docs: DataFrame, p: Passage, decide: Decide, *, id_col: str, text_col: str, keep_first: bool = False) -> DataFrame:
    """``_span_id``, ``_span_th`` and ``_spans``: per document the runs (first, last window)
    of windows that occur more than once, in any order, in unit numbers from 0.

    With ``keep_first`` only windows with an earlier occurrence, in documents by id (null
    first), then by hash of the text, and by place in a document.
    """
    id_, text = named(id_col), named(text_col)
    rows = docs.select(id_.alias("_id"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    segment = "_anchor bigint, _first bigint, _windows bigint, _times bigint, _s1 bigint, _s2 bigint"
    marks = written(rows.mapInArrow(partial(_marked, p=p), f"_id {kind}, _th bigint, {segment}"), "segments")
    differ = (F.min("_s1") != F.max("_s1")) | (F.min("_s2") != F.max("_s2"))
    anchors = marks.groupBy("_anchor").agg(F.sum("_times").alias("_n"), differ.alias("_differ"))
    # Written, as adaptive execution splits a hot key only where both sides come from a shuffle.
    anchors = written(anchors.filter("_n > 1").select("_anchor", "_differ"), "anchors")
    hits = written(marks.join(anchors, "_anchor"), "hits")

    # Of equal segments one is cut out, for all of them; of different ones all are.
    seg = ["_anchor", "_s1", "_s2"]
    equal = hits.filter(~F.col("_differ")).groupBy(*seg, "_windows").agg(F.min(_place()).alias("_at_first"), F.sum("_times").alias("_times"))
    cut = ["_id", "_th", "_anchor", "_first", "_windows", "_times", "_s1", "_s2"]
    asked = hits.filter("_differ").select(*cut).unionByName(equal.select("_at_first.*", "_anchor", "_windows", "_times", "_s1", "_s2").select(*cut))
    part = F.struct(*cut[2:])
    wanted = asked.groupBy(F.col("_id").alias("_hit_id"), F.col("_th").alias("_hit_th")).agg(F.collect_set(part).alias("_parts"))
    texts = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_th") == F.col("_hit_th"))).select("_id", "_th", "_text", "_parts")
    texts = texts.mapInArrow(partial(_cut_segments, p=p), f"_id {kind}, _th bigint, _part {dict(texts.dtypes)['_parts'][6:-1]}, _text binary")
    found = texts.select("_id", "_th", "_part.*", "_text")
    found = written(found, "segment-texts") if keep_first else found  # read twice then
    pieces = found.groupBy(*seg).agg(F.first("_text").alias("_text"), F.sum("_times").alias("_n"), F.min(_place()).alias("_at_first"))
    runs = written(_decided(pieces.select(*seg, "_text", "_n", "_at_first.*"), p, decide), "segment-runs")

    at = hits.drop("_differ").join(runs, seg)
    # A segment that follows itself recurs as a whole, so its windows are 0 to _to.
    repeats = (F.col("_times") - 1) * (F.col("_to") + 1)
    if keep_first:
        places = found.groupBy(*seg).agg(F.min(_place()).alias("_at_first"))
        at = at.join(places, seg).filter(F.col("_earlier") == _place().eqNullSafe(F.col("_at_first")))
        whole = (F.col("_first") + F.col("_windows") * F.col("_times") - 1).alias("last")
        again = hits.filter("_times > 1").select("_id", "_th", F.struct((F.col("_first") + F.col("_windows")).alias("first"), whole).alias("_span"))
        repeats = F.lit(0)
    else:
        at = at.filter(~F.col("_earlier"))
    last = F.col("_first") + F.col("_to") + repeats
    spans = at.select("_id", "_th", F.struct((F.col("_first") + F.col("_from")).alias("first"), last.alias("last")).alias("_span"))
    spans = spans.unionByName(again) if keep_first else spans
    return spans.groupBy(F.col("_id").alias("_span_id"), F.col("_th").alias("_span_th")).agg(F.collect_set("_span").alias("_spans"))


def _removed(p: Passage, n: int, spans: list[dict]) -> np.ndarray:
    """Which of ``n`` units are covered by windows of the spans."""
    steps = np.zeros(n + 1, np.int64)
    for s in spans:
        steps[s["first"]] += 1
        steps[min(n, s["last"] + p.length)] -= 1
    return np.cumsum(steps[:n]) > 0


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _without(batches: Iterator[pa.RecordBatch], p: Passage) -> Iterator[pa.RecordBatch]:
    """Rows (document, text, spans) become (document, text, units, removed, spans)."""
    for batch in batches:
        texts, counts = [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw = _bytes(text)
            spans = spans.as_py() or []
            if p.words:
                starts, ends = _word_bounds(raw)
                gone = _removed(p, len(starts), spans)
                data = np.frombuffer(raw, np.uint8)
                # A removed word goes with what stands before it, up to the word before.
                steps = np.zeros(len(raw) + 1, np.int64)
                np.add.at(steps, np.append(0, ends[:-1])[gone] if len(starts) else [], 1)
                np.add.at(steps, ends[gone] if len(starts) else [], -1)
                kept = data[np.cumsum(steps[:-1]) == 0].tobytes() if gone.any() else raw
            else:
                gone = _removed(p, len(raw), spans)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0]))
            texts.append(kept if text.is_valid else None)
            counts.append((len(gone), int(gone.sum()), runs))
        columns = zip(*counts) if counts else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()), *[pa.array(c, pa.int64()) for c in columns]],
            names=["_doc", "_text", "n_units", "n_removed", "n_spans"],
        )


def without_recurring(docs: DataFrame, p: Passage, decide: Decide, *, id_col: str, text_col: str, keep_first: bool = False) -> DataFrame:
    """``docs`` with recurring windows cut from the text (binary, as bytes may break a
    character) and the counts ``n_units``, ``n_removed``, ``n_spans``.

    A null text stays null and counts no units.  Repeated rows are documents of their own,
    so what they hold recurs; with ``keep_first`` rows that agree in id and text are one
    document and keep what it keeps.  Input columns named like a count are replaced.
    """
    spans = recurring_spans(docs, p, decide, id_col=id_col, text_col=text_col, keep_first=keep_first)
    counts = ["n_units", "n_removed", "n_spans"]
    rest = others(docs, text_col, *counts)
    text = named(text_col)
    rows = docs.select(named(id_col).alias("_id"), F.xxhash64(text).alias("_th"), packed(rest), text.cast("binary").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_th") == F.col("_span_th"))
    joined = rows.join(spans, same, "left").select("_doc", "_text", "_spans")
    out = joined.mapInArrow(
        partial(_without, p=p), f"_doc {dict(joined.dtypes)['_doc']}, _text binary, n_units bigint, n_removed bigint, n_spans bigint"
    )
    return out.select(*unpacked(rest), F.col("_text").alias(text_col), *counts)
