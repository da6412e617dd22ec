"""Benchmark decontamination: windows of training words looked up in a broadcast hash set.

Words are lower-cased ASCII letters, digits and everything beyond ASCII.  A benchmark item
gives one window per position (an item shorter than a window is one window itself).  The
set is broadcast in blocks of a fixed size, so any benchmark works; each block costs one
pass over the documents.  A hit on the hash is verified word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, packed, unpacked
from tallybrook.llm.store import written
from tallybrook.llm.words import lower_ascii

# What separates words (A-Z belong to words, as they are lower-cased), and words.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 13
BLOCK_BYTES = 32_000_000  # of windows in one broadcast set


def cased_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def _lowered(words: Column) -> Column:
    return F.transform(words, lower_ascii)


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``_h<length>`` for each length: a hash per window of ``_words``, in order.

    A window's hash comes from the hashes of its two halves, which may overlap, so that
    each doubling of the length is one pass.  Words are hashed in full lower case, which is
    quick; what differs outside A-Z is told apart when a hit is verified.
    """
    df = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))
    made = {1}

    def step(df: DataFrame, length: int) -> DataFrame:
        if length in made:
            return df
        half = 1 << (length - 1).bit_length() - 1  # largest power of two below
        df = step(df, half)
        part, n = f"_h{half}", F.size("_words") - F.lit(length)
        halves = F.when(
            n >= 0,
            F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.get(part, i), F.get(part, i + (length - half)), F.lit(length))),
        ).otherwise(F.array().cast("array<bigint>"))
        made.add(length)
        return df.withColumn(f"_h{length}", halves)

    for length in lengths:
        df = step(df, length)
    return df


def windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per item and distinct window: ``_hash``, ``_length``, ``_window``, ``_item``."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), cased_words(F.col(text_col)).alias("_words"))
    items = items.withColumn("_words", _lowered(F.col("_words")))
    items = items.filter(F.size("_words") > 0).withColumn("_length", F.least(F.size("_words"), F.lit(window)))
    cut = items.select(
        "_item",
        "_length",
        F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("_length") + 1), lambda i: F.slice("_words", i, F.col("_length")))).alias("_words"),
    ).distinct()
    lengths = list(range(1, window + 1))
    hashed = with_hashes(cut, lengths)
    choice = F.coalesce(*[F.when(F.col("_length") == k, F.get(f"_h{k}", F.lit(0))) for k in lengths])
    return hashed.select(choice.alias("_hash"), "_length", F.array_join("_words", " ").alias("_window"), "_item")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: id, ``_text_hash``, ``n_words``, ``n_hit``, ``items`` (sorted item ids
    as text), ``spans`` (sorted first and last word, from 0, of every verified window).

    A null text has no words; rows with equal id and text are one document; items without
    words and a null item id (read as an empty one) do no harm; an empty benchmark hits
    nothing.
    """
    found = written(windows(benchmark, item_col, item_text_col, window).fillna("", ["_item"]), "decontamination-windows")
    size = found.agg(
        F.sum(F.octet_length("_window") + F.octet_length("_item") + 64).alias("bytes"),
        F.sort_array(F.collect_set("_length")).alias("lengths"),
    ).first()
    lengths = size["lengths"] or [window]
    blocks = max(1, math.ceil((size["bytes"] or 0) / block_bytes))
    keyed = docs.select(
        F.col(id_col).alias(id_col),
        F.xxhash64(text_col).alias("_text_hash"),
        cased_words(F.col(text_col)).alias("_words"),
    )
    hashed = with_hashes(keyed, lengths)
    # Place 0 stands for the document itself; then come the windows, length by length.
    all_hashes = F.concat(F.array(F.lit(None).cast("bigint")), *[F.col(f"_h{k}") for k in lengths])
    placed = hashed.select(
        id_col, "_text_hash", "_words", F.size("_words").cast("long").alias("n_words"), F.posexplode_outer(all_hashes).alias("_at", "_hash")
    )
    before = F.lit(1)
    offsets = []
    for k in lengths:
        offsets.append(F.when(F.col("_length") == k, before))
        before = before + F.greatest(F.col("n_words") - F.lit(k - 1), F.lit(0))
    # No lambdas from here to the filter: then one generated loop makes the window rows, looks
    # them up and drops them, and none is built that is not a hit.
    parts = []
    for block in range(blocks):
        here = found.filter(F.pmod("_hash", F.lit(blocks)) == block)
        joined = placed.join(F.broadcast(here), "_hash", "left")
        start = (F.col("_at") - F.coalesce(*offsets)).cast("int")
        hit = F.col("_item").isNotNull() & (
            lower_ascii(F.array_join(F.slice("_words", start + 1, F.col("_length")), " ")) == F.col("_window")
        )
        parts.append(
            joined.withColumn("_hit", hit)
            .filter((F.col("_at") == 0) | F.col("_hit"))
            .select(
                id_col, "_text_hash", "n_words",
                F.when(F.col("_hit"), F.struct(start.alias("first"), (start + F.col("_length") - 1).alias("last"))).alias("_span"),
                F.when(F.col("_hit"), F.col("_item")).alias("_item"),
            )
        )
    hits = parts[0]
    for other in parts[1:]:
        hits = hits.unionByName(other)
    spans = F.array_sort(F.collect_set("_span"))
    return (
        hits.groupBy(id_col, "_text_hash", "n_words")
        .agg(spans.alias("spans"), F.array_sort(F.collect_set("_item")).alias("items"))
        .withColumn("n_hit", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))).cast("long"))
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words in ``spans``; what stands between words stays."""
    edge = f"(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD})"
    pieces = F.filter(F.split(text, edge), lambda p: p != "")
    flagged = F.transform(pieces, lambda p: F.struct(p.alias("p"), p.rlike(WORD).alias("is_word")))
    first_is_word = F.get(flagged, F.lit(0))["is_word"]
    number = lambda k: F.when(first_is_word, (k / 2).cast("int")).otherwise(((k - 1) / 2).cast("int"))
    kept = F.filter(flagged, lambda x, k: ~x["is_word"] | ~F.exists(spans, lambda s: number(k).between(s["first"], s["last"])))
    return F.array_join(F.transform(kept, lambda x: x["p"]), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or with their benchmark spans cut out.

    ``remove="documents"`` drops documents of which a twentieth or more of the words are
    hit; ``remove="spans"`` keeps every document and removes the hit words of all of them.
    """
    rows = docs.select(packed(docs.columns), named(id_col).alias("_id"), named(text_col).alias("_text"))
    report = scan(rows, benchmark, id_col="_id", text_col="_text", **options)
    wanted = contaminated() if remove == "documents" else F.col("n_hit") > 0
    hit = report.filter(wanted).select(F.col("_id").alias("_hit_id"), F.col("_text_hash").alias("_hit_th"), F.col("spans").alias("_spans"))
    hit = written(hit, "decontamination-hits")
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("_text") == F.col("_hit_th"))
    columns = dict(zip(docs.columns, unpacked(docs.columns)))
    if remove == "documents":
        return rows.join(hit, same, "left_anti").select(*columns.values())
    cut = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(_without(F.col("_text"), F.col("_spans")))
    columns[text_col] = F.col("_cut").alias(text_col)
    return rows.join(hit, same, "left").withColumn("_cut", cut).select(*columns.values())
