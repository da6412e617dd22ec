"""Line dedup: content-defined chunks of lines that occur again are removed.

A polynomial hash rolls over the hashes of three neighbouring lines; where it hits a
residue, a chunk ends.  A boundary depends on these three lines only, so text inserted
before a passage does not move the boundaries inside it.  A hit counts only if two lines
that hold words stand between it and the hit before, and a shorter tail joins the chunk
before it, so every chunk of a text with two such lines can be compared.  Chunks with two or
more lines that hold words are counted over all documents by hash, candidates are compared
byte by byte, and all but the first (by document id, then text hash, then place) are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked
from tallybrook.llm.store import written
from tallybrook.llm.words import let

BASE, MODULUS = 31, 1_000_003
SPAN = 4  # a boundary after one line in so many
ADDED = ("n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks")
HAS_WORD = r"[^\x20\x09-\x0D]"


def chunks(text: Column) -> Column:
    """The chunks of a text: first and last line from 1, text, lines with words.

    One expression with every step computed once per text, also where the optimiser
    copies it into a filter.
    """
    value = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")

    def ends(values: Column) -> Column:
        at = lambda i: F.coalesce(F.get(values, i), F.lit(0))
        rolled = lambda i: (at(i - 1) + BASE * at(i - 2) + BASE * BASE * at(i - 3)) % MODULUS
        n = F.size(values)
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (rolled(i) % SPAN == 0))

    n_filled = lambda inside: F.size(F.filter(inside, lambda x: x.rlike(HAS_WORD)))

    def long_enough(lines: Column, stops: Column) -> Column:
        def between(end: Column, k: Column) -> Column:
            before = F.coalesce(F.get(stops, k - 1), F.lit(0))
            return n_filled(F.slice(lines, before + 1, end - before)) > 1

        n = F.array(F.size(lines))
        joined = lambda kept: F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), n)
        # The last boundary is the end of the text, be it moved there or not.
        return let(F.filter(stops, between), joined)

    def cut(lines: Column, stops: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            first = F.coalesce(F.get(stops, k - 1), F.lit(0)) + 1
            inside = F.slice(lines, first, end - first + 1)
            return F.struct(first.alias("first"), end.alias("last"), F.array_join(inside, "\n").alias("text"), n_filled(inside).alias("filled"))

        return F.transform(stops, chunk)

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(lines, lambda x: let(F.transform(x, value), lambda v: let(ends(v), lambda e: let(long_enough(x, e), lambda k: cut(x, k)))))


def repeated_chunks(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Per document with chunks to remove: ``_id``, ``_th`` and their places ``_gone``."""
    keyed = docs.select(named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_th"), named(text_col).alias("_text"))
    keyed = keyed.withColumn("_chunks", chunks(F.col("_text")))
    slim = written(
        keyed.select("_id", "_th", F.posexplode_outer("_chunks").alias("_k", "_c"))
        .filter("_c.filled > 1")
        .select("_id", "_th", "_k", F.xxhash64("_c.text").alias("_hash")),
        "line-chunks",
    )
    # Written, as adaptive execution splits a hot key only where both sides come from a shuffle.
    again = written(slim.groupBy("_hash").count().filter("count > 1").select("_hash"), "line-repeated")
    hits = slim.join(again, "_hash", "left_semi").groupBy("_id", "_th").agg(F.collect_set("_k").alias("_ks"))
    hits = hits.select(F.col("_id").alias("_hit_id"), F.col("_th").alias("_hit_th"), "_ks")
    texts = keyed.select("_id", "_th", "_chunks").join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_th") == F.col("_hit_th")))
    candidates = written(
        texts.select("_id", "_th", F.explode_outer("_ks").alias("_k"), "_chunks")
        .select("_id", "_th", "_k", F.get("_chunks", F.col("_k"))["text"].alias("_text"))
        .withColumn("_hash", F.xxhash64("_text")),
        "line-candidates",
    )
    place = F.struct("_id", "_th", "_k")
    same_bytes = candidates.groupBy("_hash", "_text").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    same_bytes = written(same_bytes.filter("_n > 1"), "line-repeats")
    # A hash with one repeated text stands for that text unless other texts share it.
    variants = candidates.select("_hash", "_text").distinct().groupBy("_hash").count().filter("count > 1").select("_hash")
    clashes = written(variants, "line-clashes")
    plain = written(same_bytes.join(clashes, "_hash", "left_anti").select("_hash", "_first"), "line-plain")
    clash = written(same_bytes.join(clashes, "_hash", "left_semi").select("_hash", "_text", "_first"), "line-clash")
    removed = (
        candidates.drop("_text").join(plain, "_hash").filter(place != F.col("_first")).select("_id", "_th", "_k")
        .unionByName(candidates.join(clash, ["_hash", "_text"]).filter(place != F.col("_first")).select("_id", "_th", "_k"))
    )
    return removed.groupBy("_id", "_th").agg(F.collect_set("_k").alias("_gone"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut from the text, and counts of what was cut.

    Added columns: ``n_lines``, ``n_chunks``, ``n_removed_lines``, ``n_removed_chunks``.
    Every row stays, with an empty text if all its lines were copies; a null text stays
    null; input columns named like an added one are replaced.  Rows with equal id and text
    are one document and are treated alike; a null id sorts before others.
    """
    gone = repeated_chunks(docs, id_col=id_col, text_col=text_col)
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_th").alias("_gone_th"), "_gone")
    rest = others(docs, text_col, *ADDED)
    keyed = docs.select(packed(rest), named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_th"), named(text_col).alias("_text"))
    joined = keyed.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left")
    cut = joined.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>"))).withColumn("_chunks", chunks(F.col("_text")))
    n_lines = F.element_at("_chunks", -1)["last"]
    # Before the caller's columns are unpacked, whose names a lambda's body would find first.
    cut = cut.withColumn("_kept", F.filter("_chunks", lambda c, k: ~F.array_contains("_gone", k)))
    kept = F.col("_kept")
    length = lambda cs: F.aggregate(cs, F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1)
    return cut.select(
        *unpacked(rest),
        F.when(F.size("_gone") > 0, F.array_join(F.transform(kept, lambda c: c["text"]), "\n")).otherwise(F.col("_text")).alias(text_col),
        n_lines.cast("long").alias("n_lines"),
        F.size("_chunks").cast("long").alias("n_chunks"),
        (n_lines - length(kept)).cast("long").alias("n_removed_lines"),
        F.size("_gone").cast("long").alias("n_removed_chunks"),
    )
