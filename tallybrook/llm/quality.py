"""Quality rules by weak supervision: rules vote or abstain, and their accuracies are
estimated without labels by expectation-maximisation over the vote patterns.

A rule votes 1 (good), -1 (bad) or 0 (abstains, no evidence).  Votes are taken as
independent given the unknown class.  The corpus enters as one count per vote pattern, at
most 3 to the number of rules, so an iteration is an aggregation over a tiny table and
only two accuracies per rule and the share of good documents reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named, others, packed, unpacked
from tallybrook.llm.store import written
from tallybrook.llm.words import let, words

SYMBOLS = r"[#*$%&|<>]+"  # fixed value
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = (*BASE, "upper_chars", "punctuation", "distinct_words")


def _repeat_words(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in ``w``."""
    n = F.size(w) - F.lit(WINDOW - 1)
    hashes = F.when(
        n > 1,
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    )

    def starts(h: Column) -> Column:
        """Sorted starts of repeated windows: equal neighbours in order of hash and words."""
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(w, i + 1, WINDOW).alias("w"), i.alias("i"))))
        same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
        return let(
            placed,
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            p,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(p, k - 1)), F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(h: Column) -> Column:
        union = let(
            starts(h),
            lambda s: F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )
        return F.when(F.size(F.array_distinct(h)) < F.size(h), union).otherwise(0)

    return F.coalesce(let(hashes, covered), F.lit(0))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the BASE counts, ``upper_chars`` (A-Z), ``punctuation``, ``distinct_words``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.withColumn("_w", words(text)).withColumn("_lines", lines)
    removed = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": removed(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "upper_chars": removed("[A-Z]+"),
        "punctuation": removed(PUNCTUATION),
        "distinct_words": F.size(F.array_distinct("_w")),
    }
    return split.withColumns({k: c.cast("long") for k, c in counts.items()}).drop("_w", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rules() -> dict[str, Column]:
    """The votes, from the counts of ``measures``."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    many = F.greatest(n, F.lit(1))
    return {
        "length": _vote(n < 15, n >= 40),
        "word_length": _vote((chars < 3 * many) | (chars > 11 * many), chars.between(3.5 * many, 9 * many)),
        "symbols": _vote(10 * F.col("n_symbols") > chars, 50 * F.col("n_symbols") < chars),
        "repeats": _vote(10 * F.col("n_repeat_words") > n, 50 * F.col("n_repeat_words") < n),
        "lines": _vote(50 * F.col("n_dup_lines") > n, F.col("n_dup_lines") == 0),
        "punctuation": _vote((5 * F.col("punctuation") > 2 * n) & (n >= 20), 10 * F.col("punctuation") < 3 * n),
        "capitals": _vote(10 * F.col("upper_chars") > 4 * chars, 10 * F.col("upper_chars") < chars),
        "variety": _vote(10 * F.col("distinct_words") < n, 10 * F.col("distinct_words") > 3 * n),
    }


@dataclass(frozen=True)
class Model:
    """Share of good documents, and by rule how often its votes are 1 for each class."""

    good: float
    says_good: dict[str, tuple[float, float]]  # given a good, given a bad document

    def posterior(self, vote) -> Column:
        """Probability of a good document; ``vote(rule)`` is the rule's vote."""
        import math

        odds = F.lit(math.log(self.good / (1 - self.good)))
        for rule, (g, b) in self.says_good.items():
            odds = odds + F.when(vote(rule) == 1, math.log(g / b)).when(vote(rule) == -1, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, names: list[str], iterations: int = 15, prior: float = 2.0) -> Model:
    """Expectation-maximisation over the columns ``names`` of ``votes``.

    Starts from rules that are right about good documents and half blind to bad ones;
    ``prior`` pseudo-votes keep every rate away from 0 and 1.  No rows: the start.
    """
    patterns = written(votes.groupBy(*names).count(), "quality-patterns")
    model = Model(0.9, {r: (0.98, 0.5) for r in names})
    clamp = lambda x, low, high: round(min(max(x, low), high), 6)
    for _ in range(iterations):
        p = model.posterior(F.col)
        n = F.col("count")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("g")]
        for r in names:
            said, yes = F.col(r) != 0, F.col(r) == 1
            sums += [F.sum(F.when(m, n * x).otherwise(0.0)).alias(f"{k}{r}") for m, s in ((said, "s"), (yes, "y")) for x, k in ((p, "g" + s), (1 - p, "b" + s))]
        row = patterns.agg(*sums).first()
        if not row["n"]:
            return model
        rates = {
            r: (
                clamp((row["gy" + r] + prior * 0.98) / (row["gs" + r] + prior), 0.5, 0.9999),
                clamp((row["by" + r] + prior * 0.5) / (row["bs" + r] + prior), 0.01, 0.999),
            )
            for r in names
        }
        new = replace(model, good=clamp(row["g"] / row["n"], 0.05, 0.99), says_good=rates)
        moved = max(abs(a - b) for r in names for a, b in zip(new.says_good[r], model.says_good[r]))
        model = new
        if moved < 1e-4:
            break
    return model


def assess(docs: DataFrame, *, text_col: str = "text", keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``p_good`` and ``kept``.

    Null and blank texts have no words and fail the base rule.  Every row is judged on its
    own, so repeated rows and equal or null ids do no harm; input columns named like an
    added one are replaced.  The model is fitted to the
    documents that pass the base rule.  Without ``keep_text`` the text column is dropped
    before the counts are written.
    """
    rule = rules()
    rest = others(docs, text_col, *MEASURED, "base_failed", "p_good", "kept")
    rows = docs.select(packed(rest), named(text_col).alias("_text"))
    counted = measures(rows, "_text").withColumn("base_failed", base_failed())
    voted = counted.withColumns({f"vote_{k}": c for k, c in rule.items()})
    voted = written(voted if keep_text else voted.drop("_text"), "quality-votes")
    names = [f"vote_{k}" for k in rule]
    model = fit(voted.filter(~F.col("base_failed")), names)
    judged = voted.withColumn("p_good", model.posterior(F.col))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    text = [F.col("_text").alias(text_col)] if keep_text else []
    return judged.select(*unpacked(rest), *text, *MEASURED, "base_failed", "p_good", "kept")
