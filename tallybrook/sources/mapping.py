"""Header mapping: exact aliases first, then token similarity with value types.

Names are matched while the plan is built; value types come from one aggregation
over all columns at once.
"""

from __future__ import annotations

import re
from functools import cache
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.sources.headers import (
    ALIASES,
    CLOCK_SHAPES,
    DATE_SHAPES,
    DISTINCT_FROM,
    EXPECTED_TYPES,
    ISO_START,
    LEAST_SCORE,
    NUMERIC_FROM,
    REQUIRED,
    TYPE_BONUS,
    ZONED_SHAPES,
)


SKETCH_ERROR = 0.02  # standard error of the sketch of different values


def _date_forms() -> list[tuple[str, str | None, list[str]]]:
    """(pattern, pattern for a late first number, shapes) of all texts that have a pattern."""
    found = [
        (early + clock, late and late + clock, [d + c for d in shapes for c in clock_shapes])
        for clock, clock_shapes in CLOCK_SHAPES
        for early, late, shapes in DATE_SHAPES
    ]
    return found + [(pattern, None, shapes) for pattern, shapes in ZONED_SHAPES]


def parse_timestamp(c: Column) -> Column:
    """Timestamp from mixed date texts, null where no pattern fits.

    Digits and letters become a shape, and the shape is looked up once: a text is parsed with
    the one pattern it has, or cast if it is an ISO text, or costs no parse.
    """
    text = F.trim(c.cast("string"))
    letters = ascii_uppercase + ascii_lowercase
    shape = F.replace(F.translate(text, digits + letters, "9" * len(digits) + "a" * len(letters)), F.lit("99"), F.lit("9"))
    forms = _date_forms()
    numbers = F.create_map(*[F.lit(x) for n, (*_, shapes) in enumerate(forms) for s in shapes for x in (s, n)])
    late = F.substring(text, 1, 2).isin([str(n) for n in range(13, 32)])

    def parsed(form: Column) -> Column:
        out = F.when(form.isNull(), F.when(text.rlike(ISO_START), F.try_to_timestamp(text)))
        for n, (early, other, _) in enumerate(forms):
            way = F.try_to_timestamp(text, F.lit(early))
            out = out.when(form == n, way if other is None else F.when(late, F.try_to_timestamp(text, F.lit(other))).otherwise(way))
        return out

    # Bound in a list of one, so that the shape is not computed again for each branch.
    return F.transform(F.array(numbers[shape]), parsed)[0]


def alias_map(columns: list[str]) -> dict[str, str]:
    """Source column → canonical name for headers that equal an alias."""
    by_name = {c.lower().strip(): c for c in columns}
    found: dict[str, str] = {}
    for canonical, names in ALIASES.items():
        source = next((by_name[n] for n in names if n in by_name), None)
        if source is not None and canonical not in columns:
            found[source] = canonical
    return found


@cache
def name_words(name: str) -> frozenset[str]:
    """Words of a header: lower case, cut at blanks and underscores."""
    return frozenset(re.findall(r"[^\s_]+", name.lower()))


@cache
def canonical_words(canonical: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of all aliases of a canonical name together, and its own."""
    return frozenset().union(*map(name_words, ALIASES[canonical])), name_words(canonical)


def overlap(a: frozenset[str], b: frozenset[str]) -> float:
    """Common words as a share of all words of two sets; 0 for two empty ones."""
    return len(a & b) / len(a | b) if a or b else 0.0


PROFILE = (
    "column string, rows bigint, filled bigint, numeric_rate double, date_rate double, "
    "distinct_rate double, distinct_exact boolean, inferred_type string"
)


def _kind(filled: int, numeric: float, dated: float, distinct: float) -> str:
    if not filled:
        return "unknown"
    if numeric > NUMERIC_FROM:
        return "currency"
    if dated == 1.0:
        return "date"
    return "id" if distinct > DISTINCT_FROM else "unknown"


def column_profile(df: DataFrame) -> DataFrame:
    """column, rows, filled, numeric_rate, date_rate, distinct_rate, distinct_exact, inferred_type.

    One pass over all columns, with a sketch of the different values.  Numbers are tested
    before dates, so a numeric column counts as ``currency``; ``id`` means mostly different
    values.  Where the sketch cannot tell on which side of that limit a column lies and the
    column is nothing else, its values are counted exactly in a second pass.
    One row of counts per column comes to the driver.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        # A number: digits, with one point and one minus at most, beside $, commas and blanks.
        text = F.translate(c.cast("string"), "$, \t\n\x0b\f\r", "")
        rest = F.translate(text, digits, "")
        number = rest.isin("", ".", "-", ".-", "-.") & (F.length(text) > F.length(rest))
        aggs += [
            F.count(c).alias(f"filled_{i}"),
            F.count_if(number).alias(f"number_{i}"),
            F.count(F.when(~number, parse_timestamp(c))).alias(f"date_{i}"),
            F.approx_count_distinct(c, SKETCH_ERROR).alias(f"distinct_{i}"),
        ]
    found = df.agg(*aggs).first()
    rows, profile, unsure = found["rows"], [], []
    for i, name in enumerate(df.columns):
        filled, number, dated, distinct = (found[f"{k}_{i}"] for k in ("filled", "number", "date", "distinct"))
        rates = [number / filled, dated / filled] if filled else [None, None]
        share = distinct / rows if rows else None
        profile.append([name, rows, filled, *rates, share, False])
        near = share is not None and abs(share - DISTINCT_FROM) <= 4 * SKETCH_ERROR * DISTINCT_FROM
        if near and _kind(filled, *rates, share) in ("id", "unknown"):
            unsure.append(i)
    if unsure:
        exact = df.agg(*[F.countDistinct(F.col(f"`{df.columns[i]}`")).alias(f"n{i}") for i in unsure]).first()
        for i in unsure:
            profile[i][5:] = [exact[f"n{i}"] / rows, True]
    out = [(*p, _kind(p[2], p[3], p[4], p[5])) for p in profile]
    return df.sparkSession.createDataFrame(out, PROFILE)


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Column types as a small dict."""
    rows = column_profile(df).select("column", "inferred_type").collect()
    return {r["column"]: r["inferred_type"] for r in rows}


def fuzzy_scores(columns: list[str], types: dict[str, str], canonical: str) -> dict[str, float]:
    """How well each header fits a canonical name, by words and by the values' type."""
    targets = canonical_words(canonical)
    wanted = EXPECTED_TYPES.get(canonical, "")
    return {
        c: max(overlap(name_words(c), t) for t in targets) + (TYPE_BONUS if wanted and types.get(c) == wanted else 0.0) for c in columns
    }


def undecided(columns: list[str]) -> list[str]:
    """Columns whose value type can decide a mapping, because their name alone comes close."""
    free = [c for c in columns if c not in ALIASES]
    wanted = [name for name in EXPECTED_TYPES if name not in columns]
    return [c for c in free if any(fuzzy_scores([c], {}, w)[c] >= LEAST_SCORE - TYPE_BONUS for w in wanted)]


def fuzzy_map(columns: list[str], types: dict[str, str]) -> dict[str, tuple[str, float]]:
    """Source column → (canonical name, score) for canonical names still missing.

    Canonical columns that exist are never used as a source; earlier columns win ties.
    """
    free = [c for c in columns if c not in ALIASES]
    found: dict[str, tuple[str, float]] = {}
    for canonical in ALIASES:
        scores = fuzzy_scores([c for c in free if c not in found], types, canonical)
        if canonical in columns or not scores:
            continue
        best = max(scores, key=scores.get)
        if scores[best] >= LEAST_SCORE:
            found[best] = (canonical, scores[best])
    return found


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def map_columns(df: DataFrame) -> DataFrame:
    """Canonical names by alias, and by similarity if required columns are still missing."""
    df = rename(df, alias_map(df.columns))
    if REQUIRED["orders"] - set(df.columns):
        close = undecided(df.columns)
        types = inferred_types(df.select(*[F.col(f"`{c}`") for c in close])) if close else {}
        guessed = fuzzy_map(df.columns, types)
        df = rename(df, {c: name for c, (name, _) in guessed.items()})
    return df


def mapping_report(df: DataFrame) -> DataFrame:
    """source_col, canonical, tier, score, inferred_type; then one row per required column still missing."""
    exact = alias_map(df.columns)
    renamed = rename(df, exact)
    missing = REQUIRED["orders"] - set(renamed.columns)
    profile = column_profile(df)
    guessed: dict[str, tuple[str, float]] = {}
    if missing:
        types = {exact.get(c, c): t for c, t in inferred_types(df).items()}
        guessed = fuzzy_map(renamed.columns, types)
    rows = []
    for c in df.columns:
        if c in exact:
            rows.append((c, exact[c], 1, 1.0))
        elif c in guessed:
            rows.append((c, guessed[c][0], 2, float(guessed[c][1])))
        elif c in ALIASES:
            rows.append((c, c, 0, 1.0))
        else:
            rows.append((c, None, None, None))
    got = {r[1] for r in rows}
    rows += [(None, c, None, None) for c in sorted(REQUIRED["orders"] - got)]
    table = df.sparkSession.createDataFrame(rows, "source_col string, canonical string, tier int, score double")
    kinds = profile.select(F.col("column").alias("source_col"), "inferred_type", "filled", "rows")
    return table.join(F.broadcast(kinds), "source_col", "left")
