"""Personal data by bootstrapped contextual extraction.

Exact matchers give the base spans; they are the seeds.  Words around seeds are lexical
patterns, and everything with the rough shape of an identifier is an instance of the
patterns around it.  Spark scores the graph of patterns and instances in rounds: a pattern
is as good as the instances it meets, an instance as its best pattern makes it likely, and
scores pass on in parts from round to round.  Forms that fail an identifier's check speak
against the words around them; forms that are merely unseen do so a little, and less the
likelier they get.  Instances with a high score then add unseen identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.carry import named
from tallybrook.llm.store import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
MIN_SEEDS = 5  # different seeds a pattern must have met
MIN_SCORE = 0.9  # of patterns and instances that discover
UNSEEN = 0.3  # how much an unseen form speaks against a pattern, beside one that fails its check

# The forms of base identifiers.  E-mails are found from their sign on, so
# that a long word is read once; numbers start where a run of digits starts.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The rough shapes of possible identifiers.
_ROUGH = (
    re.compile(r"[\w.%+-]{1,64}(?:@| ?[(\[]at[)\]] ?)[\w-]{1,64}(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]{1,64})+"),
    re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?![0-9]|[.:-][0-9])"),
    re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
    re.compile(r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
)
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
_EDGES = ".,;:!?#*$%&|<>\"'()[]{}="
_CONTEXT = 96  # characters looked at for the words on a side

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("failed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "array<struct<kind: int, start: int, stop: int>>"
_FOUND_SQL = "array<struct<kind: int, start: int, stop: int, seed: boolean, failed: boolean, instance: string, patterns: array<string>>>"


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in code points, by kind, then start."""
    found = []
    end = 0
    for m in _AT.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            end = m.end()
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _patterns(text: str, start: int, stop: int) -> list[str]:
    """Lexical patterns: two words before, one before, one after."""
    before = [w.strip(_EDGES).lower() for w in text[max(0, start - _CONTEXT) : start].split()[-2:]]
    after = [w.strip(_EDGES).lower() for w in text[stop : stop + _CONTEXT].split()[:1]]
    out = [f"{' '.join(before)} _"] if len(before) == 2 and all(before) else []
    out += [f"{before[-1]} _"] if before and before[-1] else []
    return out + ([f"_ {after[0]}"] if after and after[0] else [])


def _failed(kind: int, form: str) -> bool:
    """Whether a rough form of a kind is none by that kind's own check."""
    if kind == 1:
        return any(int(part) > 255 for part in re.split(r"[.:-]", form))
    digits = _digits(form)
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not _luhn(digits)
    return kind == 3 and not 9 <= len(digits) <= 15


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and possible identifiers with their patterns; what overlaps another is left."""
    taken = sorted((a, b) for _, a, b in base)
    found = [(kind, a, b, True) for kind, a, b in base]
    for kind, shape in enumerate(_ROUGH):
        new = []
        for m in shape.finditer(text):
            a, b = m.span()
            if kind == 3 and not 7 <= len(_digits(m[0])) <= 15 or any(x < b and a < y for x, y in taken):
                continue
            new.append((a, b))
        found += [(kind, a, b, False) for a, b in new]
        taken = sorted(taken + new)
    return [
        {
            "kind": k, "start": a, "stop": b, "seed": s, "failed": not s and _failed(k, text[a:b]),
            "instance": text[a:b].lower(), "patterns": _patterns(text, a, b),
        }
        for k, a, b, s in found
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, found = [], []
        for text in batch.column(2).to_pylist():
            base = base_spans(text) if text and _ANY.search(text) else []
            spans.append([dict(zip(("kind", "start", "stop"), s)) for s in base])
            found.append(candidates(text, base) if text and _ANY.search(text) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], names=["_id", "_th", "base", "found"]
        )


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and instances from (kind, pattern, instance, seed, failed) edges.

    With P seeds, N forms that failed their check and unseen forms of likelihood l, each
    different instance once, a pattern's score is (P + U) / (P + U + N + UNSEEN * sum(1 - l)
    + 1), where U is the sum of l and at most P: unseen forms never outvote the seeds.  An
    unseen instance is as likely as its best pattern with enough seeds, at first not at all;
    one that failed its check stays at 0.
    """
    edges = written(edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.max("failed").alias("failed")), "pii-edges")
    start = F.when(F.max("seed"), 1.0).otherwise(0.0)
    instances = edges.groupBy("kind", "instance").agg(start.alias("likely"))
    unseen = ~F.col("seed") & ~F.col("failed")
    part = lambda c: F.coalesce(F.sum(F.when(unseen, c)), F.lit(0.0))
    for _ in range(rounds):
        sums = edges.join(instances, ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.count_if("seed").alias("seeds"), F.count_if("failed").alias("against"), part(F.col("likely")).alias("for"), part(1 - F.col("likely")).alias("doubt")
        )
        good = F.col("seeds") + F.least(F.col("for"), F.col("seeds").cast("double"))
        patterns = sums.filter(F.col("seeds") >= MIN_SEEDS).select(
            "kind", "pattern", (good / (good + F.col("against") + UNSEEN * F.col("doubt") + 1)).alias("score"), "seeds"
        )
        patterns = written(patterns, "pii-patterns")
        best = F.when(F.max("seed"), 1.0).when(F.max("failed"), 0.0).otherwise(F.coalesce(F.max("score"), F.lit(0.0)))
        instances = written(
            edges.join(patterns, ["kind", "pattern"], "left").groupBy("kind", "instance").agg(best.alias("likely")), "pii-instances"
        )
    return patterns, instances


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_th`` and sorted span arrays ``base`` and ``spans`` (base and discovered).

    A null text is empty.  Spans have kind (index in KINDS), start and stop in code points.
    Rows with equal id and text get equal spans; a null id is an id of its own.
    """
    rows = docs.select(named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_th"), named(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    scanned = written(rows.mapInArrow(_scan, f"_id {kind}, _th bigint, base {_SPAN_SQL}, found {_FOUND_SQL}"), "pii-scan")
    seen = scanned.select("_id", "_th", F.explode("found").alias("f")).select("_id", "_th", "f.*")
    edges = seen.select("kind", F.explode("patterns").alias("pattern"), "instance", "seed", "failed")
    patterns, instances = score(edges)
    sure = patterns.filter(F.col("score") >= MIN_SCORE).select("kind", "pattern")
    likely = instances.filter(F.col("likely") >= MIN_SCORE).select("kind", "instance")
    new = (
        seen.filter("not seed and not failed")
        .select("_id", "_th", "kind", "start", "stop", "instance", F.explode("patterns").alias("pattern"))
        .join(sure, ["kind", "pattern"], "left_semi")
        .join(likely, ["kind", "instance"], "left_semi")
        .groupBy(F.col("_id").alias("_new_id"), F.col("_th").alias("_new_th"))
        .agg(F.collect_set(F.struct("kind", "start", "stop")).alias("_new"))
    )
    same = F.col("_id").eqNullSafe(F.col("_new_id")) & (F.col("_th") == F.col("_new_th"))
    none = F.array().cast(_SPAN_SQL)
    return scanned.join(new, same, "left").select("_id", "_th", "base", F.array_sort(F.concat("base", F.coalesce("_new", none))).alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
