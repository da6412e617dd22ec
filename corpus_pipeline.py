"""From raw documents to a training mixture: five stages, each over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``;
the last adds ``domain`` and ``epoch``.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import decontamination, lines, mixing, quality, simhash
from tallybrook.llm.registered import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, with_domain
from tallybrook.llm.store import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are good by the rules' posterior."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))
    return quality.assess(packed, keep_text=False).filter("kept").select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line chunks; documents of which no word is left go."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", F.struct(*rest).alias("_doc"), "text")
    cut = lines.dedup_lines(packed)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(lines.HAS_WORD)
    size = F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    own = {"text": F.col("text"), "n_chars": size}
    return cut.filter(~emptied).select(*[own.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark text."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: rows of documents, once per epoch that takes them."""
    return mixing.mix(with_domain(docs), MIX_WEIGHTS, share=MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

# SimHash bits (XXH64) and the fitted posterior have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
