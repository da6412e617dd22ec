"""Review documents as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def review_name(period: str | None = None) -> str:
    return f"review_{period}.json" if period else "review.json"


def write_review(documents: DataFrame, folder: str, period: str | None = None) -> str:
    """Write one JSON document per line, one directory per store if there are store columns.

    Only the stores in ``documents`` are written anew; those of earlier runs stay.
    """
    path = f"{folder.rstrip('/')}/{review_name(period)}"
    stores = [c for c in documents.columns if c != "document"]
    writer = documents.write.mode("overwrite")
    if stores:
        writer = writer.partitionBy(*stores).option("partitionOverwriteMode", "dynamic")
    writer.text(path)
    return path
