"""Columns of a caller that pass through an operator, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def others(docs: DataFrame, *own: str) -> list[str]:
    """The columns of ``docs`` besides those that an operator reads apart or adds."""
    taken = {c.lower() for c in own}
    return [c for c in docs.columns if c.lower() not in taken]


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str]) -> Column:
    """``columns`` as one struct ``_doc``, its fields numbered, so that no name can clash."""
    return F.struct(F.lit(True).alias("row"), *[named(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("_doc")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(columns)]
