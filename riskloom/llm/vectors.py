"""Vectors that take part in searches and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """Not null, not of length zero, and every component a finite number."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    return vector.isNotNull() & F.coalesce(finite & (norm > 0), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v array<double>, *more) of the usable rows with an id."""
    return table.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *more)
