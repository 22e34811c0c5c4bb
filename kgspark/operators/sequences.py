"""Rows in their order inside a document or conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carried(value: Column, by: str, order: str) -> Column:
    """The last value that is not null, up to and with each row (a section's heading for the lines below it)."""
    return F.last(value, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def in_sequence(by: str, order: str, first: int = 0) -> Column:
    """Whether ``order`` counts its rows from ``first`` without gaps and repetitions, up to each row."""
    return F.col(order) == F.row_number().over(Window.partitionBy(by).orderBy(order)) + (first - 1)


def paired(a: DataFrame, b: DataFrame, by: str, side: str, order: str) -> DataFrame:
    """By, order, other_order, position: the rows of ``a`` and ``b`` that have the same place among those of their side."""
    n = F.row_number().over(Window.partitionBy(by, side).orderBy(order)).cast("long").alias("position")
    other = b.select(by, F.col(order).alias(f"other_{order}"), n)
    return a.select(by, order, n).join(other, [by, "position"]).select(by, order, f"other_{order}", "position")
