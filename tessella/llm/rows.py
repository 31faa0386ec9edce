"""Columns of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_of(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The named columns of a row, all by default, as one struct; its ``row.*`` gives them back."""
    return F.struct(*(named(c) for c in columns or docs.columns)).alias("row")
