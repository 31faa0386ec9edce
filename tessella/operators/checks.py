"""Declared constraints as queries that return the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no row of the parent has."""
    return df.join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) < low) | (F.col(column) > high))


def expired(df: DataFrame, created: str, days: int, now: Column) -> DataFrame:
    return df.where(F.col(created) + F.make_dt_interval(F.lit(days)) < now)


def split_valid(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The rows with the names of required columns that are null or blank, in ``missing``; a valid row has none."""
    blank = F.array_compact(F.array(*(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required)))
    return df.withColumn("missing", F.array_join(blank, ","))
