"""Places of rows in an order, without one task for all rows or for all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.runtime import materialize

#: Rows of a range: more rows make more ranges.
RANGE_ROWS = 100_000


def ordinals(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place of a row among its key's rows by ``order`` (nulls first), and n, their number; keys are not null.

    Rows are dealt by ranges of (key, order, row number), so neither a key nor equal rows come to one task; a place is the
    place in the range plus what earlier ranges hold. Only one row a key and range goes through the window.
    """
    size = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    by = [key, *order, "row_number"]
    dealt = rows.withColumn("row_number", F.monotonically_increasing_id()).repartitionByRange(size, *by).sortWithinPartitions(*by).drop("row_number")
    placed = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "ordered")  # range number in the upper bits
    placed = placed.withColumn("range", F.shiftright("place", 33))
    held = placed.groupBy(key, "range").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    before, whole = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(key)
    starts = held.select(key, "range", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n"))
    return placed.join(starts, [key, "range"]).withColumn("idx", F.col("place") + F.col("shift")).drop("place", "range", "shift")


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """``rows``, written once, with dense numbers from 0 in no order of meaning; only a count a partition is added up."""
    placed = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "numbered").withColumn("part", F.shiftright("place", 33))
    held = placed.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("held"))  # a row a partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(starts), "part").withColumn(name, F.col("place") + F.col("shift")).drop("place", "part", "shift")
