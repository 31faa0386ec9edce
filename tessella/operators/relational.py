"""Filters, ranking, limits and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def apply_operations(df: DataFrame, operations: Sequence[Mapping]) -> DataFrame:
    """A list of {'type': filter | sort | group, 'params': ...} applied in order; another type is an error."""

    def one(frame: DataFrame, op: Mapping) -> DataFrame:
        p = op["params"]
        if op["type"] == "filter":
            return reduce(lambda f, kv: keep_values(f, kv[0], kv[1] if isinstance(kv[1], (list, tuple)) else [kv[1]]), p.items(), frame)
        if op["type"] == "sort":
            by = [p["by"]] if isinstance(p["by"], str) else list(p["by"])
            return frame.orderBy(*by, ascending=p.get("ascending", True))
        if op["type"] == "group":
            return frame.groupBy(*p["by"]).agg(*(F.expr(f"{how}({c})").alias(f"{c}_{how}") for c, how in p["agg"].items()))
        raise ValueError(f"unknown operation {op['type']!r}")

    return reduce(one, operations, df)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark drops the rest before the shuffle (a window group limit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def limit_results(df: DataFrame, score: str = "score", tie: str = "id", top_p: float | None = None, top_k: int | None = None) -> DataFrame:
    """Rows of a score of top_p or more, then the top_k of them. None turns a limit off; 0 is a value."""
    kept = df if top_p is None else df.where(F.col(score) >= top_p)
    return kept if top_k is None else kept.orderBy(F.desc(score), tie).limit(top_k)


def reciprocal_ranks(df: DataFrame, keys: Sequence[str], score: str = "score", tie: str = "id", k: int = 60) -> DataFrame:
    """rank by score within each key, and rrf = 1 / (k + rank)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).withColumn("rrf", 1 / (k + F.col("rank")))


def fuse_ranks(rankings: Sequence[DataFrame], keys: Sequence[str], item: str, score: str = "score", k: int = 60) -> DataFrame:
    """True reciprocal rank fusion: the sum of 1 / (k + rank) over several rankings."""
    ranked = [reciprocal_ranks(r, keys, score, item, k).select(*keys, item, "rrf") for r in rankings]
    return reduce(DataFrame.unionByName, ranked).groupBy(*keys, item).agg(F.sum("rrf").alias("score"))


def first_claim(df: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """Each item belongs to the first of its rows."""
    return top_per_key(df, [item], [F.col(c) for c in order], 1, "_claim").drop("_claim")


def merge_with_prefix(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Union of tables of one shape, keys prefixed by the table's number and the table's name kept; columns may be missing."""
    parts = [f.withColumn(key, F.concat(F.lit(f"db{i}_"), F.col(key).cast("string"))).withColumn("source_file", F.lit(name)) for i, (name, f) in enumerate(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of tables in which a key's row comes from the last table that has it."""
    marked = reduce(DataFrame.unionByName, [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)])
    return top_per_key(marked, [key], [F.desc("_from")], 1, "_rank").drop("_rank", "_from")


def cumulative_pick(df: DataFrame, keys: Sequence[str], order: str, weight: str, draw: Column) -> DataFrame:
    """For each key the first row, in order, whose running share of the weight reaches the draw."""
    running = W.partitionBy(*keys).orderBy(order)
    whole = W.partitionBy(*keys)
    shared = df.withColumn("running", F.sum(weight).over(running.rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(whole))
    return top_per_key(shared.where(F.col("running") >= draw), keys, [F.col(order)], 1, "_pick").drop("_pick")
