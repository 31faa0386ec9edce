"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of at least one edge; component is the smallest node it reaches.

    Edges are undirected; self loops, repeats and rows with a null end are ignored. Nothing but two counters
    reaches the driver; every round is a written table. An empty edge table gives an empty result.
    """
    ends = [F.col(src).alias("x"), F.col(dst).alias("y")]
    e = edges.select(*ends).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state is not None and now == state or now[0] == 0:
            break
        state = now
        past, e = e, materialize(_small_star(_large_star(e)), "edges")
        release(past)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
