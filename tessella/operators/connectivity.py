"""How well nodes are connected: distances among many at once, clustering and centrality within their own subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import induced, triangles, undirected
from tessella.operators.ordering import numbered
from tessella.runtime import materialize

BITS = 64


def waves(edges: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """Tables (node, word, bits), one for each distance from 0: of which sources the node is that far away; with the numbered sources first.

    The graph is undirected. Sources are numbered, and the searches of BITS sources are the bits of one number, so a step moves a
    row for each node and word, whatever the number of searches in it, and merges them by ``bit_or``. In an undirected graph what a
    step finds anew can only be known from the two steps before it, so reached rows are written once.
    """
    e = materialize(undirected(edges), "undirected")
    marked = numbered(sources.select("node").distinct(), "number").withColumn("word", F.floor(F.col("number") / BITS))
    marked = materialize(marked.withColumn("bits", F.expr(f"shiftleft(1L, CAST(number % {BITS} AS INT))")), "sources")
    found = [marked, materialize(marked.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "wave")]
    while True:
        met = found[-1].join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        before = found[-1] if len(found) == 2 else found[-1].unionByName(found[-2]).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        new = met.join(before.withColumnRenamed("bits", "seen"), ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long")))))
        wave = materialize(new.where("bits <> 0").select("node", "word", "bits"), "wave")
        if wave.isEmpty():
            return found
        found.append(wave)


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) along undirected edges, for every node that a source reaches, itself at 0."""
    marked, *found = waves(edges, sources)
    spread = None
    for distance, wave in enumerate(found):
        each = wave.withColumn("bit", F.explode(F.array(*map(F.lit, range(BITS))))).where(F.expr("shiftrightunsigned(bits, bit) & 1 = 1"))
        part = each.select((F.col("word") * BITS + F.col("bit")).alias("number"), "node", F.lit(distance).alias("distance"))
        spread = part if spread is None else spread.unionAll(part)
    return spread.join(marked.select("number", F.col("node").alias("source")), "number").select("source", "node", "distance")


def connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row on the given nodes: their number, reached pairs and mean distance over all edges, 1 / that mean, and mean clustering and degree centrality of the subgraph that they induce.

    Nodes that no edge has are left out; pairs are unordered, and those out of reach have no part in the mean.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    chosen = materialize(nodes.select("node").distinct().join(ends, "node", "left_semi"), "chosen")
    n = chosen.count()
    _, *found = waves(edges, chosen)
    total = pairs = 0
    for distance, wave in enumerate(found[1:], 1):
        met = wave.join(chosen, "node", "left_semi").agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        total, pairs = total + distance * met, pairs + met
    mean = total / pairs if pairs else None
    own = triangles(induced(edges, chosen)).agg(F.sum("clustering").alias("c"), F.sum("degree").alias("d")).first()
    row = (n, pairs // 2, mean, 1 / mean if mean else 0.0, (own.c or 0.0) / n if n else 0.0, (own.d or 0) / (n * (n - 1)) if n > 1 else 0.0)
    return nodes.sparkSession.createDataFrame([row], "nodes long, pairs long, mean_distance double, score double, clustering double, centrality double")
