"""Hypergraphs as an incidence table (edge_id, edge_type, node_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.runtime import materialize

#: Hyperedges of up to so many nodes meet on pairs of nodes. A node is frequent from so many times the mean on.
PAIRED, OFTEN = 32, 8


def node_influence(members: DataFrame, least: int = 3) -> DataFrame:
    """Hyperedges of a node times the number of their types, for nodes in at least ``least``."""
    counts = members.groupBy("node_id").agg(F.countDistinct("edge_id").alias("n_edges"), F.countDistinct("edge_type").alias("n_types"))
    return counts.where(F.col("n_edges") >= least).withColumn("influence", F.col("n_edges") * F.col("n_types"))


def knowledge_gaps(members: DataFrame, least_size: int = 3, most_others: int = 2) -> DataFrame:
    """Members of large hyperedges that few other hyperedges hold: gap = 1 / (others + 1)."""
    m = members.select("edge_id", "node_id").distinct()
    large = m.groupBy("edge_id").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    known = m.groupBy("node_id").agg((F.count("*") - 1).alias("others")).where(F.col("others") <= most_others)
    return m.join(large, "edge_id").join(known, "node_id").select("edge_id", "node_id", "others", (1 / (F.col("others") + 1)).alias("gap"))


def similar_hyperedges(members: DataFrame, least: float = 0.5, common: int = 3) -> DataFrame:
    """(edge_a, edge_b, n_common, similarity) of hyperedges of one type with Jaccard over ``least`` and ``common`` shared nodes.

    Two sets that alike share t nodes or more, more than ``least`` of either's size and ``common`` at least. In one order of all nodes,
    the first size - t + 2 of either then share two, the first size - t + 1 share one. So hyperedges meet on pairs of nodes, which
    few share by chance; those of over ``PAIRED`` nodes, which have too many pairs, and such as may be like them meet on single ones.
    Where some nodes are much more frequent than others the order is by frequency, so that these are hardly ever among the first.
    """
    sets = members.where("edge_type IS NOT NULL").groupBy("edge_type", "edge_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"))
    sets = materialize(sets.where(F.size("nodes") >= common), "sets")
    frequent = materialize(sets.select("edge_type", F.explode("nodes").alias("node_id")).groupBy("edge_type", "node_id").agg(F.count("*").alias("f")), "frequent")
    mean, most = frequent.agg(F.avg("f"), F.max("f")).first()
    if (most or 0) > OFTEN * (mean or 0):
        found = sets.select("edge_type", "edge_id", F.explode("nodes").alias("node_id")).join(frequent, ["edge_type", "node_id"])
        sets = found.groupBy("edge_type", "edge_id").agg(F.sort_array(F.collect_list(F.struct("f", "node_id"))).alias("s"))
        sets = materialize(sets.select("edge_type", "edge_id", F.col("s.node_id").alias("nodes")), "sets")
    size = F.size("nodes")
    shared = F.greatest(F.lit(common), F.floor(size * least - 1e-9).cast("int") + 1)
    first = lambda n: F.slice("nodes", F.lit(1), F.least(size, size - shared + n))
    keys = []
    if common > 1:
        p = F.col("first")
        pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.transform(F.slice(p, i + 1, F.size(p)), lambda y: F.struct(F.element_at(p, i).alias("x"), y.alias("y")))))
        keys.append(sets.where(size <= PAIRED).select("edge_type", "edge_id", first(2).alias("first")).select("edge_type", "edge_id", F.explode(pairs).alias("key")))
    largest = sets.agg(F.max(size)).first()[0] or 0
    if common <= 1 or largest > PAIRED:
        single = sets if common <= 1 else sets.where(size > least * PAIRED)
        keys.append(single.select("edge_type", "edge_id", F.explode(first(1)).alias("key")))

    def met(keyed: DataFrame) -> DataFrame:
        hashed = keyed.select(F.xxhash64("edge_type", "key").alias("key"), "edge_id")  # sets of one hash by chance fall out below
        return hashed.withColumnRenamed("edge_id", "edge_a").join(hashed.withColumnRenamed("edge_id", "edge_b"), "key").where("edge_a < edge_b").select("edge_a", "edge_b")

    pairs = reduce(DataFrame.unionAll, map(met, keys)).distinct()
    full = pairs.join(sets.select("edge_type", F.col("edge_id").alias("edge_a"), F.col("nodes").alias("na")), "edge_a")
    full = full.join(sets.select("edge_type", F.col("edge_id").alias("edge_b"), F.col("nodes").alias("nb")), ["edge_type", "edge_b"])
    both = F.size(F.array_intersect("na", "nb"))
    scored = full.select("edge_type", "edge_a", "edge_b", both.alias("n_common"), (both / F.size(F.array_union("na", "nb"))).alias("similarity"))
    return scored.where((F.col("similarity") > least) & (F.col("n_common") >= common))


def rings(members: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """(node_id, distance): breadth-first rings of nodes around the seed nodes, neighbours being members of one hyperedge."""
    m = members.select("edge_id", "node_id").distinct()
    seen = materialize(seeds.select("node_id").distinct().withColumn("distance", F.lit(0)), "rings")
    frontier = seen
    for step in range(1, most + 1):
        touched = frontier.join(m, "node_id").select("edge_id").distinct()
        found = m.join(touched, "edge_id", "left_semi").select("node_id").distinct()
        frontier = materialize(found.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(step)), "rings")
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier), "rings")
    return seen


def fuse_layers(layers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(node_id, score) from (layer, node_id, score): the weighted sum over layers, divided by the largest."""
    weight = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("layer")), F.lit(1.0))
    summed = layers.groupBy("node_id").agg(F.sum(F.col("score") * weight).alias("total"))
    best = summed.agg(F.max("total")).first()[0]
    return summed.select("node_id", (F.col("total") / F.lit(best or 1.0)).alias("score"))


def best_of_cluster(rows: DataFrame, cluster: str, score: str, tie: str) -> DataFrame:
    w = W.partitionBy(cluster).orderBy(F.desc(score), tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
