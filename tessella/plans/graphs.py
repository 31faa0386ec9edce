"""Queries of graphs, hypergraphs and plans over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.operators import graph, graphretrieve, graphsearch, hypergraph, plangraph, retrieval
from tessella.operators.connectivity import connectivity, distances_from
from tessella.runtime import materialize
from tessella.runtime import read_table as t


def _bought_together(spark, d):
    """Parts that share two orders or more; an order has a handful of lines. Written once, for all that a query does with it."""
    parts = F.array_sort(F.collect_set("l_partkey"))
    orders = t(spark, d, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(parts.alias("parts"))
    firsts = orders.select("parts", F.posexplode("parts").alias("i", "src"))
    pairs = firsts.select("src", F.explode(F.slice("parts", F.col("i") + 2, F.size("parts"))).alias("dst"))
    return materialize(pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")).where("weight >= 2").select("src", "dst"), "bought-together")


def _members(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("edge_type"))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id")).join(orders, "edge_id").distinct()


def contains_build(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.containment(rows.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_custkey").alias("customer")), ["region", "nation", "customer"])


def degree(spark, d):
    return graph.degrees(_bought_together(spark, d)).withColumn("centrality", F.round("centrality", 8))


def components(spark, d):
    return graph.components(_bought_together(spark, d))


def triangles(spark, d):
    return graph.triangles(_bought_together(spark, d)).withColumn("clustering", F.round("clustering", 6))


def pagerank(spark, d):
    return graph.pagerank(_bought_together(spark, d), rounds=5).withColumn("rank", F.round("rank", 10))


def label_propagation(spark, d):
    return graph.label_propagation(_bought_together(spark, d), 3)


def shortest_path(spark, d):
    """Steps from the first part to all that it reaches, along either direction."""
    e = _bought_together(spark, d)
    return distances_from(e, e.agg(F.least(F.min("src"), F.min("dst")).alias("node")))


def simple_paths(spark, d):
    """Paths of up to three steps from the nodes divisible by 50, along edges from the lower to the higher part."""
    e = _bought_together(spark, d)
    starts = e.where("src % 50 = 0").select(F.col("src").alias("node")).distinct()
    return graph.simple_paths(e, starts, 3).select(F.array_join("path", ",").alias("path"))


def betweenness(spark, d):
    e = _bought_together(spark, d)
    return graph.betweenness(e, graph.sampled_pivots(e)).withColumn("betweenness", F.round("betweenness", 6))


def modularity(spark, d):
    e = _bought_together(spark, d)
    return graph.modularity(e, graph.label_propagation(e, 3).withColumnRenamed("label", "community")).select("community", "size", "inner", "degree", F.round("part", 8).alias("part"))


def document_groups(spark, d):
    return _members(spark, d).groupBy("edge_id", "edge_type").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("node_id")).cast("array<string>"), ",").alias("members"))


def influence(spark, d):
    return hypergraph.node_influence(_members(spark, d))


def gaps(spark, d):
    return hypergraph.knowledge_gaps(_members(spark, d), most_others=20).select("edge_id", "node_id", "others", F.round("gap", 6).alias("gap"))


def patterns(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderpriority").alias("edge_type"))
    m = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_suppkey").alias("node_id")).join(orders, "edge_id")
    found = hypergraph.similar_hyperedges(m)
    return found.select(F.explode(F.array("edge_a", "edge_b")).alias("edge_id")).groupBy("edge_id").agg(F.count("*").alias("n_links"))


def diffusion(spark, d):
    m = _members(spark, d)
    return hypergraph.rings(m, m.select("node_id").where("node_id % 50 = 0"), 3).groupBy("distance").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


def layer_fusion(spark, d):
    docs = t(spark, d, "documents")
    content = docs.select(F.lit("content").alias("layer"), F.col("doc_id").alias("node_id"), (F.least("n_chars", F.lit(5000)) / 5000).alias("score"))
    structure = t(spark, d, "pages").select(F.lit("structure"), F.col("page_id"), (1 / F.size(F.split("url", "/"))))
    metadata = t(spark, d, "labels").select(F.lit("metadata"), F.col("doc_id"), F.col("quality").cast("double"))
    layers = content.unionAll(structure).unionAll(metadata)
    return hypergraph.fuse_layers(layers, {"content": 1.0, "structure": 0.7, "metadata": 0.4}).withColumn("score", F.round("score", 6))


def cluster_best(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("score"))
    return hypergraph.best_of_cluster(e, "label", "score", "vec_id")


def kmeans(spark, d):
    """Clusters of the embeddings; sizes depend on the seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = t(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=10, seed=7, maxIter=10).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


def _plans(spark, d):
    """Each order is a plan; a line waits for the line before it, and every third for the one before that."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("node")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    e = lines.select("plan_id", F.explode(F.array_compact(F.array(F.col("node") - 1, F.when(F.col("node") % 3 == 0, F.col("node") - 2)))).alias("src"), F.col("node").alias("dst"))
    return lines, e.join(lines.select("plan_id", F.col("node").alias("src")), ["plan_id", "src"], "left_semi")


def topo_levels(spark, d):
    return plangraph.topological_levels(*_plans(spark, d))


def ready_set(spark, d):
    lines, e = _plans(spark, d)
    return plangraph.ready_nodes(lines.withColumn("solved", F.col("l_returnflag") == "R"), e)


def join_prompts(spark, d):
    """Lines as plan nodes, parts as prompts; parts of size over 40 are missing from the library."""
    lines, _ = _plans(spark, d)
    prompts = t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("prompt_id"), F.col("p_name").alias("template"))
    nodes = lines.select("plan_id", "node", F.when(F.col("node") < 6, F.col("l_partkey")).alias("prompt_id"))
    return plangraph.attach_prompts(nodes, prompts).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("plan_id").alias("plans"))


_E = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
e AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
_LABELS = "l0 AS (SELECT DISTINCT src AS node, src AS label FROM u), " + ", ".join(
    f"l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT u.src AS node, label, count(*) AS votes FROM u JOIN l{i} ON l{i}.node = u.dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, label) = 1)"
    for i in range(3)
)
_M = "WITH m AS (SELECT DISTINCT l_orderkey AS edge_id, o_orderpriority AS edge_type, l_partkey AS node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_RANKS = ", ".join(
    f"r{i} AS (SELECT node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce((SELECT sum(r / o) FROM s{i} JOIN e ON s{i}.node = e.src WHERE e.dst = n.node), 0) + (SELECT coalesce(sum(r), 0) FROM s{i} WHERE o = 0) / (SELECT count(*) FROM n)) AS r FROM n), s{i + 1} AS MATERIALIZED (SELECT r{i}.node, r, o FROM r{i} JOIN n USING (node))"
    for i in range(5)
)
def _personal(rounds: int) -> str:
    """Rounds of a personalised rank over undirected edges, restarting at ``base``."""
    return ", ".join(
        f"q{i} AS (SELECT u.dst AS node, sum(r / o) AS got FROM s{i} JOIN u ON u.src = s{i}.node GROUP BY 1), s{i + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE * n.base + 0.85::DOUBLE * coalesce(got, 0) AS r, n.o, n.base FROM n LEFT JOIN q{i} USING (node))"
        for i in range(rounds)
    )


_P = """WITH l AS (SELECT DISTINCT l_orderkey AS plan_id, l_linenumber AS node FROM lineitem), raw AS (SELECT plan_id, node - 1 AS src, node AS dst FROM l UNION ALL SELECT plan_id, node - 2, node FROM l WHERE node % 3 = 0),
e AS (SELECT DISTINCT raw.* FROM raw JOIN l ON l.plan_id = raw.plan_id AND l.node = raw.src)"""

QUERIES = {
    "graph_contains_build": (contains_build, """
WITH r AS (SELECT DISTINCT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT 'nation:' || n_nationkey, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT *, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS ord FROM r"""),
    "graph_degree": (degree, f"{_E}, g AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1) SELECT *, round(degree / (greatest((SELECT count(*) FROM g) - 1, 1))::DOUBLE, 8) AS centrality FROM g"),
    "graph_components": (components, f"{_E}, c AS (SELECT src AS node, src AS r FROM u UNION SELECT dst, r FROM c JOIN u ON c.node = u.src) SELECT node, min(r) AS component FROM c GROUP BY 1"),
    "graph_triangles": (triangles, f"""{_E}, g AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1),
t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst),
n AS (SELECT node, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS node FROM t) GROUP BY 1)
SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2.0) ELSE 0 END, 6) AS clustering FROM g LEFT JOIN n USING (node)"""),
    "graph_pagerank": (pagerank, f"""{_E}, n AS (SELECT node, (SELECT count(*) FROM e WHERE e.src = x.node) AS o FROM (SELECT DISTINCT src AS node FROM u) x),
s0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r, o FROM n), {_RANKS} SELECT node, round(r, 10) AS rank FROM s5"""),
    "graph_label_propagation": (label_propagation, f"{_E}, {_LABELS} SELECT node, label FROM l3"),
    "graph_shortest_path": (shortest_path, f"""{_E}, p AS (SELECT min(src) AS source, min(src) AS node, 0 AS distance FROM u UNION SELECT source, u.dst, distance + 1 FROM p JOIN u ON p.node = u.src WHERE distance < 40)
SELECT source, node, min(distance)::INT AS distance FROM p GROUP BY 1, 2"""),
    "graph_simple_paths3": (simple_paths, f"""{_E}, p AS (SELECT [src, dst] AS path FROM e WHERE src % 50 = 0 UNION ALL SELECT list_append(path, e.dst) FROM p JOIN e ON e.src = path[-1] WHERE len(path) < 4)
SELECT array_to_string(path, ',') AS path FROM p"""),
    "graph_betweenness": (betweenness, None),
    "graph_modularity": (modularity, f"""{_E}, {_LABELS}, s AS (SELECT a.label AS community, count(*) AS degree, sum(CASE WHEN a.label = b.label THEN 0.5 ELSE 0 END)::DOUBLE AS "inner", count(DISTINCT src) AS size
  FROM u JOIN l3 a ON a.node = u.src JOIN l3 b ON b.node = u.dst GROUP BY 1)
SELECT community, size, "inner", degree, round("inner" / ((SELECT count(*) FROM u) / 2.0) - pow(degree / (SELECT count(*) FROM u)::DOUBLE, 2), 8) AS part FROM s"""),
    "hyper_document_groups": (document_groups, f"{_M} SELECT edge_id, edge_type, count(*) AS size, array_to_string(list_sort(list(node_id)), ',') AS members FROM m GROUP BY 1, 2"),
    "hyper_influence": (influence, f"{_M} SELECT node_id, count(DISTINCT edge_id) AS n_edges, count(DISTINCT edge_type) AS n_types, n_edges * n_types AS influence FROM m GROUP BY 1 HAVING n_edges >= 3"),
    "hyper_gap": (gaps, f"""{_M}, b AS (SELECT edge_id FROM m GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT node_id, count(*) - 1 AS others FROM m GROUP BY 1 HAVING others <= 20)
SELECT edge_id, node_id, others, round(1 / (others + 1)::DOUBLE, 6) AS gap FROM m SEMI JOIN b USING (edge_id) JOIN k USING (node_id)"""),
    "hyper_patterns": (patterns, """
WITH m AS (SELECT DISTINCT o_orderpriority AS ty, l_orderkey AS id, l_suppkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey), z AS (SELECT id, count(*) AS n FROM m GROUP BY 1),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM m a JOIN m b ON a.ty = b.ty AND a.node = b.node AND a.id < b.id GROUP BY 1, 2 HAVING c >= 3),
f AS (SELECT x, y FROM p JOIN z zx ON zx.id = x JOIN z zy ON zy.id = y WHERE c / (zx.n + zy.n - c)::DOUBLE > 0.5)
SELECT edge_id, count(*) AS n_links FROM (SELECT x AS edge_id FROM f UNION ALL SELECT y FROM f) GROUP BY 1"""),
    "hyper_diffusion": (diffusion, f"""{_M}, r0 AS (SELECT DISTINCT node_id FROM m WHERE node_id % 50 = 0), r1 AS (SELECT DISTINCT node_id FROM m WHERE edge_id IN (SELECT edge_id FROM m SEMI JOIN r0 USING (node_id))),
r2 AS (SELECT DISTINCT node_id FROM m WHERE edge_id IN (SELECT edge_id FROM m SEMI JOIN r1 USING (node_id))),
r3 AS (SELECT DISTINCT node_id FROM m WHERE edge_id IN (SELECT edge_id FROM m SEMI JOIN r2 USING (node_id))),
a AS (SELECT node_id, 0 AS distance FROM r0 UNION ALL SELECT node_id, 1 FROM r1 UNION ALL SELECT node_id, 2 FROM r2 UNION ALL SELECT node_id, 3 FROM r3), b AS (SELECT node_id, min(distance)::INT AS distance FROM a GROUP BY 1)
SELECT distance, count(*) AS n, min(node_id) AS first FROM b GROUP BY 1"""),
    "layer_fusion": (layer_fusion, """
WITH x AS (SELECT doc_id AS node, least(n_chars, 5000) / 5000.0::DOUBLE AS s FROM documents UNION ALL SELECT page_id, 0.7::DOUBLE / len(string_split(url, '/')) FROM pages UNION ALL SELECT doc_id, 0.4::DOUBLE * quality FROM labels),
y AS (SELECT node AS node_id, sum(s) AS total FROM x GROUP BY 1) SELECT node_id, round(total / (SELECT max(total) FROM y), 6) AS score FROM y"""),
    "semantic_cluster_best": (cluster_best, "WITH s AS (SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS score FROM embeddings) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1"),
    "kmeans_clusters": (kmeans, None),
    "plan_topo_levels": (topo_levels, f"""{_P.replace('WITH l', 'WITH RECURSIVE l')}, d AS (SELECT plan_id, node, 1 AS level FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.plan_id = l.plan_id AND e.dst = l.node)
  UNION SELECT e.plan_id, e.dst, level + 1 FROM d JOIN e ON e.plan_id = d.plan_id AND e.src = d.node) SELECT plan_id, node, max(level)::INT AS level FROM d GROUP BY 1, 2"""),
    "plan_ready_set": (ready_set, f"""{_P}, s AS (SELECT l_orderkey AS plan_id, l_linenumber AS node, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT plan_id, node FROM s WHERE f <> 'R' AND NOT EXISTS (SELECT 1 FROM e JOIN s x ON x.plan_id = e.plan_id AND x.node = e.src WHERE e.plan_id = s.plan_id AND e.dst = s.node AND x.f <> 'R')"""),
    "plan_join_prompts": (join_prompts, """
WITH x AS (SELECT l_orderkey AS plan_id, CASE WHEN l_linenumber < 6 THEN min(l_partkey) END AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CASE WHEN p IS NULL THEN 'no prompt id' WHEN p_name IS NULL THEN 'unknown prompt' ELSE 'ok' END AS status, count(*) AS n, count(DISTINCT plan_id) AS plans FROM x LEFT JOIN part ON p = p_partkey AND p_size <= 40 GROUP BY 1"""),
}


def _part_nodes(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("node"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), r"\s+").alias("terms"))


def _keywords(spark, d):
    return t(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.split(F.lower("p_type"), r"\s+")).alias("keyword"))


def structural(spark, d):
    return graph.structural_best(_bought_together(spark, d), _part_nodes(spark, d), _keywords(spark, d), 5)


def communities(spark, d):
    """Communities are the components of parts bought together."""
    from tessella.operators.relational import top_per_key

    c = components(spark, d).select("node", F.col("component").alias("community"))
    s = graph.community_search(c, _part_nodes(spark, d), _keywords(spark, d)).withColumn("score", F.round("score", 6))
    return top_per_key(s, ["query_id"], [F.desc("score"), F.col("community")], 3)


def concept_hierarchy(spark, d):
    """Regions, their nations and the nations' market segments, as paths."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.concat_ws("/", "n_name", "c_mktsegment").alias("dst"))
    return graph.descendants(n.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")).union(c), t(spark, d, "region").select(F.col("r_name").alias("node")), 2)


def induced_edges(spark, d):
    e = _bought_together(spark, d)
    return graph.induced(e, t(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))).select("src", "dst")


def personal_pagerank(spark, d):
    """Rank from the smallest parts on."""
    restart = t(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("weight"))
    e = graph.undirected(_bought_together(spark, d))
    return graph.pagerank(e, restart, rounds=5).withColumn("rank", F.round("rank", 9))


def acyclic_check(spark, d):
    """Orders as plans whose lines wait for the line before them, and the first also for a line sent back: a cycle."""
    lines, e = _plans(spark, d)
    back = lines.where("l_returnflag = 'R'").groupBy("plan_id").agg(F.max("node").alias("src")).join(lines.groupBy("plan_id").agg(F.min("node").alias("dst")), "plan_id").where("src > dst")
    return plangraph.cyclic_plans(lines, e.unionByName(back))


def execute(spark, d):
    """Plans run level by level; lines sent back fail and stop what comes after."""
    lines, _ = _plans(spark, d)
    levels = topo_levels(spark, d)
    out = plangraph.run_levels(levels, lines.select("plan_id", "node", (F.col("l_returnflag") != "R").alias("ok")))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("plan_id").alias("plans"))


def iterations(spark, d):
    tasks = t(spark, d, "orders").select("o_orderkey", F.filter(F.split("o_orderpriority", "[ -]+"), lambda x: F.length(x) > 4).alias("iterations"))
    return plangraph.expand_iterations(tasks)


def ensembles(spark, d):
    e = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("weight"), F.avg(F.when(F.col("value") > 5, 1.0).otherwise(0.0)).alias("consistency"))
    return plangraph.ensemble_weights(e, ["user_id"], "weight", "consistency").select("user_id", "event_type", F.round("final_weight", 6).alias("final_weight"), "mode")


_KW = """k AS (SELECT DISTINCT p_partkey AS query_id, unnest(string_split_regex(lower(p_type), '\\s+')) AS keyword FROM part WHERE p_partkey % 50 = 0),
t AS (SELECT DISTINCT p_partkey AS node, unnest(string_split_regex(lower(concat_ws(' ', p_name, p_type, p_brand)), '\\s+')) AS keyword FROM part), z AS (SELECT query_id, count(*) AS nk FROM k GROUP BY 1)"""

QUERIES |= {
    "graph_structural_search": (structural, f"""{_E}, {_KW}, g AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1), c AS (SELECT node, degree / (greatest((SELECT count(*) FROM g) - 1, 1))::DOUBLE AS centrality FROM g),
h AS (SELECT query_id, node, count(*) AS hits FROM k JOIN t USING (keyword) GROUP BY 1, 2),
s AS (SELECT query_id, node, round(0.6::DOUBLE * hits / nk + 0.2::DOUBLE * coalesce(centrality, 0), 6) AS score FROM h JOIN z USING (query_id) LEFT JOIN c USING (node))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank FROM s QUALIFY rank <= 5"""),
    "graph_community_search": (communities, f"""{_E}, {_KW}, w AS (SELECT src AS node, src AS r FROM u UNION SELECT dst, r FROM w JOIN u ON w.node = u.src), c AS (SELECT node, min(r) AS community FROM w GROUP BY 1),
y AS (SELECT community, count(*) AS size FROM c GROUP BY 1), q AS (SELECT DISTINCT community, keyword FROM t JOIN c USING (node)), h AS (SELECT query_id, community, count(*) AS hits FROM k JOIN q USING (keyword) GROUP BY 1, 2),
s AS (SELECT query_id, community, size, round(hits / nk::DOUBLE * CASE WHEN size < 3 THEN 0.5 WHEN size > 50 THEN 0.7 ELSE 1 END, 6) AS score FROM h JOIN z USING (query_id) JOIN y USING (community))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM s QUALIFY rank <= 3"""),
    "concept_hierarchy": (concept_hierarchy, """
WITH s AS (SELECT DISTINCT r_name, n_name, n_name || '/' || c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS root, r_name AS node, 0 AS depth, r_name AS path FROM region UNION ALL SELECT r_name, n_name, 1, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, seg, 2, r_name || ' > ' || n_name || ' > ' || seg FROM s"""),
    "graph_induced": (induced_edges, f"{_E} SELECT src, dst FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT p_partkey FROM part WHERE p_size <= 25)"),
    "graph_personal_pagerank": (personal_pagerank, f"""{_E}, x AS (SELECT DISTINCT src AS node FROM u), b AS (SELECT sum(1) AS total FROM part WHERE p_size = 1),
n AS (SELECT node, (SELECT count(*) FROM u WHERE u.src = x.node) AS o, (CASE WHEN EXISTS (SELECT 1 FROM part WHERE p_size = 1 AND p_partkey = node) THEN 1.0 ELSE 0 END) / (SELECT total FROM b)::DOUBLE AS base FROM x),
s0 AS MATERIALIZED (SELECT node, base AS r, o, base FROM n), {_personal(5)} SELECT node, round(r, 9) AS rank FROM s5"""),
    "plan_acyclic_check": (acyclic_check, f"""{_P.replace('WITH l', 'WITH RECURSIVE l')}, y AS (SELECT l_orderkey AS plan_id, l_linenumber AS node, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
k AS (SELECT plan_id, max(node) FILTER (f = 'R') AS src, min(node) AS dst FROM y GROUP BY 1), g AS (SELECT * FROM e UNION SELECT plan_id, src, dst FROM k WHERE src > dst),
w AS (SELECT plan_id, node, 0 AS steps FROM l UNION SELECT g.plan_id, g.dst, steps + 1 FROM w JOIN g ON g.plan_id = w.plan_id AND g.src = w.node WHERE steps < 12)
SELECT plan_id, count(DISTINCT node) AS n_stuck FROM w WHERE steps = 12 GROUP BY 1"""),
    "plan_execute": (execute, f"""{_P.replace('WITH l', 'WITH RECURSIVE l')}, d AS (SELECT plan_id, node, 1 AS level FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.plan_id = l.plan_id AND e.dst = l.node)
  UNION SELECT e.plan_id, e.dst, level + 1 FROM d JOIN e ON e.plan_id = d.plan_id AND e.src = d.node), v AS (SELECT plan_id, node, max(level) AS level FROM d GROUP BY 1, 2),
s AS (SELECT l_orderkey AS plan_id, l_linenumber AS node, min(l_returnflag) <> 'R' AS ok FROM lineitem GROUP BY 1, 2), j AS (SELECT * FROM v JOIN s USING (plan_id, node)),
x AS (SELECT *, min(level) FILTER (NOT ok) OVER (PARTITION BY plan_id) AS stop FROM j)
SELECT CASE WHEN level > stop THEN 'skipped' WHEN ok THEN 'done' ELSE 'failed' END AS status, count(*) AS n, count(DISTINCT plan_id) AS plans FROM x GROUP BY 1"""),
    "task_iterations": (iterations, """
WITH i AS (SELECT o_orderkey, list_filter(string_split_regex(o_orderpriority, '[ -]+'), lambda x: length(x) > 4) AS v FROM orders)
SELECT o_orderkey, unnest(CASE WHEN len(v) > 0 THEN v ELSE [NULL] END) AS iteration_value FROM i"""),
    "ensemble_weights": (ensembles, """
WITH e AS (SELECT user_id, event_type, count(*) AS w, avg(CASE WHEN value > 5 THEN 1.0 ELSE 0 END) AS c FROM events GROUP BY 1, 2),
f AS (SELECT *, sum(w * c * c) OVER (PARTITION BY user_id) AS total, avg(c) OVER (PARTITION BY user_id) AS mean FROM e)
SELECT user_id, event_type, round(CASE WHEN total > 0 THEN w * c * c / total ELSE w END, 6) AS final_weight, CASE WHEN mean >= 0.7 THEN 'selection' ELSE 'synthesis' END AS mode FROM f"""),
}


def _typed_edges(spark, d):
    kind = F.when((F.col("src") + F.col("dst")) % 3 == 0, "REFERENCES").otherwise("SIMILAR")
    return _bought_together(spark, d).select("src", "dst", ((F.col("dst") % 5 + 1) / 5).alias("weight"), kind.alias("edge_type"))


def simple_path_scores(spark, d):
    """Paths of up to four steps from parts divisible by 50 to the parts of their brand."""
    p = t(spark, d, "part").select("p_partkey", "p_brand")
    starts = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("start"), F.col("p_brand").alias("group"))
    found = graphsearch.path_scores(graphsearch.paths_within(_typed_edges(spark, d), starts, p.select(F.col("p_partkey").alias("end"), F.col("p_brand").alias("group"))))
    return found.select(F.array_join("path", ",").alias("path"), F.round("score", 6).alias("score"))


def path_search(spark, d):
    e = _typed_edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_type"))
    found = graphsearch.path_search(both, _part_nodes(spark, d), _keywords(spark, d))
    return found.select("query_id", F.array_join("path", ",").alias("path"), "references", F.round("score", 6).alias("score"))


def _text_nodes(spark, d):
    """Documents with a vector of their number, and their distinct terms."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(terms("text")).alias("terms"))
    return docs.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), "id").select("id", "embedding", "terms", "label")


def hypergraph_search(spark, d):
    """Documents divisible by 50, with their first three terms and their vector, if any, over all documents: those with a vector in clusters, all in sources."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(terms("text")).alias("terms"), "source")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    n = docs.join(vectors, "id", "left").select("id", "embedding", "terms")
    clusters = vectors.where("label IS NOT NULL").select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("edge_id"), F.lit("semantic_cluster").alias("edge_type"), F.col("id").alias("node_id"))
    sources = docs.where("source IS NOT NULL").select(F.concat(F.lit("s"), "source"), F.lit("reference"), "id")
    asked = n.where("id % 50 = 0").withColumn("terms", F.slice("terms", 1, 3))
    return graphsearch.hypergraph_search(asked, n, clusters.unionAll(sources))


def semantic_nodes(spark, d):
    """Vectors of graph nodes alone: documents in the graph, searched by those divisible by 50."""
    n = _text_nodes(spark, d).select("id", "embedding")
    return retrieval.vector_search(n.where("id % 50 = 0"), n, 5, least=0.0)


LAYER_WORDS = ["steel", "promo", "brand"]


def cross_layers(spark, d):
    """Parts by content, structure, attributes and references for one list of keywords, fused and divided by the best."""
    path = F.concat_ws(" > ", "p_brand", "p_type")
    parts = t(spark, d, "part").withColumn("path", path).select(F.col("p_partkey").alias("node_id"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"\s+").alias("terms"), "path", "p_name", "p_type", "p_brand")
    e = graph.undirected(_bought_together(spark, d))
    restart = parts.where("exists(terms, x -> x IN ('steel', 'promo'))").select(F.col("node_id").alias("node"), F.lit(1.0).alias("weight"))
    ranks = graph.pagerank(e, restart, rounds=3)
    layers = graphsearch.layer_scores(parts, LAYER_WORDS, "path", ["p_name", "p_type", "p_brand"], ranks)
    return hypergraph.fuse_layers(layers, {"content": 1.0, "structure": 0.7, "reference": 0.6, "metadata": 0.4}).withColumn("score", F.round("score", 6))


def structural_between(spark, d):
    """Keyword share, degree and sampled betweenness of nodes."""
    e = _bought_together(spark, d)
    between = graph.betweenness(e, graph.sampled_pivots(e))
    return graph.structural_best(e, _part_nodes(spark, d), _keywords(spark, d), 5, between=between)


def schema_check(spark, d):
    """Customers, orders and suppliers as a graph whose edges are held against a schema."""
    nodes = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.lit("customer").alias("node_type"))
    nodes = nodes.unionAll(t(spark, d, "orders").where("o_orderkey % 7 > 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderstatus") == "P", "open").otherwise("order")))
    edges = t(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"), F.when(F.col("o_orderpriority").startswith("1"), "URGENT").otherwise("PLACED").alias("edge_type"))
    return graphsearch.schema_violations(nodes, edges, ["customer", "order"], {"PLACED": ("customer", "order")})


_TYPED = f"{_E}, te AS (SELECT src, dst, (dst % 5 + 1) / 5.0::DOUBLE AS weight, ((src + dst) % 3 = 0)::INT AS ref FROM e)"
_NODES = "n AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS terms, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS raw, embedding::DOUBLE[] AS v, label, source FROM documents JOIN embeddings ON doc_id = vec_id)"

QUERIES |= {
    "graph_path_scores": (simple_path_scores, f"""{_TYPED}, p AS (SELECT [src, dst] AS path, weight AS w FROM te WHERE src % 50 = 0 UNION ALL SELECT list_append(path, te.dst), w + weight FROM p JOIN te ON te.src = path[-1] WHERE len(path) < 5)
SELECT array_to_string(path, ',') AS path, round(w / len(path), 6) AS score FROM p JOIN part a ON a.p_partkey = path[1] JOIN part b ON b.p_partkey = path[-1] AND a.p_brand = b.p_brand"""),
    "graph_path_search": (path_search, f"""{_E}, te AS (SELECT src, dst, ((src + dst) % 3 = 0)::INT AS ref FROM u), {_KW}, hit AS (SELECT DISTINCT query_id, node FROM k JOIN t USING (keyword)),
st AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node) <= 10),
p AS (SELECT [src, dst] AS path, ref AS r FROM te WHERE src IN (SELECT node FROM st) UNION ALL SELECT list_append(path, te.dst), r + ref FROM p JOIN te ON te.src = path[-1] AND NOT list_contains(path, te.dst) WHERE len(path) < 4),
f AS (SELECT a.query_id, path, r FROM p JOIN st a ON a.node = path[1] JOIN st b ON b.query_id = a.query_id AND b.node = path[-1] AND b.node > a.node
  QUALIFY row_number() OVER (PARTITION BY a.query_id, list_sort(path) ORDER BY r DESC, path) = 1),
m AS (SELECT f.query_id, path, r, count(DISTINCT t.keyword) AS matches FROM (SELECT *, unnest(path) AS node FROM f) f JOIN t USING (node) JOIN k ON k.query_id = f.query_id AND k.keyword = t.keyword GROUP BY 1, 2, 3)
SELECT query_id, array_to_string(path, ',') AS path, r AS "references", round(matches / (0.5::DOUBLE * len(path)) * (1 + 0.2::DOUBLE * r), 6) AS score FROM m"""),
    "hypergraph_search": (hypergraph_search, f"""
WITH {_NODES.replace('FROM documents JOIN', 'FROM documents LEFT JOIN')}, c AS (SELECT id, CASE WHEN label IS NOT NULL THEN 1.2 ELSE 1.1 END::DOUBLE AS w FROM n WHERE label IS NOT NULL OR source IS NOT NULL),
s AS (SELECT a.id AS query_id, b.id, round((0.7::DOUBLE * coalesce(list_cosine_similarity(a.v, b.v), 0) + 0.3::DOUBLE * len(list_intersect(q.q, b.terms)) / greatest(1, len(q.q))) * w, 6) AS score
  FROM n a JOIN (SELECT doc_id AS id, list_transform(range(1, least(len(x), 3) + 1), lambda i: x[i]) AS q FROM (SELECT id AS doc_id, list_filter(raw, lambda y, i: list_position(raw, y) = i) AS x FROM n)) q ON q.id = a.id JOIN n b ON a.id % 50 = 0 AND a.id <> b.id JOIN c ON c.id = b.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"""),
    "graph_semantic_search": (semantic_nodes, f"""
WITH {_NODES}, s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM n a JOIN n b ON a.id % 50 = 0 AND a.id <> b.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0 QUALIFY rank <= 5"""),
    "cross_layer_fusion": (cross_layers, f"""{_E}, pt AS (SELECT p_partkey AS node, list_distinct(string_split_regex(lower(p_name || ' ' || p_type), '\\s+')) AS terms, p_brand || ' > ' || p_type AS path, p_name, p_type, p_brand FROM part),
x AS (SELECT DISTINCT src AS node FROM u), rs AS (SELECT node FROM pt WHERE list_has_any(terms, ['steel', 'promo'])), tot AS (SELECT count(*) AS total FROM rs),
n AS (SELECT node, (SELECT count(*) FROM u WHERE u.src = x.node) AS o, (CASE WHEN node IN (SELECT node FROM rs) THEN 1.0 ELSE 0 END) / (SELECT total FROM tot)::DOUBLE AS base FROM x), s0 AS MATERIALIZED (SELECT node, base AS r, o, base FROM n), {_personal(3)},
hits AS (SELECT node, len(list_intersect(terms, ['steel', 'promo', 'brand'])) / 3.0::DOUBLE AS content, CASE WHEN contains(lower(path), 'steel') OR contains(lower(path), 'promo') OR contains(lower(path), 'brand') THEN 1 / 3.0::DOUBLE ELSE 0 END AS structure,
  list_sum(list_transform([p_name, p_type, p_brand], lambda a: (contains(lower(a), 'steel') OR contains(lower(a), 'promo') OR contains(lower(a), 'brand'))::INT)) AS metadata FROM pt),
al AS (SELECT node, content AS s FROM hits WHERE content > 0 UNION ALL SELECT node, 0.7::DOUBLE * structure FROM hits WHERE structure > 0 UNION ALL SELECT node, 0.4::DOUBLE * metadata FROM hits WHERE metadata > 0 UNION ALL SELECT node, 0.6::DOUBLE * r FROM s3),
y AS (SELECT node AS node_id, sum(s) AS total FROM al GROUP BY 1) SELECT node_id, round(total / (SELECT max(total) FROM y), 6) AS score FROM y"""),
    "graph_structural_between": (structural_between, None),
    "graph_schema_check": (schema_check, """
WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'order' END AS ty FROM orders WHERE o_orderkey % 7 > 0),
e AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown edge type' WHEN ty IS NULL OR c_custkey IS NULL THEN 'missing end' WHEN ty <> 'order' THEN 'wrong ends' END AS problem FROM orders LEFT JOIN n ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'unknown node type' FROM n WHERE ty = 'open') SELECT problem, count(*) AS n FROM e WHERE problem IS NOT NULL GROUP BY 1"""),
}


def retrieve(spark, d):
    """Paths, single parts and components for the words of every fiftieth part's type, fused by reciprocal ranks."""
    parts = _part_nodes(spark, d)
    asked = t(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.split(F.lower("p_type"), r"\s+").alias("terms"))
    e = _bought_together(spark, d).select("src", "dst", F.lit(1.0).alias("weight"), F.when((F.col("src") + F.col("dst")) % 3 == 0, "REFERENCES").otherwise("SIMILAR").alias("edge_type"))
    groups = components(spark, d).select("node", F.col("component").alias("community"))
    return graphretrieve.graph_retrieve(asked, parts, e, graphretrieve.Retrieval(("path", "structural", "community"), "rrf"), groups)


def _retrieve_sql() -> str:
    whole = lambda name, k: QUERIES[name][1].replace(f"QUALIFY rank <= {k}", "")
    return f"""
WITH a AS (SELECT query_id, replace(path, ',', ' > ') AS item, 'path' AS method, score FROM ({QUERIES["graph_path_search"][1]}) UNION ALL
  SELECT query_id, node::VARCHAR, 'structural', score FROM ({whole("graph_structural_search", 5)}) UNION ALL SELECT query_id, 'community ' || community, 'community', score FROM ({whole("graph_community_search", 3)})),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, item) AS place FROM a),
f AS (SELECT query_id, item, string_agg(method, ',' ORDER BY method) AS method, round(sum(1 / (60 + place)::DOUBLE), 6) AS score FROM r GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item, method) AS rank FROM f QUALIFY rank <= 10"""


QUERIES["graph_retrieve"] = (retrieve, _retrieve_sql())


def connected(spark, d):
    """Connectivity among every tenth part: distances over all parts, clustering and centrality among themselves."""
    e = _bought_together(spark, d)
    m = connectivity(e, t(spark, d, "part").where("p_partkey % 10 < 3").select(F.col("p_partkey").alias("node")))
    return m.select("nodes", "pairs", *(F.round(c, 6).alias(c) for c in ("mean_distance", "score", "clustering", "centrality")))


QUERIES["graph_connectivity"] = (connected, f"""{_E}, c AS (SELECT DISTINCT src AS node FROM u WHERE src % 10 < 3), k AS (SELECT count(*) AS n FROM c),
p AS (SELECT node AS source, node, 0 AS distance FROM c UNION SELECT source, u.dst, distance + 1 FROM p JOIN u ON p.node = u.src WHERE distance < 40),
m AS (SELECT source, node, min(distance) AS distance FROM p WHERE source <> node AND node IN (SELECT node FROM c) GROUP BY 1, 2), a AS (SELECT count(*) // 2 AS pairs, avg(distance) AS mean_distance FROM m),
i AS (SELECT src, dst FROM u WHERE src IN (SELECT node FROM c) AND dst IN (SELECT node FROM c)), g AS (SELECT src AS node, count(*) AS d FROM i GROUP BY 1),
t AS (SELECT x.src AS node, count(*) / 2 AS t FROM i x JOIN i y ON x.dst = y.src JOIN i z ON y.dst = z.src AND z.dst = x.src GROUP BY 1),
f AS (SELECT sum(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2.0::DOUBLE) ELSE 0 END) AS cl, sum(d) AS d FROM g LEFT JOIN t USING (node))
SELECT n AS nodes, pairs, round(mean_distance, 6) AS mean_distance, round(1 / mean_distance, 6) AS score, round(coalesce(cl, 0) / n::DOUBLE, 6) AS clustering, round(coalesce(d, 0) / (n * (n - 1))::DOUBLE, 6) AS centrality FROM a, k, f""")


def settled_labels(spark, d):
    """Each part's label when labels have settled, and how many parts have it."""
    found = graph.settled_labels(_bought_together(spark, d))
    return found.join(found.groupBy("label").agg(F.count("*").alias("size")), "label").select("node", "label", "size")


QUERIES["graph_settled_labels"] = (settled_labels, None)
