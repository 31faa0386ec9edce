"""Queries of sources and sinks: tables written in another form and read back, plans and libraries as JSON, memories kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import memory, relational, retrieval
from tessella.runtime import read_table as t
from tessella.runtime import shared_path
from tessella.sources import files


def csv_round_trip(spark, d):
    """Suppliers as CSV, read with a schema; a blank number is null."""
    path = shared_path(spark, "csv")
    s = t(spark, d, "supplier")
    files.write_csv(s.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey").cast("string")).otherwise("n/a").alias("nation")), path)
    return files.read_csv(spark, path, "s_suppkey long, s_name string, nation int")


def json_round_trip(spark, d):
    path = shared_path(spark, "json")
    files.write_json(t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    back = files.read_json(spark, path, "conv_id long, turn int, role string, text string")
    return back.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


def graph_round_trip(spark, d):
    """Customers and orders as a graph, saved, found again by its path, and a node's edges counted by type."""
    path = shared_path(spark, "graph")
    nodes = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    edges = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("edge_type"))
    files.write_graph(nodes, edges, path)
    n, e = files.resolve_graph(spark, path)
    return n.join(e, n.node == e.src).groupBy("c_mktsegment", "edge_type").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"))


def document_routes(spark, d):
    """Pages as files named by their url; what no reader takes is rejected with a reason."""
    ext = F.when(F.col("page_id") % 3 == 0, "md").when(F.col("page_id") % 3 == 1, "PDF").otherwise(F.regexp_extract("url", r"\.([a-z]+)(?:[?#].*)?$", 1))
    good, bad = files.routed(t(spark, d, "pages").select("page_id", ext.alias("extension")))
    return good.select("page_id", F.col("route").alias("outcome")).unionAll(bad.select("page_id", "reason"))


def plan_json(spark, d):
    """Orders as plans in JSON: their edges, and the plans that are rejected (of every ninth order the JSON is broken, of every tenth edges lack)."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").cast("string").alias("part"))
    name = lambda c: F.concat(F.lit("node_"), c.cast("string"))
    nodes = F.map_from_entries(F.collect_list(F.struct(name(F.col("n")).alias("k"), F.struct(F.col("part").alias("prompt_id"), F.lit("buy").alias("task_summary")).alias("v"))))
    chain = F.transform(F.filter(F.collect_list("n"), lambda n: n > 1), lambda n: F.struct(name(n - 1).alias("source"), name(n).alias("target")))
    made = lines.groupBy("plan_id").agg(nodes.alias("nodes"), chain.alias("edges"))
    whole = F.to_json(F.when(F.col("plan_id") % 10 == 0, F.struct("nodes", F.lit(None).cast("array<struct<source: string, target: string>>").alias("edges"))).otherwise(F.struct("nodes", "edges")))
    plans = made.select("plan_id", F.when(F.col("plan_id") % 9 == 0, F.lit("[broken")).otherwise(whole).alias("json"))
    _, edges, rejects = files.plan_tables(plans)
    return edges.groupBy("plan_id").agg(F.concat(F.count("*").cast("string"), F.lit(" edges to "), F.max("dst")).alias("outcome")).unionAll(rejects)


def prompt_library(spark, d):
    """Parts by brand, type and name as a nested JSON library, flattened again."""
    p = t(spark, d, "part").select("p_brand", "p_type", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("action"), F.col("p_size").cast("string").alias("size"))
    inner = p.groupBy("p_brand", "p_type").agg(F.map_from_entries(F.collect_list(F.struct("action", F.struct(F.lit("d").alias("description"), F.col("size").alias("template"))))).alias("x"))
    outer = inner.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "x"))).alias("c"))
    return files.library_rows(outer.select(F.to_json(F.create_map("p_brand", "c")).alias("json")))


MEMORY = "query string, entity string, context string, task_id long"


def memory_store(spark, d):
    """Results of BM25 as memories of their task, one for each context, appended in two runs and read back; a store that is not there is empty."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = retrieval.bm25_search(asked, t(spark, d, "documents").select("doc_id", "text"), 3)
    lists = found.groupBy(F.col("query_id").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x.id.cast("string")).alias("contexts"))
    rows = memory.context_rows(lists, F.col("contexts"))
    path = shared_path(spark, "memories")
    before = files.read_or_empty(spark, path, MEMORY)
    for part in (0, 1):
        rows.where(F.col("task_id") % 2 == part).write.mode("append").parquet(path)
    return files.read_or_empty(spark, path, MEMORY).unionByName(before)


def merged_databases(spark, d):
    """Two halves of customers and orders merged: keys with the number of their part, edges following their nodes."""
    nodes = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    edges = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    halves = {f"part{i}": (nodes.where(F.col("node") % 2 == i), edges.where(F.col("src") % 2 == i)) for i in (0, 1)}
    n = relational.merge_with_prefix({k: v[0] for k, v in halves.items()}, "node")
    e = relational.merge_with_prefix({k: v[1] for k, v in halves.items()}, "src")
    return n.join(e.select(F.col("src").alias("node"), "dst"), "node").groupBy("node", "c_mktsegment", "source_file").agg(F.count("*").alias("n"), F.max("dst").alias("last"))


def memory_retrieve(spark, d):
    """Symbolic and semantic matches (cosine over 0.2) merged with weight 0.6, the five best contexts of each query."""
    c = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("doc_id"), "text", "role")
    asked = c.where("floor(doc_id / 1000) % 50 = 0")
    sem = retrieval.tfidf_search_all(asked.select(F.col("doc_id").alias("id"), "text"), c.select("doc_id", "text")).where("score > 0.2").select("query_id", F.col("id").alias("memory_id"), "score")
    episodes = c.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("query"), F.col("role").alias("entity"), F.concat_ws(" ", "role", "text").alias("context"))
    sym = memory.episodic_matches(asked.select(F.col("doc_id").alias("query_id"), "text"), episodes).select("query_id", "memory_id", "score")
    merged = memory.merge_scores(sem, sym, ["query_id", "memory_id"], 0.6).withColumn("score", F.round("score", 5))
    best = relational.top_per_key(merged, ["query_id"], [F.desc("score"), F.col("memory_id")], 5)
    return best.join(episodes.select("memory_id", "context"), "memory_id").select("query_id", "memory_id", "score", F.sha2("context", 256).alias("context"))


def personality_lookup(spark, d):
    """The best mode of each turn."""
    from tessella.plans.memory import personality

    best = relational.top_per_key(personality(spark, d), ["conv_id", "turn"], [F.desc("score"), F.col("mode_id")], 1)
    return best.drop("rank").withColumn("score", F.round("score", 6))


def section_ids(spark, d):
    """Sections as nodes: an id from the document's name and a digest of the path."""
    path = F.concat_ws(" > ", "lang", "source")
    rows = t(spark, d, "documents").select(F.concat(F.lit("section_"), "source", F.lit("_"), F.substring(F.sha2(path, 256), 1, 8)).alias("section_id"), path.alias("path"))
    return rows.groupBy("section_id", "path").agg(F.count("*").alias("n"))


def _sql():
    from tessella.plans.memory import _NUMBERED, QUERIES, _tfidf_turns
    from tessella.plans.search import _BM25

    retrieve = f"""
WITH a AS MATERIALIZED (SELECT query_id, id AS memory_id, score * 0.6::DOUBLE AS score FROM ({_tfidf_turns()}) WHERE score > 0.2), b AS MATERIALIZED (SELECT query_id, memory_id, score * (1 - 0.6::DOUBLE) AS score FROM ({_NUMBERED})),
m AS (SELECT query_id, memory_id, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) <= 5)
SELECT query_id, memory_id, score, sha256(role || ' ' || text) AS context FROM r JOIN conversations ON conv_id * 1000 + turn = memory_id"""
    store = f"""
SELECT 'task ' || query_id AS query, 'context_for_task_' || query_id || '_item_' || (rank - 1) AS entity, id::VARCHAR AS context, query_id AS task_id FROM ({_BM25.replace('rank <= 5', 'rank <= 3')})"""
    lookup = f"SELECT conv_id, turn, mode_id, round(score, 6) AS score FROM ({QUERIES['memory_symbolic_personality'][1]}) QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, mode_id) = 1"
    return retrieve, store, lookup


_RETRIEVE, _STORE, _LOOKUP = _sql()

QUERIES = {
    "csv_round_trip": (csv_round_trip, "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 > 0 THEN s_nationkey END::INT AS nation FROM supplier"),
    "json_round_trip": (json_round_trip, "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations"),
    "graph_round_trip": (graph_round_trip, "SELECT c_mktsegment, o_orderpriority AS edge_type, count(*) AS n, count(DISTINCT c_custkey) AS nodes FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2"),
    "document_routes": (document_routes, r"""
WITH e AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'PDF' ELSE regexp_extract(url, '\.([a-z]+)(?:[?#].*)?$', 1) END AS x FROM pages)
SELECT page_id, CASE WHEN lower(x) IN ('md', 'txt') THEN 'read' WHEN lower(x) = 'pdf' THEN 'convert' ELSE 'unsupported: ' || coalesce(nullif(x, ''), 'no extension') END AS outcome FROM e"""),
    "plan_json": (plan_json, """
WITH l AS (SELECT l_orderkey AS plan_id, l_linenumber AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT plan_id, count(*) FILTER (n > 1) AS e, max('node_' || n) FILTER (n > 1) AS last FROM l GROUP BY 1)
SELECT plan_id, CASE WHEN plan_id % 9 = 0 THEN 'not a plan' WHEN plan_id % 10 = 0 THEN 'no edges' ELSE e || ' edges to ' || last END AS outcome FROM p WHERE plan_id % 9 = 0 OR plan_id % 10 = 0 OR e > 0"""),
    "prompt_library": (prompt_library, "SELECT p_brand AS application, p_type AS category, p_name || ' ' || p_partkey AS action, 'd' AS description, p_size::VARCHAR AS template FROM part"),
    "memory_store": (memory_store, _STORE),
    "merged_databases": (merged_databases, """
SELECT 'db' || c_custkey % 2 || '_' || c_custkey AS node, c_mktsegment, 'part' || c_custkey % 2 AS source_file, count(*) AS n, max(o_orderkey) AS last FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL"""),
    "memory_retrieve": (memory_retrieve, _RETRIEVE),
    "personality_lookup": (personality_lookup, _LOOKUP),
    "section_ids": (section_ids, "SELECT 'section_' || source || '_' || substr(sha256(lang || ' > ' || source), 1, 8) AS section_id, lang || ' > ' || source AS path, count(*) AS n FROM documents GROUP BY ALL"),
}
