"""Queries of filters, limits, ranking, set operations and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import checks, relational
from tessella.runtime import read_table as t


def filter_isin(spark, d):
    return relational.keep_values(t(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_custkey", "o_orderpriority")


def sort_topk(spark, d):
    rows = t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_extendedprice").alias("score"))
    return relational.limit_results(rows, top_k=100)


def limits_topp_topk(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return relational.limit_results(rows, top_p=5000.0, top_k=50)


def op_list_pipeline(spark, d):
    rows = relational.apply_operations(t(spark, d, "lineitem"), [
        {"type": "filter", "params": {"l_returnflag": ["A", "R"]}},
        {"type": "group", "params": {"by": ["l_returnflag", "l_linestatus"], "agg": {"l_quantity": "sum", "l_partkey": "max"}}},
        {"type": "sort", "params": {"by": ["l_returnflag", "l_linestatus"]}},
    ])
    return rows.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2))


def top_lines_per_order(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return relational.top_per_key(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")], 3)


def rrf_rerank(spark, d):
    rows = t(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    ranked = relational.reciprocal_ranks(rows, ["o_orderpriority"])
    return ranked.where("rank <= 20").select("o_orderpriority", "id", "rank", F.round("rrf", 8).alias("rrf"))


def rrf_fusion(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    spent = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    by_balance = c.select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("score"))
    by_orders = c.join(spent, "c_custkey").select("c_nationkey", "c_custkey", F.col("n").cast("double").alias("score"))
    fused = relational.fuse_ranks([by_balance, by_orders], ["c_nationkey"], "c_custkey")
    return relational.top_per_key(fused.withColumn("score", F.round("score", 8)), ["c_nationkey"], [F.desc("score"), F.col("c_custkey")], 10)


def weighted_selection(spark, d):
    e = t(spark, d, "events").select("event_type", "event_id", F.abs("value").alias("weight"))
    return relational.cumulative_pick(e, ["event_type"], "event_id", "weight", F.lit(0.5)).select("event_type", "event_id", F.round("running", 6).alias("running"))


def first_claims(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), "l_orderkey", "l_linenumber")
    return relational.first_claim(rows, "node", ["l_orderkey", "l_linenumber"])


def merge_prefix_union(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("reference"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("reference"), F.col("s_name").alias("name"))
    return relational.merge_with_prefix({"customer": c, "supplier": s}, "reference")


def graph_merge_last_wins(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    return relational.last_wins([c, s], "node")


def set_operations(spark, d):
    c, s = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    name = lambda df, x: df.withColumn("part", F.lit(x))
    return name(c.intersect(s), "both").union(name(n.exceptAll(s.distinct()), "no supplier")).union(name(c.union(s).distinct(), "either"))


def group_agg(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.countDistinct("l_partkey").alias("parts")
    )


def rollup_stats(spark, d):
    docs = t(spark, d, "documents")
    return docs.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("grouping"))


def all_success(spark, d):
    e = t(spark, d, "events")
    return e.groupBy("event_type").agg(F.bool_and(F.col("value") >= 0).alias("all_ok"), F.count_if(F.col("value") >= 50).alias("n_high"), F.max_by("event_id", F.struct("value", "event_id")).alias("best"))


def fk_orphans(spark, d):
    rich = t(spark, d, "orders").where("o_totalprice >= 100000")
    return checks.orphans(t(spark, d, "lineitem"), "l_orderkey", rich, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def duplicate_keys(spark, d):
    docs = t(spark, d, "documents").select(F.sha2("text", 256).alias("digest"))
    return checks.duplicate_keys(docs, ["digest"])


def ttl_expired(spark, d):
    e = t(spark, d, "events")
    return checks.expired(e, "ts", 10, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


def range_violations(spark, d):
    return checks.out_of_range(t(spark, d, "lineitem"), "l_discount", 0.02, 0.08).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def approx_distinct(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


QUERIES = {
    "filter_isin": (filter_isin, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "sort_topk": (sort_topk, "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_extendedprice AS score FROM lineitem ORDER BY score DESC, id LIMIT 100"),
    "limits_topp_topk": (limits_topp_topk, "SELECT c_custkey AS id, c_acctbal AS score FROM customer WHERE c_acctbal >= 5000 ORDER BY score DESC, id LIMIT 50"),
    "op_list_pipeline": (op_list_pipeline, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, max(l_partkey) AS l_partkey_max FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL"),
    "top_lines_per_order": (top_lines_per_order, "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem QUALIFY rank <= 3"),
    "rrf_rerank": (rrf_rerank, "SELECT o_orderpriority, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, round(1.0 / (60 + rank)::DOUBLE, 8) AS rrf FROM orders QUALIFY rank <= 20"),
    "rrf_fusion": (rrf_fusion, """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT c_nationkey, c_custkey, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) AS r FROM customer),
b AS (SELECT c_nationkey, c_custkey, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey)) AS r FROM customer JOIN n ON o_custkey = c_custkey),
f AS (SELECT c_nationkey, c_custkey, round(sum(r), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS rank FROM f QUALIFY rank <= 10"""),
    "weighted_selection": (weighted_selection, """
WITH r AS (SELECT event_type, event_id, sum(abs(value)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) / sum(abs(value)) OVER (PARTITION BY event_type) AS running FROM events)
SELECT event_type, event_id, round(running, 6) AS running FROM r WHERE running >= 0.5 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1"""),
    "first_claims": (first_claims, "SELECT l_partkey AS node, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1"),
    "merge_prefix_union": (merge_prefix_union, "SELECT 'db0_' || c_custkey AS reference, c_name AS name, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT 'db1_' || s_suppkey, s_name, NULL, 'supplier' FROM supplier"),
    "graph_merge_last_wins": (graph_merge_last_wins, "SELECT coalesce(s_suppkey, c_custkey) AS node, coalesce(s_name, c_name) AS name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey"),
    "set_operations": (set_operations, """
SELECT nation, 'both' AS part FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'no supplier' FROM (SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'either' FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier)"""),
    "group_agg": (group_agg, "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL"),
    "rollup_stats": (rollup_stats, "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::BIGINT AS grouping FROM documents GROUP BY ROLLUP (lang, source)"),
    "all_success": (all_success, "SELECT event_type, bool_and(value >= 0) AS all_ok, count(*) FILTER (value >= 50) AS n_high, arg_max(event_id, (value, event_id)) AS best FROM events GROUP BY 1"),
    "fk_orphans": (fk_orphans, "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice >= 100000) GROUP BY 1"),
    "duplicate_keys": (duplicate_keys, "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING n > 1"),
    "ttl_expired": (ttl_expired, "SELECT event_id, event_type FROM events WHERE ts + INTERVAL 10 DAYS < TIMESTAMP '2024-01-31 00:00:00'"),
    "range_violations": (range_violations, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.08 GROUP BY 1"),
    "approx_distinct": (approx_distinct, None),
}
