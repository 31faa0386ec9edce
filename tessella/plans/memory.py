"""Queries of memories: conversations as episodes, events as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.operators import checks, memory, retrieval
from tessella.runtime import read_table as t


def _episodes(spark, d):
    c = t(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("memory_id"), F.col("text").alias("query"), F.col("role").alias("entity"), F.concat_ws(" ", "role", "text").alias("context"), "conv_id")


def _asked(spark, d):
    c = t(spark, d, "conversations").where("conv_id % 50 = 0")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


def episodic(spark, d):
    return memory.episodic_matches(_asked(spark, d), _episodes(spark, d))


def personality(spark, d):
    """Every conversation turn against three fixed modes."""
    modes = spark.sql("""SELECT * FROM VALUES ('m1', 'analytical', 'logical', 'INTJ', array('ciones', 'report')), ('m2', 'th', 'the', 'ENFP', array('tion and')), ('m3', 'empathetic', 'intuitive', 'INFJ', CAST(NULL AS array<string>))
        AS m(mode_id, personality_type, cognitive_style, mbti_type, contexts)""")
    c = t(spark, d, "conversations").select("conv_id", "turn", "text")
    score = memory.personality_score(F.col("text"), {k: F.col(k) for k in ("personality_type", "cognitive_style", "mbti_type")}, F.col("contexts"))
    return c.join(F.broadcast(modes)).select("conv_id", "turn", "mode_id", score.alias("score")).where("score > 0")  # three rows of a fixed table


def hybrid_full_outer(spark, d):
    """Symbolic matches merged with TF-IDF matches of the same queries."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    c = t(spark, d, "conversations").select(number.cast("long").alias("doc_id"), "text", "role")
    asked = c.where("floor(doc_id / 1000) % 50 = 0")
    sem = retrieval.tfidf_search_all(asked.select(F.col("doc_id").alias("id"), "text"), c.select("doc_id", "text")).select("query_id", F.col("id").alias("memory_id"), "score")
    episodes = c.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("query"), F.col("role").alias("entity"), F.concat_ws(" ", "role", "text").alias("context"))
    sym = memory.episodic_matches(asked.select(F.col("doc_id").alias("query_id"), "text"), episodes).select("query_id", "memory_id", "score")
    return memory.merge_scores(sem, sym, ["query_id", "memory_id"]).withColumn("score", F.round("score", 5))


def save_rejects(spark, d):
    """Turns saved as memories: rows with a blank required field are told apart."""
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("entity"), F.when(F.length("text") >= 100, F.col("text")).otherwise(F.lit("  ")).alias("query"))
    return checks.split_valid(c, ["entity", "query"]).groupBy("missing").agg(F.count("*").alias("n"))


def temporal_range(spark, d):
    e = t(spark, d, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-10 00:00:00' AND TIMESTAMP_NTZ '2024-01-12 12:00:00'")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def iteration_counts(spark, d):
    """Runs of each task from an append-only log, and whether all went well."""
    e = t(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("iterations"), F.bool_and(F.col("value") > 1).alias("success"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


_T = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"
_EPISODIC = f"""
WITH q AS (SELECT conv_id || '-' || turn AS query_id, lower(text) AS q_text, {_T.format('text')} AS qt FROM conversations WHERE conv_id % 50 = 0),
m AS (SELECT conv_id || '-' || turn AS memory_id, lower(role) AS entity, {_T.format('text')} AS mt, {_T.format("role || ' ' || text")} AS ct FROM conversations),
s AS (SELECT query_id, memory_id, len(list_intersect(qt, mt)) AS in_m, len(list_intersect(qt, ct)) AS in_c, len(qt) AS nq, len(mt) AS nm, q_text, entity FROM q, m WHERE len(list_intersect(qt, ct)) > 0),
f AS (SELECT query_id, memory_id, round(CASE WHEN contains(q_text, entity) THEN 0.5 WHEN contains(entity, q_text) THEN 0.4 ELSE 0 END + 0.3::DOUBLE * in_c / nq + 0.4::DOUBLE * in_m / greatest(nq, nm), 6) AS score FROM s)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM f WHERE score > 0 QUALIFY rank <= 5"""

def _tfidf_turns() -> str:
    """TF-IDF over turns, as numbers conv_id * 1000 + turn."""
    from tessella.plans.search import _tfidf_sql

    sql = _tfidf_sql(False).replace("documents", "turns").replace("benchmark", "asked").replace("doc_id", "turn_no").replace("item_id", "turn_no")
    return "WITH turns AS (SELECT conv_id * 1000 + turn AS turn_no, text FROM conversations), asked AS (SELECT * FROM turns WHERE turn_no // 1000 % 50 = 0), " + sql.lstrip().removeprefix("WITH")


_NUMBERED = _EPISODIC.replace("conv_id || '-' || turn", "conv_id * 1000 + turn")

QUERIES = {
    "memory_symbolic_episodic": (episodic, _EPISODIC),
    "memory_symbolic_personality": (personality, """
WITH m AS (SELECT * FROM (VALUES ('m1', 'analytical', 'logical', 'INTJ', ['ciones', 'report']), ('m2', 'th', 'the', 'ENFP', ['tion and']), ('m3', 'empathetic', 'intuitive', 'INFJ', NULL)) v(mode_id, p, c, b, x)),
s AS (SELECT conv_id, turn, mode_id, (CASE WHEN contains(lower(text), p) THEN 0.5 WHEN contains(p, lower(text)) THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(text), lower(b)) THEN 0.5 ELSE 0 END
  + CASE WHEN contains(lower(text), c) THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter(x, lambda y: contains(lower(text), y))) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM conversations, m)
SELECT * FROM s WHERE score > 0"""),
    "hybrid_memory_full_outer": (hybrid_full_outer, f"""
WITH a AS MATERIALIZED (SELECT query_id, id AS memory_id, score * 0.7::DOUBLE AS score FROM ({_tfidf_turns()})), b AS MATERIALIZED (SELECT query_id, memory_id, score * (1 - 0.7::DOUBLE) AS score FROM ({_NUMBERED}))
SELECT query_id, memory_id, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2"""),
    "memory_save_rejects": (save_rejects, "SELECT concat_ws(',', CASE WHEN role = 'system' THEN 'entity' END, CASE WHEN length(text) < 100 OR trim(text) = '' THEN 'query' END) AS missing, count(*) AS n FROM conversations GROUP BY 1"),
    "temporal_range": (temporal_range, "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1"),
    "iteration_counts": (iteration_counts, "SELECT user_id, event_type, count(*) AS iterations, bool_and(value > 1) AS success, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL"),
}
