"""Queries over embedded texts: columns, an index by cells, and semantic sides of hybrid and memory searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.embedding import hashed_counts
from tessella.operators import memory, relational, retrieval, vectorindex
from tessella.plans.memory import _NUMBERED
from tessella.plans.search import _BM25, _TERMS
from tessella.runtime import materialize, shared_path
from tessella.runtime import read_table as t

WIDTH = 64


def _embedded(rows, key: str, text: str = "text"):
    """(id, vector) in double precision, so that scores equal those of any other engine; null for a text without a word."""
    counts = rows.select(F.col(key).alias("id"), hashed_counts(text, WIDTH).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x * x))
    return counts.select("id", F.when(length > 0, F.transform("c", lambda x: x / length)).alias("vector"))


def embed_columns(spark, d):
    """Vectors of each document's text and of its path, a row for each slot that is not 0."""
    docs = t(spark, d, "documents").select("doc_id", "text", F.concat_ws(" > ", "lang", "source").alias("path"))
    parts = [_embedded(docs, "doc_id", c).select(F.col("id").alias("doc_id"), F.lit(n).alias("column"), F.posexplode("vector").alias("slot", "value")) for c, n in (("text", "corpus_vector"), ("path", "hierarchy_vector"))]
    return parts[0].unionAll(parts[1]).where("value <> 0").withColumn("value", F.round("value", 6))


def index_search(spark, d):
    """The ten nearest vectors of each id divisible by 50, through an index of all."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = shared_path(spark, "vector-index")
    vectorindex.build_index(e, path)
    return vectorindex.search_index(e.where("id % 50 = 0"), path, 10)


def semantic_texts(spark, d):
    """The five nearest documents of each benchmark passage by their embeddings."""
    docs, asked = _embedded(t(spark, d, "documents"), "doc_id"), _embedded(t(spark, d, "benchmark"), "item_id")
    return retrieval.vector_search(asked, docs, 5, itself=True)


def hybrid_embedded(spark, d):
    """Embeddings fused with BM25, 0.7 to 0.3."""
    sym = retrieval.bm25_search(t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), t(spark, d, "documents").select("doc_id", "text"))
    return retrieval.hybrid_fused(semantic_texts(spark, d), sym, ["query_id", "id"]).withColumn("score", F.round("score", 5))


def memory_embedded(spark, d):
    """Memories by embedding (cosine over 0.2) and by symbols, merged with weight 0.6, the five best of each query."""
    c = materialize(t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("memory_id"), "text", "role"), "memories")
    v = materialize(_embedded(c, "memory_id"), "memory-vectors")
    sem = retrieval.vector_search(v.where("floor(id / 1000) % 50 = 0"), v, 5).where("score > 0.2").select("query_id", F.col("id").alias("memory_id"), "score")
    episodes = c.select("memory_id", F.col("text").alias("query"), F.col("role").alias("entity"), F.concat_ws(" ", "role", "text").alias("context"))
    sym = memory.episodic_matches(c.where("floor(memory_id / 1000) % 50 = 0").select(F.col("memory_id").alias("query_id"), "text"), episodes).select("query_id", "memory_id", "score")
    merged = memory.merge_scores(sem, sym, ["query_id", "memory_id"], 0.6).withColumn("score", F.round("score", 5))
    return relational.top_per_key(merged, ["query_id"], [F.desc("score"), F.col("memory_id")], 5)


def _vectors_sql(name: str, table: str, key: str, text: str = "text") -> str:
    """CTEs that end in ``name`` (id, v): counts of hashed features over their length, as a list."""
    words = _TERMS.replace("text", text)
    return f"""{name}_w AS (SELECT id, w, count(*) AS n FROM (SELECT {key} AS id, unnest({words}) AS w FROM {table}) GROUP BY 1, 2),
{name}_f AS (SELECT w, unnest([w] || list_transform(range(1, length(w) + 1), lambda i: substr('^' || w || '$', i, 3))) AS f FROM (SELECT DISTINCT w FROM {name}_w)),
{name}_h AS (SELECT w, ('0x' || substr(md5(f), 1, 8))::BIGINT % {WIDTH} AS slot, 1 - 2 * (('0x' || substr(md5(f), 9, 1))::INT & 1) AS sign FROM {name}_f),
{name}_c AS (SELECT id, slot, sum(n * sign)::BIGINT AS c FROM {name}_w JOIN {name}_h USING (w) GROUP BY 1, 2),
{name}_l AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS len FROM {name}_c GROUP BY 1 HAVING sum(c * c) > 0),
{name}_s AS (SELECT l.id, s.slot, coalesce(c, 0) / len AS x FROM {name}_l l CROSS JOIN (SELECT unnest(range({WIDTH})) AS slot) s LEFT JOIN {name}_c c ON c.id = l.id AND c.slot = s.slot),
{name} AS (SELECT id, list(x ORDER BY slot) AS v FROM {name}_s GROUP BY 1)"""


_NEAR = f"""{_vectors_sql('dv', 'documents', 'doc_id')}, {_vectors_sql('bv', 'benchmark', 'item_id')},
near AS (SELECT b.id AS query_id, d.id, round(list_dot_product(b.v, d.v), 6) AS score FROM bv b, dv d),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5)"""

QUERIES = {
    "embed_columns": (embed_columns, f"""WITH docs AS (SELECT doc_id, text, lang || ' > ' || source AS path FROM documents), {_vectors_sql('tv', 'docs', 'doc_id')}, {_vectors_sql('pv', 'docs', 'doc_id', 'path')}
SELECT id AS doc_id, 'corpus_vector' AS "column", slot::INT AS slot, round(x, 6) AS value FROM tv_s WHERE x <> 0 UNION ALL SELECT id, 'hierarchy_vector', slot::INT, round(x, 6) FROM pv_s WHERE x <> 0"""),
    "vector_index_search": (index_search, None),
    "vector_text_search": (semantic_texts, f"WITH {_NEAR} SELECT * FROM sem"),
    "vector_hybrid_embedded": (hybrid_embedded, f"""WITH {_NEAR}, a AS MATERIALIZED (SELECT query_id, id, score * 0.7::DOUBLE AS score FROM sem), b AS MATERIALIZED (SELECT query_id, id, score * (1 - 0.7::DOUBLE) AS score FROM ({_BM25}))
SELECT query_id, id, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2"""),
    "memory_retrieve_embedded": (memory_embedded, f"""
WITH turns AS (SELECT conv_id * 1000 + turn AS memory_id, text FROM conversations), {_vectors_sql('mv', 'turns', 'memory_id')},
near AS (SELECT q.id AS query_id, m.id, round(list_dot_product(q.v, m.v), 6) AS score FROM mv q JOIN mv m ON q.id // 1000 % 50 = 0 AND q.id <> m.id),
a AS MATERIALIZED (SELECT query_id, id AS memory_id, score * 0.6::DOUBLE AS score FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5) WHERE score > 0.2),
b AS MATERIALIZED (SELECT query_id, memory_id, score * (1 - 0.6::DOUBLE) AS score FROM ({_NUMBERED})),
m AS (SELECT query_id, memory_id, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM m QUALIFY rank <= 5"""),
}
