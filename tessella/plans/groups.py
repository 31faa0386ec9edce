"""Queries of communities, reference chains and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.operators import communities, graph
from tessella.operators.louvain import louvain_communities
from tessella.plans.graphs import _bought_together
from tessella.runtime import materialize
from tessella.runtime import read_table as t


def greedy_communities(spark, d):
    """Each part with its community, the community's size and its part of the modularity."""
    e = materialize(_bought_together(spark, d), "bought-together")
    found = communities.greedy_communities(e)
    parts = graph.modularity(e, found).select("community", "size", F.round("part", 8).alias("part"))
    return found.join(parts, "community").select("node", "community", "size", "part")


def louvain(spark, d):
    """Each part with its community by Louvain's method, the community's size and its part of the modularity."""
    e = materialize(_bought_together(spark, d), "bought-together")
    found = materialize(louvain_communities(e), "louvain")
    parts = graph.modularity(e, found).select("community", "size", F.round("part", 8).alias("part"))
    return found.join(parts, "community").select("node", "community", "size", "part")


def reference_chains(spark, d):
    """Returned lines lead on to the next line of their order, lines of every third part to the one before."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f"))
    name = lambda n: F.concat_ws(":", F.col("o").cast("string"), n.cast("string"))
    more = F.concat_ws(", ", F.when(F.col("f") == "R", name(F.col("n") + 1)), F.when(F.col("p") % 3 == 0, name(F.col("n") - 1)))
    return communities.reference_chains(lines.select((F.col("o") * 10 + F.col("n")).alias("ord"), name(F.col("n")).alias("reference"), more.alias("reference_additional")))


def topic_vectors(spark, d):
    """Memberships and coherence of the labelled groups of embeddings."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), F.col("embedding").alias("vector"))
    return communities.topic_vectors(e).withColumns({c: F.round(c, 6) for c in ("membership", "coherence")})


def topic_keywords(spark, d):
    """Five keywords of each source of documents."""
    return communities.topic_keywords(t(spark, d, "documents").select(F.col("source").alias("topic"), terms("text").alias("terms")))


#: Greedy merges depend on ties; tests hold them against the rule that no merge is left that gains.
QUERIES = {
    "graph_greedy_communities": (greedy_communities, None),
    "graph_louvain": (louvain, None),
    "reference_chains": (reference_chains, """
WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
e AS (SELECT l.o, l.n AS src, k.n AS dst FROM l JOIN l k ON l.o = k.o AND (l.f = 'R' AND k.n = l.n + 1 OR l.p % 3 = 0 AND k.n = l.n - 1)),
r AS (SELECT o, n AS src, n AS dst FROM l UNION SELECT r.o, r.src, e.dst FROM r JOIN e ON e.o = r.o AND e.src = r.dst),
c AS (SELECT o, dst AS n, min(src) AS chain FROM r GROUP BY 1, 2)
SELECT o || ':' || n AS reference, o * 10 + chain AS chain, count(*) OVER (PARTITION BY o, chain) AS size FROM c QUALIFY size > 1"""),
    "topic_vectors": (topic_vectors, """
WITH v AS (SELECT vec_id AS id, label AS topic, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.topic, avg(list_cosine_similarity(a.v, b.v)) AS c FROM v a JOIN v b ON a.topic = b.topic AND a.id < b.id GROUP BY 1),
x AS (SELECT topic, i, sum(v[i] / sqrt(list_dot_product(v, v))) AS s FROM v, range(1, 65) r(i) GROUP BY 1, 2),
s AS (SELECT topic, list(s ORDER BY i) AS s FROM x GROUP BY 1), n AS (SELECT topic, count(*) AS size FROM v GROUP BY 1)
SELECT id, topic, round(list_cosine_similarity(v, s), 6) AS membership, size, round(c, 6) AS coherence FROM v JOIN s USING (topic) JOIN n USING (topic) LEFT JOIN p USING (topic)"""),
    "topic_keywords": (topic_keywords, """
WITH n AS (SELECT source AS topic, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS raw FROM documents),
tf AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(raw) AS term FROM n) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(raw)) AS term FROM n) GROUP BY 1),
s AS (SELECT topic, term, round(tf * ln((SELECT count(*) FROM n)::DOUBLE / df), 6) AS score FROM tf JOIN df USING (term))
SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5"""),
}
