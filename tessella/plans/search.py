"""Queries of text and vector search, fusion, limits and metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.operators import evaluation, postings, relational, retrieval
from tessella.runtime import read_table as t
from tessella.runtime import shared_path

STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def _asked(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def tfidf(spark, d):
    return retrieval.tfidf_search(_asked(spark, d), t(spark, d, "documents").select("doc_id", "text"))


def tfidf_bigram(spark, d):
    return retrieval.tfidf_search(_asked(spark, d), t(spark, d, "documents").select("doc_id", "text"), bigrams=True)


def bm25(spark, d):
    return retrieval.bm25_search(_asked(spark, d), t(spark, d, "documents").select("doc_id", "text"))


def bm25_index(spark, d):
    """The search through a written index: a third of the documents first, the others added; parts that cannot reach the best are not read."""
    docs, path = t(spark, d, "documents").select("doc_id", "text"), shared_path(spark, "postings")
    postings.add_documents(spark, path, docs.where("doc_id % 3 = 0"))
    return postings.bm25_over_index(_asked(spark, d), postings.add_documents(spark, path, docs.where("doc_id % 3 > 0")))[0]


def vectors(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_search(e.where("id % 50 = 0"), e, 10)


def vectors_similar(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_search(e.where("id % 50 = 0"), e, 10, least=0.3)


def similar_earlier_only(spark, d):
    """Of the ten most similar vectors, those that come earlier."""
    return vectors_similar(spark, d).where("id < query_id")


def _both(spark, d):
    """TF-IDF and BM25 results over one term table."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    table = retrieval.search_table(docs)
    return retrieval.tfidf_search(_asked(spark, d), docs, table=table), retrieval.bm25_search(_asked(spark, d), docs, table=table)


def hybrid_fused(spark, d):
    return retrieval.hybrid_fused(*_both(spark, d), ["query_id", "id"]).withColumn("score", F.round("score", 5))


def hybrid_union(spark, d):
    semantic, symbolic = _both(spark, d)
    return retrieval.hybrid_union(semantic.drop("rank"), symbolic.drop("rank")).withColumn("score", F.round("score", 5))


def rerank_lexical(spark, d):
    """BM25 results reranked by the share of the query's terms that they hold; a result without its text stays, last."""
    found = bm25(spark, d).select("query_id", F.col("id").alias("doc_id"), "score")
    asked = _asked(spark, d).select(F.col("id").alias("query_id"), F.array_distinct(fx.terms("text")).alias("q"))
    docs = t(spark, d, "documents").select("doc_id", "text")
    held = found.join(asked, "query_id", "left").join(docs, "doc_id", "left")
    overlap = F.coalesce(F.size(F.array_intersect("q", F.array_distinct(fx.terms("text")))) / F.size("q"), F.lit(0.0))
    scored = held.select("query_id", F.col("doc_id").alias("id"), "score", F.round(overlap, 6).alias("encoder_score"))
    return relational.top_per_key(scored, ["query_id"], [F.desc("encoder_score"), F.desc("score"), F.col("id")], 3)


def keyword_extract(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(fx.keywords("text", STOP), " ").alias("keywords"))


def _pairs(spark, d):
    """Consecutive turns as (reference, generated) token arrays."""
    c = t(spark, d, "conversations").select("conv_id", "turn", fx.terms("text").alias("g"))
    return c.withColumn("r", F.lag("g").over(W.partitionBy("conv_id").orderBy("turn"))).where("r IS NOT NULL AND size(g) > 0 AND size(r) > 0")


def bleu(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(evaluation.bleu_unclipped(F.col("g"), F.col("r"), 4), 6).alias("bleu"))


def rouge(spark, d):
    out = [F.round(c, 6).alias(f"rouge{n}_{k}") for n in (1, 2) for k, c in evaluation.rouge_n(F.col("g"), F.col("r"), n).items()]
    return _pairs(spark, d).select("conv_id", "turn", *out)


def rouge_l(spark, d):
    """Precision, recall and F1 of the longest common subsequence of consecutive turns."""
    found = _pairs(spark, d).select("conv_id", "turn", evaluation.rouge_l(F.col("g"), F.col("r")).alias("x"))
    return found.select("conv_id", "turn", "x.lcs", *(F.round(f"x.{c}", 6).alias(f"rougeL_{c}") for c in "prf"))


def meteor(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(evaluation.meteor(F.col("g"), F.col("r")), 6).alias("meteor"))


def jaccard_chars(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", fx.characters("text").alias("g"))
    pairs = c.withColumn("r", F.lag("g").over(W.partitionBy("conv_id").orderBy("turn"))).where("r IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(fx.jaccard(F.col("g"), F.col("r")), 6).alias("jaccard"))


def term_overlap(spark, d):
    """Mean, largest and smallest share of a turn's terms found in the turn before, by conversation, and their weighted sum."""
    share = F.size(F.array_intersect("g", "r")) / F.size(F.array_distinct("g"))
    s = _pairs(spark, d).select("conv_id", share.alias("s")).groupBy("conv_id").agg(F.avg("s").alias("mean"), F.max("s").alias("most"), F.min("s").alias("least"))
    return s.select("conv_id", *(F.round(c, 6).alias(c) for c in ("mean", "most", "least")), F.round(0.5 * F.col("mean") + 0.3 * F.col("most") + 0.2 * F.col("least"), 6).alias("effectiveness"))


def ranking(spark, d):
    """Documents of each source ranked by length, with labelled quality as relevance."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("source", "quality", F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("place"))
    m = evaluation.ranking_metrics(docs, ["source"], "place", "quality")
    return m.select("source", F.round("ndcg", 6).alias("ndcg"), F.round("average_precision", 6).alias("average_precision"))


def perplexities(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(evaluation.perplexity(-F.abs("value") / 100), 6).alias("perplexity"))


_TERMS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"
_PAIRS = f"""
WITH c AS (SELECT conv_id, turn, {_TERMS} AS g FROM conversations),
p AS (SELECT conv_id, turn, g, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM c),
q AS (SELECT * FROM p WHERE r IS NOT NULL AND len(g) > 0 AND len(r) > 0)"""


def _grams(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n} - 1], ' ')) ELSE []::VARCHAR[] END"


def _tfidf_sql(bigrams: bool) -> str:
    def exploded(table: str, key: str) -> str:
        one = f"SELECT {key} AS id, unnest({_TERMS}) AS term FROM {table}"
        two = f"SELECT id, unnest(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS term FROM (SELECT {key} AS id, {_TERMS} AS x FROM {table})"
        return f"SELECT id, term, count(*) AS tf FROM ({one}{' UNION ALL ' + two if bigrams else ''}) GROUP BY 1, 2"

    return f"""
WITH n AS (SELECT count(*) AS n FROM documents), tf AS ({exploded('documents', 'doc_id')}),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf, n GROUP BY 1),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
q AS (SELECT id AS query_id, term, tf * idf AS qw FROM ({exploded('benchmark', 'item_id')}) JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS q_norm FROM q GROUP BY 1),
p AS (SELECT query_id, id, sum(qw * w) AS product FROM q JOIN w USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, id, round(product / (norm * q_norm), 6) AS score FROM p JOIN norms USING (id) JOIN qn USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5"""


_BM25 = f"""
WITH sizes AS (SELECT doc_id AS id, len({_TERMS}) AS size FROM documents), n AS (SELECT count(*) AS n, avg(size) AS mean_size FROM sizes),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents) GROUP BY 1, 2),
raw AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf, n GROUP BY 1),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean_size))) AS raw_score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN sizes USING (id), n GROUP BY 1, 2),
b AS (SELECT *, max(raw_score) OVER (PARTITION BY query_id) AS best FROM s),
f AS (SELECT query_id, id, round(CASE WHEN best > 0 THEN raw_score / best ELSE raw_score END, 6) AS score FROM b)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 5"""


def _vector_sql(least: str = "", tail: str = "") -> str:
    return f"""
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s {least})
SELECT * FROM r WHERE rank <= 10 {tail}"""


QUERIES = {
    "tfidf_search": (tfidf, _tfidf_sql(False)),
    "tfidf_bigram": (tfidf_bigram, _tfidf_sql(True)),
    "bm25_search": (bm25, _BM25),
    "bm25_index_search": (bm25_index, _BM25),
    "vector_semantic_topk": (vectors, _vector_sql()),
    "vector_similar_pairs": (vectors_similar, _vector_sql("WHERE score >= 0.3")),
    "similar_earlier_only": (similar_earlier_only, _vector_sql("WHERE score >= 0.3", "AND id < query_id")),
    "vector_hybrid_fused": (hybrid_fused, f"WITH a AS MATERIALIZED (SELECT query_id, id, score * 0.7::DOUBLE AS score FROM ({_tfidf_sql(False)})), b AS MATERIALIZED (SELECT query_id, id, score * (1 - 0.7::DOUBLE) AS score FROM ({_BM25})) SELECT query_id, id, round(sum(score), 5) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2"),
    "vector_hybrid_union": (hybrid_union, f"SELECT query_id, id, round(score * 0.7, 5) AS score, 'semantic' AS source FROM ({_tfidf_sql(False)}) UNION ALL SELECT query_id, id, round(score * (1 - 0.7::DOUBLE), 5), 'symbolic' FROM ({_BM25})"),
    "rerank_lexical": (rerank_lexical, f"""
WITH f AS ({_BM25}), q AS (SELECT item_id AS query_id, list_distinct({_TERMS}) AS q FROM benchmark), x AS (SELECT doc_id AS id, list_distinct({_TERMS}) AS x FROM documents),
s AS (SELECT query_id, id, score, round(len(list_intersect(q, x)) / len(q)::DOUBLE, 6) AS encoder_score FROM f JOIN q USING (query_id) JOIN x USING (id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY encoder_score DESC, score DESC, id) AS rank FROM s QUALIFY rank <= 3"""),
    "keyword_extract": (keyword_extract, f"""
WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT item_id, w, list_filter(w, lambda x: length(x) > 2 AND NOT list_contains([{', '.join(repr(s) for s in STOP)}], lower(x))) AS k FROM w)
SELECT item_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ') AS keywords FROM k"""),
    "bleu": (bleu, f"""{_PAIRS},
s AS (SELECT conv_id, turn, len(g) AS ng, len(r) AS nr, {', '.join(f"{_grams(x, n)} AS {x}{n}" for x in 'gr' for n in range(1, 5))} FROM q),
h AS (SELECT *, {', '.join(f"len(list_filter(g{n}, lambda x: list_contains(r{n}, x))) AS h{n}" for n in range(1, 5))} FROM s)
SELECT conv_id, turn, round(CASE WHEN {' AND '.join(f'h{n} > 0' for n in range(1, 5))} THEN CASE WHEN ng < nr THEN exp(1 - nr / ng::DOUBLE) ELSE 1 END
  * exp(({' + '.join(f'ln(h{n} / len(g{n})::DOUBLE)' for n in range(1, 5))}) / 4) ELSE 0 END, 6) AS bleu FROM h"""),
    "rouge": (rouge, f"""{_PAIRS},
s AS (SELECT conv_id, turn, list_distinct({_grams('g', 1)}) AS g1, list_distinct({_grams('r', 1)}) AS r1, list_distinct({_grams('g', 2)}) AS g2, list_distinct({_grams('r', 2)}) AS r2 FROM q),
h AS (SELECT conv_id, turn, len(list_intersect(g1, r1)) AS b1, len(g1)::DOUBLE AS ng1, len(r1)::DOUBLE AS nr1, len(list_intersect(g2, r2)) AS b2, len(g2)::DOUBLE AS ng2, len(r2)::DOUBLE AS nr2 FROM s),
k AS (SELECT conv_id, turn, b1 / ng1 AS p1, b1 / nr1 AS q1, CASE WHEN ng2 > 0 THEN b2 / ng2 ELSE 0 END AS p2, CASE WHEN nr2 > 0 THEN b2 / nr2 ELSE 0 END AS q2 FROM h)
SELECT conv_id, turn, round(p1, 6) AS rouge1_p, round(q1, 6) AS rouge1_r, round(CASE WHEN p1 + q1 > 0 THEN 2 * p1 * q1 / (p1 + q1) ELSE 0 END, 6) AS rouge1_f,
  round(p2, 6) AS rouge2_p, round(q2, 6) AS rouge2_r, round(CASE WHEN p2 + q2 > 0 THEN 2 * p2 * q2 / (p2 + q2) ELSE 0 END, 6) AS rouge2_f FROM k"""),
    "rougeL": (rouge_l, f"""{_PAIRS},
l AS (SELECT conv_id, turn, len(g)::DOUBLE AS ng, len(r)::DOUBLE AS nr, list_max(list_reduce([{{'row': list_transform(r, lambda y: 0), 'x': ''}}] || list_transform(g, lambda x: {{'row': []::INT[], 'x': x}}),
  lambda a, b: {{'row': list_transform([list_transform(range(1, len(r) + 1), lambda j: greatest(a.row[j], (CASE WHEN j > 1 THEN a.row[j - 1] ELSE 0 END) + (r[j] = b.x)::INT))], lambda t: list_transform(range(1, len(r) + 1), lambda j: list_max(t[1:j])))[1], 'x': b.x}}).row)::BIGINT AS lcs FROM q)
SELECT conv_id, turn, lcs, round(lcs / ng, 6) AS rougeL_p, round(lcs / nr, 6) AS rougeL_r, round(CASE WHEN lcs > 0 THEN 2 * (lcs / ng) * (lcs / nr) / (lcs / ng + lcs / nr) ELSE 0 END, 6) AS rougeL_f FROM l"""),
    "meteor": (meteor, f"""{_PAIRS},
h AS (SELECT conv_id, turn, len(list_intersect(list_distinct(g), list_distinct(r)))::DOUBLE AS m, len(g)::DOUBLE AS ng, len(r)::DOUBLE AS nr, list_transform(g, lambda x: list_contains(r, x)) AS hit FROM q),
k AS (SELECT *, len(list_filter(range(1, len(hit) + 1), lambda i: hit[i] AND (i = 1 OR NOT hit[i - 1])))::DOUBLE AS runs FROM h)
SELECT conv_id, turn, round(CASE WHEN m > 0 THEN 2 * (m / ng) * (m / nr) / (m / ng + m / nr) * (1 - 0.5 * pow(runs / m, 3)) ELSE 0 END, 6) AS meteor FROM k"""),
    "jaccard_chars": (jaccard_chars, """
WITH c AS (SELECT conv_id, turn, list_distinct(string_split(text, '')) AS g FROM conversations),
p AS (SELECT conv_id, turn, g, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM c)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(g, r))) > 0 THEN len(list_intersect(g, r)) / len(list_distinct(list_concat(g, r)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM p WHERE r IS NOT NULL"""),
    "term_overlap": (term_overlap, f"""{_PAIRS},
s AS (SELECT conv_id, len(list_intersect(list_distinct(g), list_distinct(r))) / len(list_distinct(g))::DOUBLE AS s FROM q),
a AS (SELECT conv_id, avg(s) AS mean, max(s) AS most, min(s) AS least FROM s GROUP BY 1)
SELECT conv_id, round(mean, 6) AS mean, round(most, 6) AS most, round(least, 6) AS least, round(0.5 * mean + 0.3 * most + 0.2 * least, 6) AS effectiveness FROM a"""),
    "ranking_metrics": (ranking, """
WITH x AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i,
    row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS j,
    sum((quality > 0)::INT) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM documents JOIN labels USING (doc_id)),
m AS (SELECT source, sum(CASE WHEN i <= 10 THEN (pow(2, quality) - 1) / log2(i + 1) ELSE 0 END) AS dcg, sum(CASE WHEN j <= 10 THEN (pow(2, quality) - 1) / log2(j + 1) ELSE 0 END) AS idcg,
    coalesce(avg(hits / i::DOUBLE) FILTER (quality > 0), 0) AS ap FROM x GROUP BY 1)
SELECT source, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(ap, 6) AS average_precision FROM m"""),
    "perplexity": (perplexities, "SELECT event_type, round(exp(avg(abs(value) / 100)), 6) AS perplexity FROM events GROUP BY 1"),
}
