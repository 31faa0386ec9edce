"""Queries of best-of selections, evaluation reports, budgets and retrieval chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.operators import batching, evaluation, relational, retrieval
from tessella.operators import selection as s
from tessella.plans import search
from tessella.runtime import read_table as t


def _answers(spark, d):
    return s.candidate_sets(t(spark, d, "conversations"), ["conv_id"], "turn", "text").withColumn("means", s.mean_likeness(F.col("sets")))


def consistency(spark, d):
    return _answers(spark, d).select("conv_id", F.size("texts").alias("n"), F.round(s.consistency(F.col("means")), 6).alias("consistency"))


def best_of_n(spark, d):
    place = s.most_like_the_rest(F.col("means"))
    return _answers(spark, d).select("conv_id", place.alias("place"), F.sha2(F.element_at("texts", place), 256).alias("digest"))


def least_perplexity(spark, d):
    """For each user the event type with the lowest perplexity of its values."""
    p = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(evaluation.perplexity(-F.abs("value") / 100), 6).alias("perplexity"))
    return p.groupBy("user_id").agg(F.min_by("event_type", F.struct("perplexity", "event_type")).alias("event_type"), F.min("perplexity").alias("perplexity"))


def majority(spark, d):
    return s.majority(t(spark, d, "events"), ["user_id"], "event_type")


def vector_sets(spark, d):
    """Four vectors each as a text's sentences, against those of the next text."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("text_id"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    texts = e.groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "v"))), lambda x: x.v).alias("a"))
    pairs = texts.join(texts.select((F.col("text_id") - 1).alias("text_id"), F.col("a").alias("b")), "text_id")
    return pairs.select("text_id", *(F.round(c, 6).alias(k) for k, c in s.vector_set_score(F.col("a"), F.col("b")).items()))


def evaluate_all(spark, d):
    """A long report for consecutive turns: metric, type and value."""
    pairs = search._pairs(spark, d)
    g, r = F.col("g"), F.col("r")
    found = [("bleu", "score", evaluation.bleu_unclipped(g, r, 4)), ("meteor", "score", evaluation.meteor(g, r))]
    found += [(f"rouge{n}", k, c) for n in (1, 2) for k, c in evaluation.rouge_n(g, r, n).items()]
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("type"), F.round(c, 6).alias("value")) for m, k, c in found))
    return pairs.select("conv_id", "turn", F.explode(rows).alias("x")).select("conv_id", "turn", "x.*")


def retrieval_quality(spark, d):
    """The ten longest documents of each source as retrieved, those of labelled quality as relevant: ranks, and terms of one side in the other."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("source", "doc_id", "n_chars", "text", (F.col("quality") == 1).alias("good"))
    top = relational.top_per_key(docs.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 10).select("doc_id", "rank")
    rows = docs.join(top, "doc_id", "left")
    words = rows.select("source", "good", F.col("rank").isNotNull().alias("found"), F.explode(F.array_distinct(fx.terms("text"))).alias("term"))
    per_term = words.groupBy("source", "term").agg(F.bool_or("good").alias("good"), F.bool_or("found").alias("found"))
    shares = per_term.groupBy("source").agg(F.count(F.when(F.col("good") & F.col("found"), 1)).alias("both"), F.count(F.when(F.col("good"), 1)).alias("wanted"))
    m = s.relevance(rows, ["source"], "rank", "good").join(shares, "source", "left")
    cover = F.when(F.col("wanted") > 0, F.col("both") / F.col("wanted")).otherwise(0.0)
    return m.select("source", "retrieved", "hits", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")), F.round(cover, 6).alias("term_recall"))


def token_batches(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", fx.estimated_tokens("text").alias("tokens"))
    return batching.budget_batches(docs, "source", "doc_id", "tokens")[1]


def token_batch_numbers(spark, d):
    """The batch of each text, and the tokens of that batch."""
    docs = t(spark, d, "documents").select("source", "doc_id", fx.estimated_tokens("text").alias("tokens"))
    each = batching.budget_batches(docs, "source", "doc_id", "tokens")[0].join(docs, ["source", "doc_id"])
    sums = each.groupBy("source", "batch").agg(F.sum("tokens").alias("batch_tokens"))
    return each.select("source", "doc_id", "batch").join(sums, ["source", "batch"])


def vector_retrieve(spark, d):
    """Vector search, limits, then a second encoder's cosine (the vectors' first half) as the order of what is left."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = retrieval.vector_search(e.where("id % 50 = 0"), e, 20).where("score >= 0.1 AND rank <= 10").drop("rank")
    half = e.select("id", F.slice("embedding", 1, F.floor(F.size("embedding") / 2).cast("int")).cast("array<double>").alias("v"))
    both = found.join(half.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(half, "id", "left")
    scored = both.select("query_id", "id", "score", F.round(s.cosine(F.col("q"), F.col("v")), 6).alias("bi_encoder_score"))
    return relational.top_per_key(scored, ["query_id"], [F.desc("bi_encoder_score"), F.col("id")], 5)


def episodic_build(spark, d):
    """The first five documents as episodic memories."""
    first = t(spark, d, "documents").orderBy("doc_id").limit(5).select("doc_id", "source", "lang")
    numbered = relational.top_per_key(first.withColumn("one", F.lit(1)), ["one"], [F.col("doc_id")], 5, "entity_no").drop("one")
    context = F.to_json(F.struct("source", "lang"))
    return numbered.select(F.concat(F.lit("Tell me about "), F.col("doc_id").cast("string")).alias("query"), F.concat(F.lit("Dummy Entity "), F.col("entity_no").cast("string")).alias("entity"), context.alias("context"))


def corpus_projection(spark, d):
    """Documents as (id, text, metadata), in metadata all columns that are neither, for sources whose name matches whatever its case."""
    docs = t(spark, d, "documents").where(F.col("source").ilike("%S%"))
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))
    return docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text"), rest.alias("metadata"))


def dependency_context(spark, d):
    """Lines of an order with the part names of the lines that they wait for."""
    from tessella.plans.graphs import _plans

    lines, edges = _plans(spark, d)
    results = lines.select("plan_id", F.col("node"), F.col("l_partkey").cast("string").alias("result"))
    found = s.dependency_context(lines.select("plan_id", "node"), edges, results)
    return found.select("plan_id", "node", F.array_join(F.transform("context", lambda x: F.concat(x.src.cast("string"), F.lit("="), x.result)), ",").alias("context"))


_JACCARD = "CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE ELSE 0 END"
_MEANS = f"""
WITH c AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split(text, ''), lambda x: x <> '')) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
m AS (SELECT a.conv_id, a.i, any_value(a.text) AS text, coalesce(avg({_JACCARD}) FILTER (a.i <> b.i), 0) AS mean, count(*) AS n FROM c a JOIN c b USING (conv_id) GROUP BY 1, 2)"""
_COS = "list_cosine_similarity(x.v, y.v)"

#: The plain loop, one text of each source a step: w gives each text its batch.
_BATCHES = """
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) // 4 AS t FROM documents),
z AS (SELECT source, count(*) AS n, count(*) FILTER (t > 8000) AS skipped, CASE WHEN count(*) > 1 THEN greatest(1, floor(7200 / greatest(avg(t), 1)))::INT ELSE 1 END AS size FROM d GROUP BY 1),
o AS (SELECT d.source, doc_id, t, size, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS i FROM d JOIN z USING (source) WHERE t <= 8000),
w AS (SELECT source, doc_id, t, size, i, 0::BIGINT AS batch, 1::BIGINT AS held, t::BIGINT AS used FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.t, o.size, o.i, CASE WHEN w.used + o.t > 8000 OR w.held >= o.size THEN w.batch + 1 ELSE w.batch END,
    CASE WHEN w.used + o.t > 8000 OR w.held >= o.size THEN 1 ELSE w.held + 1 END, CASE WHEN w.used + o.t > 8000 OR w.held >= o.size THEN o.t ELSE w.used + o.t END FROM w JOIN o ON o.source = w.source AND o.i = w.i + 1)"""

QUERIES = {
    "answer_consistency": (consistency, f"{_MEANS} SELECT conv_id, any_value(n)::INT AS n, round(CASE WHEN any_value(n) > 1 THEN avg(mean) ELSE 1 END, 6) AS consistency FROM m GROUP BY 1"),
    "best_of_n": (best_of_n, f"{_MEANS} SELECT conv_id, i::INT AS place, sha256(text) AS digest FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(mean, 9) DESC, i) = 1"),
    "least_perplexity": (least_perplexity, """
WITH p AS (SELECT user_id, event_type, round(exp(avg(abs(value) / 100)), 6) AS perplexity FROM events GROUP BY ALL)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY perplexity, event_type) = 1"""),
    "majority_answer": (majority, """
WITH v AS (SELECT user_id, event_type AS answer, count(*) AS votes FROM events GROUP BY ALL), a AS (SELECT user_id, string_agg(answer, ' | ' ORDER BY answer) AS answers FROM v GROUP BY 1)
SELECT user_id, answer, votes, answers FROM v JOIN a USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, answer) = 1"""),
    "vector_set_score": (vector_sets, f"""
WITH e AS (SELECT vec_id // 4 AS text_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT x.text_id, x.vec_id AS a, y.vec_id AS b, {_COS} AS c FROM e x JOIN e y ON y.text_id = x.text_id + 1),
r AS (SELECT text_id, avg(m) AS r FROM (SELECT text_id, a, max(c) AS m FROM x GROUP BY ALL) GROUP BY 1), p AS (SELECT text_id, avg(m) AS p FROM (SELECT text_id, b, max(c) AS m FROM x GROUP BY ALL) GROUP BY 1)
SELECT text_id, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r + 1e-8::DOUBLE), 6) AS f FROM p JOIN r USING (text_id)"""),
    "evaluation_report": (evaluate_all, f"""
SELECT conv_id, turn, 'bleu' AS metric, 'score' AS type, bleu AS value FROM ({search.QUERIES['bleu'][1]}) UNION ALL SELECT conv_id, turn, 'meteor', 'score', meteor FROM ({search.QUERIES['meteor'][1]})
UNION ALL SELECT conv_id, turn, k[1:6], k[8:8], v FROM (SELECT conv_id, turn, unnest(['rouge1_p', 'rouge1_r', 'rouge1_f', 'rouge2_p', 'rouge2_r', 'rouge2_f']) AS k, unnest([rouge1_p, rouge1_r, rouge1_f, rouge2_p, rouge2_r, rouge2_f]) AS v FROM ({search.QUERIES['rouge'][1]}))"""),
    "retrieval_quality": (retrieval_quality, f"""
WITH d AS (SELECT source, doc_id, n_chars, text, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, CASE WHEN row_number() OVER w <= 10 THEN row_number() OVER w END AS rank FROM d WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id)),
m AS (SELECT source, count(rank) AS retrieved, count(*) FILTER (good AND rank IS NOT NULL) AS hits, count(*) FILTER (good) AS wanted, min(rank) FILTER (good) AS first FROM r GROUP BY 1),
w AS (SELECT source, good, rank IS NOT NULL AS found, unnest({search._TERMS}) AS term FROM r), p AS (SELECT source, term, bool_or(good) AS good, bool_or(found) AS found FROM w GROUP BY 1, 2),
c AS (SELECT source, count(*) FILTER (good AND found) AS both_, count(*) FILTER (good) AS n FROM p GROUP BY 1)
SELECT source, retrieved, hits, round(CASE WHEN retrieved > 0 THEN hits / retrieved::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN wanted > 0 THEN hits / wanted::DOUBLE ELSE 0 END, 6) AS recall,
  round(coalesce(1 / first::DOUBLE, 0), 6) AS mrr, round(CASE WHEN n > 0 THEN both_ / n::DOUBLE ELSE 0 END, 6) AS term_recall FROM m LEFT JOIN c USING (source)"""),
    "token_budget_batches": (token_batches, f"""{_BATCHES}
SELECT z.source, z.n, z.skipped, z.size AS batch_size, coalesce(max(w.batch) + 1, 0) AS batches FROM z LEFT JOIN w USING (source) GROUP BY ALL"""),
    "token_batch_numbers": (token_batch_numbers, f"""{_BATCHES}
SELECT source, doc_id, batch, (sum(t) OVER (PARTITION BY source, batch))::BIGINT AS batch_tokens FROM w"""),
    "vector_retrieve": (vector_retrieve, """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, a.embedding AS q, b.embedding AS v
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
b AS (SELECT query_id, id, score, round(list_cosine_similarity(q[1:len(q) // 2]::DOUBLE[], v[1:len(v) // 2]::DOUBLE[]), 6) AS bi_encoder_score FROM r WHERE score >= 0.1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bi_encoder_score DESC, id) AS rank FROM b QUALIFY rank <= 5"""),
    "episodic_memory_build": (episodic_build, """
SELECT 'Tell me about ' || doc_id AS query, 'Dummy Entity ' || row_number() OVER (ORDER BY doc_id) AS entity, '{"source":"' || source || '","lang":"' || lang || '"}' AS context FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 5)"""),
    "corpus_projection": (corpus_projection, """
SELECT doc_id AS id, sha256(text) AS text, '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS metadata FROM documents WHERE source ILIKE '%S%'"""),
    "dependency_context": (dependency_context, """
WITH l AS (SELECT l_orderkey AS plan_id, l_linenumber AS node, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
e AS (SELECT plan_id, node, node - 1 AS src FROM l UNION ALL SELECT plan_id, node, node - 2 FROM l WHERE node % 3 = 0),
c AS (SELECT e.plan_id, e.node, string_agg(e.src || '=' || s.part, ',' ORDER BY e.src) AS context FROM e JOIN l s ON s.plan_id = e.plan_id AND s.node = e.src GROUP BY 1, 2)
SELECT plan_id, node, coalesce(context, '') AS context FROM l LEFT JOIN c USING (plan_id, node)"""),
}
