"""Search: vectors, TF-IDF, BM25, fusion and reranking.

A search takes a table of queries and a table to search, both distributed; results are the best rows of each query.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import TERM
from tessella.operators.blocks import best_rows
from tessella.operators.relational import top_per_key
from tessella.operators.termproducts import TermMatrix, by_parts, kept_matrices
from tessella.runtime import materialize


def unit_rows(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of length 1; rows of NaN for null, empty and zero vectors and for those of another width."""
    lists = vectors.combine_chunks()
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    m = np.full((len(lists), width), np.nan)
    if width and (lengths == width).any():
        m[lengths == width] = lists.filter(pa.array(lengths == width)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, np.nan)


def cosines(least: float | None = None, itself: bool = False):
    """A scorer of (id, vector) blocks; an id does not meet itself unless ``itself`` is set, as where the two are ids of different things."""

    def score(queries: pa.Table, rows: pa.Table) -> np.ndarray:
        width = max(queries.column(1).combine_chunks().value_lengths().fill_null(0).to_pylist(), default=0)
        if not width:  # no query has a vector
            return np.full((queries.num_rows, rows.num_rows), -np.inf)
        s = unit_rows(queries.column(1), width) @ unit_rows(rows.column(1), width).T
        if not itself:
            s[queries.column(0).to_numpy()[:, None] == rows.column(0).to_numpy()[None, :]] = np.nan
        s[np.isnan(s) | (np.round(s, 6) < (least if least is not None else -np.inf))] = -np.inf
        return s

    return score


def vector_search(queries: DataFrame, corpus: DataFrame, top_k: int = 10, least: float | None = None, itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the top_k cosines of each query over all of ``corpus``, without the row of its own id unless ``itself`` is set.

    Both tables are (id, vector). Blocks of queries meet blocks of rows in one pass; nothing but each block's best is
    shuffled, and nothing goes through the driver. Null, empty and zero vectors have no score.
    """
    return best_rows(queries, corpus.select(corpus.columns[0], corpus.columns[1]), cosines(least, itself), top_k)


def term_table(docs: DataFrame, doc: str = "doc_id", text: str = "text", bigrams: bool = False) -> DataFrame:
    """(id, term, tf, size): how often each term is in each document, and the document's number of terms.

    Terms are counted within each row, so nothing is shuffled. A table to search is best written once (``materialize``).
    Ids are numbers or texts.
    """
    kind = "string" if docs.schema[doc].dataType.typeName() == "string" else "long"
    schema = pa.schema([("id", pa.string() if kind == "string" else pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("size", pa.int64())])
    find = re.compile(TERM).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [], [], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = find((value.as_py() or "").lower())
                counts = Counter(found)
                if bigrams:
                    counts.update(f"{a} {b}" for a, b in zip(found, found[1:], strict=False))
                for column, values in zip(columns, ([i] * len(counts), counts.keys(), counts.values(), [len(found)] * len(counts)), strict=True):
                    column.extend(values)
                if len(columns[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    columns = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col(doc).cast(kind), text).mapInArrow(count, f"id {kind}, term string, tf long, size long")


def search_table(docs: DataFrame, bigrams: bool = False) -> DataFrame:
    """The written term table of a collection, for one or more searches."""
    return materialize(term_table(docs, bigrams=bigrams), "terms")


def tfidf_search(queries: DataFrame, docs: DataFrame, top_k: int = 5, bigrams: bool = False, table: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) by cosine of TF-IDF vectors; queries are (id, text), documents (doc_id, text).

    idf is ln((1 + N) / (1 + df)) + 1. Documents are read once, into ``table``; their norms take one join of all terms,
    their products only the postings of the queries' terms.
    """
    n = docs.count()
    tf = search_table(docs, bigrams) if table is None else table
    idf = materialize(tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf")), "idf")
    norms = tf.join(idf, "term").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    q = term_table(queries, "id", "text", bigrams).join(idf, "term").select(F.col("id").alias("query_id"), "term", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    q = materialize(q, "asked")
    q_norms = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    asked = q.select("term").distinct()
    products = q.join(tf.join(asked, "term", "left_semi"), "term").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("product"))
    scored = products.join(norms, "id").join(q_norms, "query_id").select("query_id", "id", F.round(F.col("product") / (F.col("norm") * F.col("q_norm")), 6).alias("score"))
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.col("id")], top_k)


def _tfidf_scorer():
    """Cosines of a block of queries (id, terms, weights, norm) and rows (id, terms, counts, norm); the weights hold both idfs of a term."""
    matrix = kept_matrices(lambda queries: (TermMatrix(queries.column(1), queries.column(2)), queries.column(3).to_numpy()))

    def score(queries: pa.Table, rows: pa.Table) -> np.ndarray:
        terms_of, norm = matrix(queries)
        kept, row, code = terms_of.coded(rows.column(1))
        out = terms_of.products(rows.num_rows, row, code, rows.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)[kept].astype(np.float64))
        return np.where(out > 0, out / (rows.column(3).to_numpy()[None, :] * norm[:, None]), -np.inf)

    return score


def tfidf_search_all(queries: DataFrame, docs: DataFrame, top_k: int = 5) -> DataFrame:
    """``tfidf_search`` for queries as many as a share of the documents: blocks of queries meet blocks of documents, and no row is written for a pair.

    A row of either side holds its terms with their counts. Only documents that hold a term of a query are met, with these terms alone.
    """
    n = docs.count()
    tf = search_table(docs)
    if docs.select("doc_id").distinct().count() < n:  # rows of one id are one document
        tf = materialize(tf.groupBy("id", "term").agg(F.sum("tf").alias("tf")), "terms")
    idf = materialize(tf.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf")), "idf")
    counted = term_table(queries, "id", "text").groupBy("id", "term").agg(F.sum("tf").alias("tf"))
    asked = materialize(counted.join(idf, "term").withColumn("qw", F.col("tf") * F.col("idf")), "asked")
    entries = F.sort_array(F.collect_list(F.struct("term", (F.col("qw") * F.col("idf")).alias("w"))))
    q = asked.groupBy("id").agg(entries.alias("x"), F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("norm")).select("id", "x.term", "x.w", "norm")
    known = idf.join(asked.select("term", F.lit(True).alias("met")).distinct(), "term", "left")
    met = F.collect_list(F.when(F.col("met"), F.struct("term", "tf")))
    rows = tf.join(known, "term").groupBy("id").agg(met.alias("x"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    rows = materialize(rows.where(F.size("x") > 0).select("id", "x.term", "x.tf", "norm"), "term-rows")
    return best_rows(q, rows, by_parts(_tfidf_scorer()), top_k)


def bm25_search(queries: DataFrame, docs: DataFrame, top_k: int = 5, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, table: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) by Okapi BM25, scores divided by the query's best; negative idfs become floor * mean idf."""
    n = docs.count()
    tf = search_table(docs) if table is None else table
    raw = materialize(tf.groupBy("term").agg(F.log((n - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("raw"), F.sum("tf").alias("all")), "idf")
    mean_idf, total = raw.agg(F.avg("raw"), F.sum("all")).first()
    mean_size = (total or 0) / max(n, 1)
    idf = raw.select("term", F.when(F.col("raw") < 0, F.lit(floor * (mean_idf or 0.0))).otherwise(F.col("raw")).alias("idf"))
    q = materialize(term_table(queries, "id", "text").select(F.col("id").alias("query_id"), "term", F.col("tf").alias("times")).join(idf, "term"), "asked")
    met = q.join(tf.join(q.select("term").distinct(), "term", "left_semi"), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (mean_size or 1.0)))
    summed = met.groupBy("query_id", "id").agg(F.sum(part).alias("raw_score"))
    best = summed.groupBy("query_id").agg(F.max("raw_score").alias("best"))
    scored = summed.join(best, "query_id").select("query_id", "id", F.round(F.when(F.col("best") > 0, F.col("raw_score") / F.col("best")).otherwise(F.col("raw_score")), 6).alias("score"))
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.col("id")], top_k)


def hybrid_union(semantic: DataFrame, symbolic: DataFrame, weight: float = 0.7) -> DataFrame:
    """Both result lists with scaled scores; an item may come twice."""
    return semantic.withColumn("score", F.col("score") * weight).withColumn("source", F.lit("semantic")).unionByName(symbolic.withColumn("score", F.col("score") * (1 - weight)).withColumn("source", F.lit("symbolic")))


def hybrid_fused(semantic: DataFrame, symbolic: DataFrame, keys: list[str], weight: float = 0.7) -> DataFrame:
    """One row an item: the weighted sum of its scores, a missing one counting 0."""
    a, b = semantic.select(*keys, F.col("score").alias("sem")), symbolic.select(*keys, F.col("score").alias("sym"))
    return a.join(b, keys, "full_outer").select(*keys, (F.coalesce("sem", F.lit(0.0)) * weight + F.coalesce("sym", F.lit(0.0)) * (1 - weight)).alias("score"))
