"""Episodic and personality memories: symbolic and semantic matching, merging, and validated saving."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import terms
from tessella.operators.blocks import best_rows
from tessella.operators.termproducts import TermMatrix, by_parts, kept_matrices
from tessella.runtime import materialize


def episodic_scorer():
    """Scores of a block of queries (id, lower-case text, terms) against memories (id, entity, query terms, context terms)."""
    matrix = kept_matrices(lambda queries: (TermMatrix(queries.column(2)), queries.column(1).to_pylist(), {}))

    def score(queries: pa.Table, rows: pa.Table) -> np.ndarray:
        terms_of, texts, by_entity = matrix(queries)
        n, q_size = rows.num_rows, pc.list_value_length(queries.column(2)).fill_null(0).to_numpy().astype(np.float64)
        m_size = pc.list_value_length(rows.column(2)).fill_null(0).to_numpy().astype(np.float64)
        (_, m_row, m_code), (_, c_row, c_code) = terms_of.coded(rows.column(2)), terms_of.coded(rows.column(3))
        in_m = terms_of.products(n, m_row, m_code, np.ones(len(m_row)))
        in_c, width = in_m.copy(), len(terms_of.vocabulary) + 1  # a context mostly holds the query: only what differs is added
        m_key, c_key = m_row * width + m_code, c_row * width + c_code
        for row, code, differs, sign in ((c_row, c_code, ~np.isin(c_key, m_key), 1.0), (m_row, m_code, ~np.isin(m_key, c_key), -1.0)):
            terms_of.add(in_c, row[differs], code[differs], np.full(int(differs.sum()), sign))
        in_m, in_c = in_m.astype(np.float64), in_c.astype(np.float64)
        known = rows.column(1).combine_chunks().dictionary_encode()
        places = known.indices.fill_null(len(known.dictionary)).to_numpy(zero_copy_only=False)
        for entity in [*known.dictionary.to_pylist(), None]:
            if entity not in by_entity:
                by_entity[entity] = np.array([0.0 if entity is None else 0.5 if entity in t else 0.4 if t in entity else 0.0 for t in texts])
        named = np.stack([by_entity[e] for e in [*known.dictionary.to_pylist(), None]], axis=1)
        size = np.maximum(q_size, 1.0)[:, None]  # without terms nothing is near
        out = named[:, places] + 0.3 * in_c / size + 0.4 * in_m / np.maximum(size, m_size[None, :])
        out[(in_m + in_c <= 0) | (out <= 0)] = -np.inf
        return out

    return score


def episodic_matches(queries: DataFrame, memory: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, memory_id, score, rank) of memories that share a term with the query.

    Memories are (memory_id, query, entity, context), queries (query_id, text). Score: 0.5 for an entity inside the query,
    else 0.4 for the query inside an entity; 0.3 times the share of the query's terms in the context; 0.4 times the common
    terms over the larger term set. Blocks of queries meet blocks of memories, and only each block's best leave a task:
    no row is written for a pair, however common its terms are.
    """
    q = queries.select("query_id", F.lower("text").alias("q_text"), F.array_distinct(terms("text")).alias("q_terms"))
    m = memory.select("memory_id", F.lower("entity").alias("entity"), F.array_distinct(terms("query")).alias("m_terms"), F.array_distinct(terms("context")).alias("c_terms"))
    return best_rows(q, m, by_parts(episodic_scorer()), top_k).withColumnRenamed("id", "memory_id")


def personality_score(query: Column, mode: dict[str, Column], contexts: Column) -> Column:
    """Score of a personality row against a query text: type, MBTI and style named in it, and any activation context."""
    q = F.lower(query)
    has = lambda c: F.coalesce(F.contains(q, F.lower(c)), F.lit(False))
    kind = F.when(has(mode["personality_type"]), 0.5).when(F.coalesce(F.contains(F.lower(mode["personality_type"]), q), F.lit(False)), 0.4).otherwise(0.0)
    active = F.coalesce(F.exists(contexts, lambda c: F.contains(q, F.lower(c))), F.lit(False))
    return kind + F.when(has(mode["mbti_type"]), 0.5).otherwise(0.0) + F.when(has(mode["cognitive_style"]), 0.4).otherwise(0.0) + F.when(active, 0.5).otherwise(0.0)


def merge_scores(semantic: DataFrame, symbolic: DataFrame, keys: list[str], weight: float = 0.7) -> DataFrame:
    """Weighted sum over a full outer join; if one side is empty the other is returned unweighted. Either side is computed once."""
    semantic, symbolic = materialize(semantic.select(*keys, "score"), "semantic"), materialize(symbolic.select(*keys, "score"), "symbolic")
    if symbolic.isEmpty():
        return semantic.select(*keys, "score")
    if semantic.isEmpty():
        return symbolic.select(*keys, "score")
    a, b = semantic.select(*keys, F.col("score").alias("sem")), symbolic.select(*keys, F.col("score").alias("sym"))
    return a.join(b, keys, "full_outer").select(*keys, (F.coalesce("sem", F.lit(0.0)) * weight + F.coalesce("sym", F.lit(0.0)) * (1 - weight)).alias("score"))


def context_rows(tasks: DataFrame, contexts: Column) -> DataFrame:
    """(query, entity, context, task_id): a memory for each retrieved context of a task, numbered from 0."""
    rows = tasks.select("task_id", F.posexplode(contexts).alias("item", "context"))
    name = F.concat(F.lit("context_for_task_"), F.col("task_id").cast("string"), F.lit("_item_"), F.col("item").cast("string"))
    return rows.select(F.concat(F.lit("task "), F.col("task_id").cast("string")).alias("query"), name.alias("entity"), "context", "task_id")
