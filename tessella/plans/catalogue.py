"""The registered queries: each operator applied to whole tables, and the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import graphs, groups, knowledge, memory, prompts, relational, search, selection, storage, streams, times, vectorstore

MODULES = (relational, search, knowledge, prompts, selection, memory, graphs, groups, storage, streams, times, vectorstore)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search of the benchmark passages over all documents."""
    return search.bm25(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
