"""The choice of searches, fusion and limits of graph retrieval."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.embedding import embedded
from tessella.operators.graphretrieve import Retrieval, graph_retrieve
from tessella.plans import catalogue
from tests.compare import spark_rows, sql_rows


@pytest.fixture(scope="module")
def graph(spark):
    texts = ["red apple", "green apple", "red car", "blue boat", "apple boat", "stone"]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string").select("node", F.split("text", " ").alias("terms"), embedded("text", "hash-64").alias("vector")).cache()
    edges = spark.createDataFrame([(0, 1, 1.0, "REFERENCES"), (1, 4, 1.0, "SIMILAR"), (4, 3, 1.0, "SIMILAR"), (0, 2, 1.0, "SIMILAR"), (2, 5, 1.0, "SIMILAR")], "src long, dst long, weight double, edge_type string")
    queries = spark.createDataFrame([(0, "red apple")], "query_id long, text string").select("query_id", F.split("text", " ").alias("terms"), embedded("text", "hash-64").alias("vector"))
    return queries, nodes, edges


def rows(graph, how, **more):
    return [(r.method, r.item, r.score) for r in graph_retrieve(*graph, how, **more).sort("rank").collect()]


def test_each_search_and_the_limits(spark, graph):
    got = rows(graph, Retrieval(("semantic",), top_k=3))
    assert got[0] == ("semantic", "0", 1.0) and len(got) == 3  # a node with the number of the query is not left out
    assert rows(graph, Retrieval(("structural",), top_k=1))[0][1] == "0"
    paths = rows(graph, Retrieval(("path",), top_k=None))
    assert paths[0][1] == "0 > 1" and all(m == "path" for m, _, _ in paths)
    found = rows(graph, Retrieval(("community",), top_k=None), communities=spark.createDataFrame([(0, 0), (1, 0), (4, 0), (3, 3)], "node long, community long"))
    assert found == [("community", "community 0", 1.0)]
    assert len(rows(graph, Retrieval(("community",), top_k=None))) >= 2  # Louvain's
    members = spark.createDataFrame([("c", "semantic_cluster", 1), ("c", "semantic_cluster", 2)], "edge_id string, edge_type string, node_id long")
    assert {i for _, i, _ in rows(graph, Retrieval(("hypergraph",)), members=members)} <= {"1", "2"}
    assert rows(graph, Retrieval(("hypergraph",))) == []
    assert all(s >= 0.5 for _, _, s in rows(graph, Retrieval(("semantic", "structural"), top_p=0.5, top_k=None)))


def test_fusion_names_all_searches(graph):
    got = rows(graph, Retrieval(("semantic", "structural"), "rrf"))
    assert got[0] == ("semantic,structural", "0", round(2 / 61, 6)) and len({i for _, i, _ in got}) == len(got)


def test_unknown_choices():
    with pytest.raises(ValueError):
        Retrieval(("guess",))
    with pytest.raises(ValueError):
        Retrieval(rerank="guess")


def test_hypergraph_search_takes_documents_without_vectors(spark, tmp_path):
    """All documents ask and are found: by words alone, with the weight of their source, where they have no vector; not where they are in no hyperedge."""
    docs = [(0, "red apple pie", "a"), (1, "red apple", "a"), (2, "red apple", "b"), (3, "red apple", None), (50, "red car park", "b"), (51, "stone", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(0, [1.0, 0.0], 7), (1, [0.6, 0.8], 7), (51, [0.0, 1.0], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = spark_rows(catalogue.queries()["hypergraph_search"](spark, str(tmp_path)))
    assert got == sql_rows(catalogue.oracle_sql()["hypergraph_search"], str(tmp_path))
    found = {(q, i): s for i, q, _, s in got[1]}
    assert found == {(0, 1): 0.744, (0, 2): 0.22, (0, 50): 0.11, (50, 0): 0.12, (50, 1): 0.12, (50, 2): 0.11}
