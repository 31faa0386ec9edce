"""The best items of a query by classes, paths within groups: held against the plain searches, and without their pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, graphsearch
from tessella.operators.relational import top_per_key


def graph_of(spark, seed):
    rng = random.Random(seed)
    words = "abcdefg"
    nodes = [(n, rng.sample(words, rng.randrange(4)) + ["z"] * 2) for n in range(60)] + [(None, ["a"])]
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    asked = [(q, w) for q in range(25) for w in rng.sample(words, rng.randrange(1, 4))] + [(3, "a"), (3, "a"), (None, "b"), (4, None), (90, "nowhere")]
    frames = spark.createDataFrame(nodes, "node long, terms array<string>"), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(asked, "query_id long, keyword string")
    return nodes, edges, asked, *frames


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_are_those_of_the_whole_search(spark, seed):
    _, _, _, nodes, edges, asked = graph_of(spark, seed)
    between = spark.createDataFrame([(n, float(n % 7)) for n in range(0, 60, 2)], "node long, betweenness double")
    for b in (None, between):
        whole = graph.structural_search(edges, nodes, asked, between=b).withColumn("score", F.round("score", 6))
        want = top_per_key(whole, ["query_id"], [F.desc("score"), F.col("node")], 4)
        assert plain(graph.structural_best(edges, nodes, asked, 4, between=b)) == plain(want.select("query_id", "node", "score", "rank")) != []
    groups = nodes.select("node", F.when(F.col("node") < 50, F.col("node") % 11).alias("community"))
    whole = graph.community_search(groups, nodes, asked).withColumn("score", F.round("score", 6))
    want = top_per_key(whole, ["query_id"], [F.desc("score"), F.col("community")], 3)
    assert plain(graph.community_best(groups, nodes, asked, 3)) == plain(want.select("query_id", "community", "size", "score", "rank")) != []


def test_questions_and_classes_meet_instead_of_queries_and_items(spark, monkeypatch):
    """400 queries of two questions over 3,000 nodes of two classes: no table that is written has a row for each pair."""
    rows, write = [], graph.materialize

    def counted(df, name="table"):
        rows.append((out := write(df, name)).count())
        return out

    for module in (graph, graphsearch):
        monkeypatch.setattr(module, "materialize", counted)
    nodes = spark.range(3000).select(F.col("id").alias("node"), F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("terms"))
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("keyword"))
    edges = spark.createDataFrame([(0, 2, 1.0, "REFERENCES"), (1, 3, 1.0, "x"), (4, 5, 1.0, "x")], "src long, dst long, weight double, edge_type string")
    best = graph.structural_best(edges, nodes, asked, 2)
    assert best.count() == 800 and {(r.query_id % 2, r.node) for r in best.collect()} == {(0, 0), (0, 2), (1, 1), (1, 3)}
    found = graphsearch.path_search(edges, nodes, asked)
    assert found.count() == 400 and max(rows) <= 3000


def test_paths_within_groups_are_those_between_their_pairs(spark):
    _, edges, _, _, _, _ = graph_of(spark, 3)
    e = spark.createDataFrame([(a, b, 1.0 + a, "REFERENCES" if a % 2 else "x") for a, b in edges], "src long, dst long, weight double, edge_type string")
    starts = [(n, g) for n in range(0, 60, 3) for g in {n % 4, n % 5}]
    ends = [(n, n % 4) for n in range(60)] + [(None, 1), (7, None)]
    pairs = sorted({(a, b) for a, g in starts for b, h in ends if g == h and b is not None})
    within = graphsearch.paths_within(e, spark.createDataFrame(starts, "start long, group long"), spark.createDataFrame(ends, "end long, group long"), 3)
    want = graphsearch.paths_between(e, spark.createDataFrame(pairs, "start long, end long"), 3)
    assert plain(within) == plain(want) != []
