"""The inverted index against the search over all terms."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import postings, retrieval


def texts(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(rng.choices(words, weights=[200, *(60 / (i + 1) for i in range(1, 60))], k=rng.randint(0, 60))) for _ in range(n)]
    return [*made, "rare needle here", *["needle"] * 8, "", None, "w0 " * 500]


@pytest.mark.parametrize("text_ids", [False, True])
def test_same_rows_as_the_plain_search(spark, tmp_path, text_ids):
    name = (lambda i: f"d-{i}:x") if text_ids else (lambda i: i)
    kind = "string" if text_ids else "long"
    docs = spark.createDataFrame([(name(i), x) for i, x in enumerate(texts())], f"doc_id {kind}, text string").repartition(5)
    queries = spark.createDataFrame([(1, "needle w3"), (2, "w0 w0 w1"), (3, "w5 w17 W40 w41"), (4, "nothing"), (5, ""), (6, None)], "id long, text string")
    index = postings.add_documents(spark, f"{tmp_path}/i", docs, part=16)
    want = sorted(map(tuple, retrieval.bm25_search(queries, docs).collect()))
    for skip in (True, False):
        found, parts = postings.bm25_over_index(queries, index, skip=skip)
        assert sorted(map(tuple, found.collect())) == want
        unread = {r.query_id: r["count"] for r in parts.where("NOT read").groupBy("query_id").count().collect()}
        assert (unread.get(1, 0) > 10) == skip
    plan = index.blocks.where("bucket IN (1, 2) AND term = 'w3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("(", "") or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_documents_added_later(spark, tmp_path):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts(seed=9))], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "needle w3 w9"), (2, "w0 w1 w2")], "id long, text string")
    for low, high in ((0, 100), (100, 250), (250, 1000)):
        index = postings.add_documents(spark, f"{tmp_path}/i", docs.where(f"doc_id >= {low} AND doc_id < {high}"), part=32)
        want = retrieval.bm25_search(queries, docs.where(f"doc_id < {high}"))
        assert sorted(map(tuple, postings.bm25_over_index(queries, index)[0].collect())) == sorted(map(tuple, want.collect()))
    assert index.documents.count() == docs.count()
    assert index.blocks.agg(F.max("n")).first()[0] <= 32 and index.blocks.groupBy("term", "part").count().where("count > 1").count() == 0


def test_text_ids_in_term_searches(spark):
    docs = spark.createDataFrame([("d-1", "apple pie"), ("d-2", "apple"), ("d-3", "pear")], "doc_id string, text string")
    queries = spark.createDataFrame([("q", "apple pie")], "id string, text string")
    assert [r.id for r in retrieval.bm25_search(queries, docs).sort("rank").collect()][0] == "d-1"
    assert [r.id for r in retrieval.tfidf_search(queries, docs).sort("rank").collect()] == ["d-1", "d-2"]
