"""Products of term vectors against plain sums, and the searches built on them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import memory, retrieval, termproducts


@pytest.mark.parametrize("dense", [0, 3, 512])
def test_products_match_plain_sums(monkeypatch, dense):
    monkeypatch.setattr(termproducts, "DENSE", dense)
    rng = random.Random(dense)
    made = lambda n: [None if rng.random() < 0.1 else {w: rng.randrange(1, 5) for w in rng.sample("abcdefghij", rng.randrange(6))} for _ in range(n)]
    column = lambda rows, of: pa.chunked_array([pa.array([None if r is None else list(of(r)) for r in rows])])
    asked, rows = made(20), made(50)
    matrix = termproducts.TermMatrix(column(asked, dict.keys), column(asked, dict.values))
    kept, row, code = matrix.coded(column(rows, dict.keys))
    got = matrix.products(50, row, code, column(rows, dict.values).combine_chunks().flatten().to_numpy()[kept].astype(float))
    want = [[sum(v * (r or {}).get(w, 0) for w, v in (q or {}).items()) for r in rows] for q in asked]
    assert np.array_equal(got, want)


def test_tfidf_by_blocks_is_tfidf_by_joins(spark, monkeypatch):
    monkeypatch.setattr(termproducts, "DENSE", 4)
    rng = random.Random(8)
    docs = [(i, None if i == 5 else " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.randrange(12)))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = frame.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"), "text")
    found = sorted(map(tuple, retrieval.tfidf_search_all(asked, frame).collect()))
    assert found == sorted((r.query_id, r.id, r.score, r.rank) for r in retrieval.tfidf_search(asked, frame).collect()) != []
    split = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb")], "doc_id long, text string")  # two rows are one document
    one = retrieval.tfidf_search_all(spark.createDataFrame([(9, "aa")], "id long, text string"), split).collect()
    assert [(r.id, r.rank) for r in one] == [(1, 1)]
    plan = retrieval.tfidf_search_all(asked, frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # what meets is not joined by terms


def test_episodes_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(termproducts, "DENSE", 3)
    rng = random.Random(9)
    words = ["user", "bot", *(f"w{k}" for k in range(12))]
    made = [(f"m{i}", " ".join(rng.choices(words, k=rng.randrange(7))), rng.choice(["User", "bot", None, "w1 w2"])) for i in range(60)]
    rows = [(i, text, entity, " ".join(filter(None, [entity, text]))) for i, text, entity in made] + [("odd", "w1 w3", "bot", "w9"), ("none", None, None, "w2")]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(20)]
    found = memory.episodic_matches(spark.createDataFrame(asked, "query_id string, text string"), spark.createDataFrame(rows, "memory_id string, query string, entity string, context string"), 4)
    want = []
    for q, text in asked:
        terms, scored = set(text.split()), []
        for i, m, e, c in rows:
            m, c, e = set((m or "").lower().split()), set((c or "").lower().split()), None if e is None else e.lower()
            if terms & (m | c):
                score = (0 if e is None else 0.5 if e in text else 0.4 if text in e else 0) + 0.3 * len(terms & c) / len(terms) + 0.4 * len(terms & m) / max(len(terms), len(m))
                scored.append((-round(score, 6), i))
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scored)[:4])]
    assert sorted((r.query_id, r.memory_id, r.score, r.rank) for r in found.collect()) == sorted(want)
