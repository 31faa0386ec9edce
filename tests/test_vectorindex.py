"""Hashed embeddings and the cell index, against plain versions and the exact search."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import embedding
from tessella.operators import retrieval, vectorindex


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    return spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [])], "id long, v array<float>").repartition(4).cache()


def test_recall_and_files_read(spark, clustered, tmp_path):
    path = f"{tmp_path}/index"
    vectorindex.build_index(clustered, path)
    centroids, probes = vectorindex.read_cells(spark, path)
    assert len(centroids) == round(4004**0.5) and 1 <= probes < len(centroids) / 2
    queries = clustered.where("id % 50 = 0")
    found, exact = vectorindex.search_index(queries, path), retrieval.vector_search(queries, clustered, 10)
    assert exact.count() == 800 and vectorindex.recall(found, exact) >= 0.9
    assert vectorindex.recall(vectorindex.search_index(queries, path, probes=len(centroids)), exact) == 1.0
    q = clustered.where("id = 7").select(F.col("id"), F.col("v").alias("vector"))
    rows = vectorindex.probed_rows(spark, path, vectorindex._probed(q, centroids, probes))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    cells = {f.rsplit("cell=", 1)[1].split("/")[0] for f in rows.inputFiles()}
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(f"{path}/rows").count() == 4000  # every vector with a length is filed
    assert rows.count() < 4000 * 0.6 and len(cells) >= rows.select("cell").distinct().count()


def test_added_rows_are_found(spark, clustered, tmp_path):
    path = f"{tmp_path}/index"
    vectorindex.build_index(clustered.where("id < 3000"), path, cells=20)
    vectorindex.add_to_index(clustered.where("id >= 3000"), path)
    queries = clustered.where("id IN (3001, 3002)")
    exact = retrieval.vector_search(queries, clustered, 5)
    assert vectorindex.recall(vectorindex.search_index(queries, path, 5, probes=20), exact) == 1.0
    assert vectorindex.search_index(clustered.where("id > 8999"), path, 5).count() == 0
    with pytest.raises(ValueError):
        vectorindex.build_index(clustered.where("id > 8999 AND id <> 9002"), f"{tmp_path}/none")


def test_text_ids(spark, clustered, tmp_path):
    named = clustered.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "v")
    vectorindex.build_index(named, f"{tmp_path}/index", cells=4)
    found = vectorindex.search_index(named.where("id = 'c5'"), f"{tmp_path}/index", 3, probes=4).collect()
    assert [r.id for r in found] == [r.id for r in retrieval.vector_search(named.where("id = 'c5'"), named, 3).collect()] and found[0].id.startswith("c")


def test_embeddings_against_a_plain_version(spark):
    texts = [None, "", "!!", "Apples and apple pie, apples", "a b c", "word " * 1000, "ünï 漢字 ok", "zz" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", embedding.embedded("t", "hash-64").alias("v"))
    for i, v in df.collect():
        want = np.zeros(64)
        for w in re.findall("[a-z0-9]{2,}", (texts[i] or "").lower()):
            m = f"^{w}$"
            for f in [w] + [m[j : j + 3] for j in range(len(m) - 2)]:
                h = hashlib.md5(f.encode()).hexdigest()
                want[int(h[:8], 16) % 64] += -1 if int(h[8], 16) % 2 else 1
        n = np.linalg.norm(want)
        assert np.allclose(v, want / n if n else want, atol=1e-6)
    assert embedding.dimension("hash-1024") == 1024
    with pytest.raises(ValueError):
        embedding.dimension("none")


def test_like_texts_have_like_vectors(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    a = " ".join(rng.choices(words[:100], k=80))
    near, far = a.replace(words[3], words[3] + "s"), " ".join(rng.choices(words[100:], k=80))
    e = [embedding.embed_text(x, 256) for x in (a, near, far)]
    assert e[0] @ e[1] > 0.9 > 0.5 > e[0] @ e[2]
