"""Block searches, places in an order and batches, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import batching, blocks, ordering, retrieval


def vectors(rng, n, width=8):
    return [[rng.gauss(0, 1) for _ in range(width)] for _ in range(n)]


def test_queries_of_many_partitions_give_one_block(spark):
    queries = spark.range(40).repartition(200).withColumn("v", F.array(F.lit(1.0)))
    assert blocks.query_blocks(queries).count() == 1
    small = blocks.query_blocks(queries, 16).collect()
    assert sorted(r.block for r in small) == [0, 1, 2] and all(r.bytes == len(r.asked) for r in small)


def test_no_block_goes_through_one_task(spark, monkeypatch):
    """Only counts a partition are windowed as a whole; the bytes of blocks and rows are in no single-partition exchange."""
    plans = []
    real = blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda df, name="table": plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    e = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(random.Random(2), 60))], "id long, v array<float>")
    retrieval.vector_search(e.where("id < 9"), e, 3).collect()
    assert plans
    for plan in plans:
        for at, line in enumerate(lines := plan.splitlines()):
            if "SinglePartition" in line:
                assert not any("asked" in x or "v#" in x for x in lines[at : at + 1])


@pytest.mark.parametrize("text_ids", [False, True])
def test_search_in_groups_of_blocks(spark, monkeypatch, text_ids):
    """Ties, odd vectors, ids of either kind, more queries than a block and more blocks than a group."""
    rng = random.Random(4)
    made = [(i, v) for i, v in enumerate(vectors(rng, 90))]
    made += [(90 + i, made[i % 5][1]) for i in range(20)] + [(200, None), (201, [0.0] * 8), (202, []), (None, [1.0] * 8)]
    name = (lambda i: None if i is None else f"d-{i}") if text_ids else (lambda i: i)
    e = spark.createDataFrame([(name(i), v) for i, v in made], f"id {'string' if text_ids else 'long'}, v array<float>").repartition(7)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    monkeypatch.setattr(blocks, "ROWS", 11)
    monkeypatch.setattr(blocks, "GROUP_BYTES", 2000)
    asked = {name(i) for i in (*range(8), 90, 200)}
    got = {}
    for x in retrieval.vector_search(e.where(F.col("id").isin(list(asked))), e, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.id, x.score))
    unit = {name(i): np.array(v) / np.linalg.norm(v) for i, v in made if i is not None and v and any(v)}
    for q in asked & unit.keys():
        scores = [(i, round(float(unit[q] @ u), 6) + 0.0) for i, u in unit.items() if i != q]
        want = sorted(scores, key=lambda s: (-s[1], s[0]))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want])
    assert set(got) == asked & unit.keys()


def test_groups_of_blocks_are_bounded():
    assert blocks.block_groups([(2, 30), (0, 50), (1, 40), (3, 200), (4, 1)], 100) == [(0, 1), (2, 2), (3, 3), (4, 4)]
    assert blocks.block_groups([]) == []


def test_ordinals_and_numbers(spark):
    rng = random.Random(6)
    made = [(rng.choice("aaab"), rng.choice([None, *range(9)])) for _ in range(300)]
    df = spark.createDataFrame(made, "k string, o long").repartition(5)
    got = ordering.ordinals(df, "k", ["o"]).collect()
    for k in "ab":
        own = sorted((r.idx, -1 if r.o is None else r.o) for r in got if r.k == k)
        want = sorted(-1 if o is None else o for x, o in made if x == k)
        assert own == list(enumerate(want)) and {r.n for r in got if r.k == k} == {len(want)}
    assert sorted(r.number for r in ordering.numbered(df).collect()) == list(range(300))
    assert ordering.ordinals(df.where("false"), "k", ["o"]).count() == ordering.numbered(df.where("false")).count() == 0


def plain_batches(tokens, budget, buffer):
    mean = sum(tokens) / len(tokens)
    size = max(1, int(budget * buffer / max(mean, 1))) if len(tokens) > 1 else 1
    out, batch, held, used = [], -1, 0, 0
    for t in tokens:
        if t > budget:
            out.append(None)
            continue
        if batch < 0 or used + t > budget or held >= size:
            batch, held, used = batch + 1, 0, 0
        held, used = held + 1, used + t
        out.append(batch)
    return out, size


@pytest.mark.parametrize("step", [1, 1000, -7919])
def test_batches_are_those_of_a_plain_loop_whatever_the_ids(spark, monkeypatch, step):
    monkeypatch.setattr(batching, "FAN", 3)
    rng = random.Random(8)
    kinds = {"hot": lambda: rng.randint(0, 12), "zeros": lambda: 0, "big": lambda: rng.choice([25, 20, 19, 1]), "even": lambda: 5}
    sizes = {"hot": 700, "zeros": 130, "big": 90, "even": 1}
    texts = {k: [kinds[k]() for _ in range(n)] for k, n in sizes.items()} | {"only too big": [99]}
    rows = [(k, step * i if step > 0 else step * (10_000 - i), n) for k, v in texts.items() for i, n in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, 5)], "k string, o long, tokens long")
    each, report = batching.budget_batches(df, "k", "o", "tokens", 20, 0.9, block=25)
    report = {r.k: r for r in report.collect()}
    got = {}
    for r in each.collect():
        got.setdefault(r.k, {})[r.o] = r.batch
    assert set(report) == set(texts)
    for k, tokens in texts.items():
        order = sorted(range(len(tokens)), key=lambda i: step * i if step > 0 else step * (10_000 - i))
        want, size = plain_batches([tokens[i] for i in order], 20, 0.9)
        ids = [step * i if step > 0 else step * (10_000 - i) for i in order]
        assert {o: b for o, b in zip(ids, want, strict=True) if b is not None} == got.get(k, {})
        assert (report[k].n, report[k].skipped, report[k].batch_size, report[k].batches) == (len(tokens), want.count(None), size, max((b for b in want if b is not None), default=-1) + 1)
    with pytest.raises(ValueError):
        batching.budget_batches(df, "k", "o", "tokens", 20, 0.9, block=18)
