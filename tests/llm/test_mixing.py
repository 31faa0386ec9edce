import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from tessella.llm import mixing as M


def plain_targets(sizes):
    """Targets by sharing out again and again; sizes by source, in order."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def checked(rows, texts):
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, (t, _) in texts.items()}
    total = defaultdict(int)
    for i, (_, s) in texts.items():
        total[s] += size[i]
    want, taken = plain_targets(total), defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        assert r.source_size == total[texts[r.doc_id][1]] and r.target == pytest.approx(want[texts[r.doc_id][1]], rel=1e-9)
        taken[texts[r.doc_id][1]] += r.taken
    return {s: (taken[s], want[s]) for s in total}


def test_query_meets_its_targets_and_reruns_agree(spark, data, documents):
    texts = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    got = M.op7_mix(spark, data).collect()
    for taken, target in checked(got, texts).values():
        assert abs(taken - target) <= max(60, 0.02 * target)
    assert sorted(got) == sorted(M.op7_mix(spark, data).collect())


def test_rates_solve_the_dual(spark):
    rows = [(i, "w " * (1 + i % 37), "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(df, ["doc_id"]).collect()
    for s in ("a", "b"):
        own = [r for r in got if rows[r.row.doc_id][2] == s]
        assert sum(r.size * r.rate for r in own) == pytest.approx(own[0].target, rel=1e-5)
        assert [r.rate for r in own] == pytest.approx(plain_rates([r.size for r in own], own[0].target), rel=1e-4)


def plain_rates(sizes, target):
    """Exponential tilts up to 2, by halving an interval of lambdas."""
    size = np.array(sizes, dtype=float)
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        r = np.minimum(2.0, np.exp(np.clip(mid * size / size.mean(), -700, 700)))
        lo, hi = (mid, hi) if (size * r).sum() < target else (lo, mid)
    return r.tolist()


def test_tilts_are_exponential_below_the_limit(spark):
    """A source that gives less than it has: the logarithms of its rates are proportional to the sizes."""
    rows = [(i, "w " * (1 + i % 40), "a" if i < 200 else "b" if i < 450 else "c") for i in range(700)]
    got = [r for r in M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect() if rows[r.row.doc_id][2] == "b"]
    slopes = {round(math.log(r.rate) / r.size, 9) for r in got}
    assert got[0].target < got[0].source_size and len(slopes) == 1 and slopes.pop() < 0


def test_many_sources_and_ranks_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "RANKED", 50)
    rows = [(i, "w " * (1 + i * 7 % 23), f"site{i % 97:03d}" if i % 97 else None) for i in range(1200)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), ["doc_id"]).collect()
    texts = {i: (t, s) for i, t, s in rows}
    view = [Row(doc_id=r.row.doc_id, size=r.size, source_size=r.source_size, target=r.target, taken=r.copies * r.size) for r in got]
    for taken, target in checked(view, texts).values():
        assert abs(taken - target) <= max(23, 0.06 * target)


def test_odd_rows(spark, odd, empty):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and all(r.row.doc_id != 1 or r.size == 0 for r in got)
    assert M.mix(empty).count() == 0
    assert M.mixed_rows(odd).columns == odd.columns
    no_words = odd.where("doc_id <= 3")
    assert all(r.target == 0 for r in M.mix(no_words).collect())


def test_no_python_in_the_plan(spark, data):
    plan = M.op7_mix(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
