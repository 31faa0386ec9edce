"""Joins on time against nested loops."""

import random
from datetime import datetime, timedelta

import pytest

from tessella.operators import timejoin


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_of_any_length(spark, seed):
    rng = random.Random(seed)

    def side(n):
        made = []
        for i in range(n):
            a = rng.uniform(-500, 500)
            made.append((rng.choice("xy"), i, a, rng.choice([a, a + rng.uniform(0, 3), a + rng.uniform(0, 900), None, a - 1])))
        return [*made, (None, n, 0.0, 1.0), ("x", n + 1, None, 5.0), ("x", n + 2, 0.0, 0.0), ("y", n + 3, -1e6, 1e6)]

    left, right = side(60), side(70)
    got = timejoin.interval_join(spark.createDataFrame(left, "k string, i int, a double, b double"), spark.createDataFrame(right, "k string, j int, c double, d double"), ["k"], ("a", "b"), ("c", "d"), 2.0)
    ends = lambda a, b: (a, float("inf") if b is None else b)
    want = sorted((i, j) for k, i, a, b in left for m, j, c, d in right if k and k == m and a is not None and c is not None
                  for lo, hi in [ends(a, b)] for lo2, hi2 in [ends(c, d)] if lo <= hi and lo2 <= hi2 and lo <= hi2 and lo2 <= hi)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_points_times_and_empty_sides(spark):
    base = datetime(2024, 3, 31)
    spans = [(i, base + timedelta(hours=i), base + timedelta(hours=i + (i % 7) * 30)) for i in range(50)]
    points = [(j, base + timedelta(minutes=13 * j)) for j in range(400)]
    left, right = spark.createDataFrame(spans, "i int, a timestamp_ntz, b timestamp_ntz"), spark.createDataFrame(points, "j int, t timestamp_ntz")
    got = timejoin.interval_join(left, right, [], ("a", "b"), ("t", "t"), 3.6e9).collect()
    assert sorted((r.i, r.j) for r in got) == sorted((i, j) for i, a, b in spans for j, x in points if a <= x <= b)
    for x, y in ((left.where("false"), right), (left, right.where("false"))):
        assert timejoin.interval_join(x, y, [], ("a", "b"), ("t", "t"), 3.6e9).count() == 0
        assert timejoin.asof_join(x, y, [], "a", "t").where("j IS NOT NULL").count() == 0


@pytest.mark.parametrize("strict,most", [(False, None), (True, None), (False, 5.0)])
def test_last_row_before_each(spark, monkeypatch, strict, most):
    """A hot key over many ranges, keys on one side only, ties, null keys and times."""
    monkeypatch.setattr(timejoin, "RANGE_ROWS", 20)
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), i, rng.choice([None, *map(float, range(60))])) for i in range(150)] + [("only left", 999, 1.0)]
    right = [(key(), j, rng.choice([None, *map(float, range(0, 60, 3))])) for j in range(90)] + [("only right", 999, 1.0)]
    got = timejoin.asof_join(spark.createDataFrame(left, "k string, i int, t double"), spark.createDataFrame(right, "k string, j int, u double"), ["k"], "t", "u", ["j"], strict, most)
    assert "NestedLoop" not in plan_of(got)
    want = {}
    for k, i, t in left:
        fits = [(u, j) for m, j, u in right if k and m == k and u is not None and t is not None and (u < t if strict else u <= t)]
        u, j = max(fits, default=(None, None))
        want[i] = (k, t, *((j, u) if j is not None and (most is None or t - u <= most) else (None, None)))
    rows = got.collect()
    assert len(rows) == len(left) and {r.i: (r.k, r.t, r.j, r.u) for r in rows} == want
