"""Counts and least values of points in ranges against nested loops."""

import random

import pytest

from tessella.operators import timejoin


@pytest.mark.parametrize("seed", [1, 2])
def test_summary_of_ranges_of_any_length(spark, monkeypatch, seed):
    monkeypatch.setattr(timejoin, "RANGE_ROWS", 40)  # a range of the order holds few rows, and keys lie across ranges
    rng = random.Random(seed)
    spans = []
    for i in range(150):
        a = float(rng.randrange(-100, 100))
        spans.append((rng.choice("xy"), i, a, rng.choice([a, a + 3, a + rng.uniform(0, 250), None, a - 1])))
    spans += [(None, 900, 0.0, 1.0), ("x", 901, None, 5.0), ("only here", 902, -1e6, 1e6), ("y", 903, -1e6, 1e6)]
    points = [(rng.choice("xxxy"), rng.randrange(10_000), float(rng.randrange(-100, 100))) for _ in range(400)] + [("x", 7, 5.0)] * 60 + [(None, 1, 0.0), ("x", 1, None), ("y", None, 0.0)]
    a, b = spark.createDataFrame(spans, "k string, i int, a double, b double"), spark.createDataFrame(points, "k string, j int, t double")
    got = {r.i: (r.n, r.least) for r in timejoin.interval_summary(a, b, ["k"], ("a", "b"), "t", "j").collect()}
    want = {}
    for k, i, lo, hi in spans:
        held = [j for m, j, t in points if k and m == k and lo is not None and t is not None and lo <= t <= (float("inf") if hi is None else hi)]
        if held:
            want[i] = (len(held), min((j for j in held if j is not None), default=None))
    assert got == want


def test_summary_of_nothing(spark):
    a, b = spark.createDataFrame([(1, 0, 9)], "i int, a long, b long"), spark.createDataFrame([(3, 5)], "j int, t long")
    assert [(r.n, r.least) for r in timejoin.interval_summary(a, b, [], ("a", "b"), "t", "j").collect()] == [(1, 3)]
    for x, y in ((a.where("false"), b), (a, b.where("false"))):
        assert timejoin.interval_summary(x, y, [], ("a", "b"), "t", "j").count() == 0


def test_no_pair_is_made_in_the_query(spark, monkeypatch, data):
    from tessella.plans import times

    monkeypatch.setattr(timejoin, "interval_join", lambda *a: pytest.fail("all pairs of spans and points are made"))
    assert times.intervals(spark, data).count() > 0
