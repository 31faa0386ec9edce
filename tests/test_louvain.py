"""Louvain's communities against exhaustive search, greedy merges and every single move."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from tessella.operators import communities, louvain


def modularity(edges, named, resolution=1.0):
    degree, inner, m = defaultdict(float), 0.0, 0.0
    for (a, b), w in edges.items():
        m += w
        degree[named[a]] += w
        degree[named[b]] += w
        inner += w * (named[a] == named[b])
    return inner / m - resolution * sum((d / (2 * m)) ** 2 for d in degree.values())


def plain_edges(pairs):
    return {tuple(sorted(p)): 1.0 for p in pairs if p[0] != p[1]}


def partitions(nodes):
    """All partitions, as {node: group}."""
    def grow(i, groups):
        if i == len(nodes):
            yield dict(zip(nodes, groups, strict=True))
            return
        for g in range(max(groups, default=-1) + 2):
            yield from grow(i + 1, [*groups, g])
    yield from grow(0, [])


def found(spark, pairs, resolution=1.0, tries=1, start=None):
    df = spark.createDataFrame([(a, b) for a, b in pairs], "src long, dst long")
    return {r.node: r.community for r in louvain.louvain_communities(df, resolution, tries, start, refine=True).collect()}


def no_single_move_gains(edges, named, resolution):
    base = modularity(edges, named, resolution)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(named[b])
        near[b].add(named[a])
    return all(modularity(edges, named | {n: c}, resolution) <= base + 1e-9 for n in named for c in near[n])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_eight_nodes_against_all_partitions(spark, seed):
    rng = random.Random(seed)
    pairs = {1: [*combinations(range(4), 2), *combinations(range(4, 8), 2), (0, 4)], 2: [(i, (i + 1) % 8) for i in range(8)] + [(0, 2), (4, 6)], 3: rng.sample(list(combinations(range(8), 2)), 13)}[seed]
    edges = plain_edges(pairs)
    best = max(modularity(edges, p) for p in partitions(sorted({n for e in edges for n in e})))
    assert modularity(edges, found(spark, pairs, tries=2)) == pytest.approx(best)


def test_never_under_greedy_merges_and_no_move_is_left(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(110)] + [(99, 200 + i) for i in range(30)] + [(300 + i, 301 + i) for i in range(12)] + [(7, 7)]
    edges = plain_edges(pairs)
    for resolution in (1.5,):
        df = spark.createDataFrame(pairs, "src long, dst long")
        merged = communities.greedy_communities(df, resolution)
        greedy = {r.node: r.community for r in merged.collect()}
        got = found(spark, pairs, resolution, start=merged)
        assert set(got) == set(greedy) and all(got[c] == c and c <= n for n, c in got.items())
        assert modularity(edges, got, resolution) >= modularity(edges, greedy, resolution) - 1e-9
        assert no_single_move_gains(edges, got, resolution)


def test_ring_of_cliques_and_weights(spark):
    pairs = [(5 * k + i, 5 * k + j) for k in range(6) for i, j in combinations(range(5), 2)] + [(5 * k, (5 * k + 6) % 30) for k in range(6)]
    assert found(spark, pairs) == {n: n // 5 * 5 for n in range(30)}
    weighted = [(0, 1, 9.0), (1, 2, 1.0), (2, 3, 9.0), (3, 2, 1.0), (3, 3, 50.0), (0, 3, 0.0)]
    df = spark.createDataFrame(weighted, "src long, dst long, weight double")
    assert {r.node: r.community for r in louvain.louvain_communities(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_no_edges_and_text_nodes(spark):
    assert found(spark, []) == {} and found(spark, [(3, 3)]) == {}
    df = spark.createDataFrame([("b", "a"), ("c", "d")], "src string, dst string")
    assert {r.node: r.community for r in louvain.louvain_communities(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_each_round_raises_the_modularity(spark, monkeypatch):
    """Whatever moves together: every table of members is better than the one before on the same graph."""
    rng = random.Random(9)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)] + [(0, i) for i in range(40)]
    edges, seen = plain_edges(pairs), []
    real = louvain.materialize

    def keep(df, name="table"):
        out = real(df, name)
        if name == "members" and out.count() == len({n for e in edges for n in e}):
            seen.append({r.node: r.c for r in out.collect()})
        return out

    monkeypatch.setattr(louvain, "materialize", keep)
    got = found(spark, pairs)
    values = [modularity(edges, named) for named in seen] + [modularity(edges, got)]
    assert len(values) > 3 and all(b >= a - 1e-12 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0] + 0.1
