"""Distances among many sources at once, and connectivity, against plain searches."""

import random
from collections import Counter, deque
from itertools import combinations

import pytest

from tessella.operators import connectivity as C
from tessella.operators import graph


def plain_distances(edges, source):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    found, queue = {source: 0}, deque([source])
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in found:
                found[y] = found[x] + 1
                queue.append(y)
    return found


def test_more_sources_than_bits(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(150)] + [(200 + i, 201 + i) for i in range(12)] + [(5, 5)]
    sources = sorted({n for e in edges for n in e})[:100] + [999]
    got = C.distances_from(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(s,) for s in sources], "node long")).collect()
    want = {(s, n): d for s in sources for n, d in plain_distances(edges, s).items()}
    assert {(r.source, r.node): r.distance for r in got} == want and len(got) == len(want)


def test_connectivity(spark):
    rng = random.Random(4)
    edges = {tuple(sorted((rng.randrange(30), rng.randrange(30)))) for _ in range(45)} - {(i, i) for i in range(30)} | {(100, 101)}
    nodes = [*range(0, 20), 100, 555]
    row = C.connectivity(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")).first()
    held = [n for n in nodes if any(n in e for e in edges)]
    d = [plain_distances(edges, a).get(b) for a, b in combinations(held, 2)]
    finite = [x for x in d if x is not None]
    own = {n: {b if a == n else a for a, b in edges if n in (a, b)} & set(held) for n in held}
    clustering = [sum(y in own[x] for x, y in combinations(own[n], 2)) / (len(own[n]) * (len(own[n]) - 1) / 2) if len(own[n]) > 1 else 0.0 for n in held]
    mean = sum(finite) / len(finite)
    assert tuple(row) == pytest.approx((len(held), len(finite), mean, 1 / mean, sum(clustering) / len(held), sum(map(len, own.values())) / len(held) / (len(held) - 1)))
    empty = C.connectivity(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1,)], "node long")).first()
    assert tuple(empty) == (0, 0, None, 0.0, 0.0, 0.0)


def test_labels_settle(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(60)] + [(200, 201 + i) for i in range(9)] + [(300 + i, 400 + j) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    label = {r.node: r.label for r in graph.settled_labels(df).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(label) == set(near)
    for n, others in near.items():
        votes = Counter(label[x] for x in others)
        assert votes[label[n]] == max(votes.values())
    assert len({label[i] for i in range(41)}) <= 20
    with pytest.raises(RuntimeError):
        graph.settled_labels(df, 1)
    assert graph.settled_labels(df.where("false")).count() == 0


def test_ranks_settle(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(60)} - {(i, i) for i in range(20)})
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.rank for r in graph.pagerank(df, rounds=100, tolerance=1e-6).collect()}
    nodes = sorted({n for e in edges for n in e})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(200):
        lost = sum(rank[n] for n in nodes if not any(a == n for a, _ in edges))
        rank = {n: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n)) for n in nodes}
    assert got == pytest.approx(rank, abs=1e-4) and sum(got.values()) == pytest.approx(1.0)
    with pytest.raises(RuntimeError):
        graph.pagerank(df, rounds=2, tolerance=1e-9)
