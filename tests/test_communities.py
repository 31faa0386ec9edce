"""Communities, chains and topics against plain versions."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from tessella.operators import communities as C


def merges_that_gain(edges, named, resolution):
    """Pairs of groups whose merge would raise the modularity."""
    undirected = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    degree, between = defaultdict(int), defaultdict(int)
    for a, b in undirected:
        degree[named[a]] += 1
        degree[named[b]] += 1
        if named[a] != named[b]:
            between[tuple(sorted((named[a], named[b])))] += 1
    m = len(undirected)
    return [p for p, w in between.items() if w / m - resolution * degree[p[0]] * degree[p[1]] / (2 * m * m) > 1e-12]


def test_a_ring_of_cliques_gives_the_cliques(spark):
    edges = [(5 * k + i, 5 * k + j) for k in range(6) for i, j in combinations(range(5), 2)] + [(5 * k, (5 * k + 6) % 30) for k in range(6)]
    got = {r.node: r.community for r in C.greedy_communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: n // 5 * 5 for n in range(30)}


@pytest.mark.parametrize("resolution", [1.0, 2.0])
def test_no_merge_is_left_that_gains(spark, resolution):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(110)] + [(99, 200 + i) for i in range(30)] + [(300 + i, 301 + i) for i in range(20)] + [(7, 7)]
    got = {x.node: x.community for x in C.greedy_communities(spark.createDataFrame(edges, "src long, dst long"), resolution).collect()}
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert all(got[c] == c and c <= n for n, c in got.items())
    assert len(set(got.values())) < len(got) / 2
    assert merges_that_gain(edges, got, resolution) == []


def test_no_edges_give_no_communities(spark):
    assert C.greedy_communities(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chains_are_what_walks_in_order_gather(spark):
    r = random.Random(2)
    rows = [(i, f"r{i if i != 9 else 8}", ",".join(f" r{r.randrange(44)} " for _ in range(r.choice([0, 0, 1, 1, 2]))) or None) for i in range(40)]
    rows.append((40, None, "r1"))
    first, leads = {}, {}
    for o, ref, more in rows:
        if ref is not None and ref not in first:
            first[ref], leads[ref] = o, [x.strip() for x in (more or "").split(",")]
    seen, want = set(), {}
    for root in sorted(first, key=first.get):
        stack, chain = [root], []
        while stack:
            at = stack.pop()
            if at in first and at not in seen:
                seen.add(at)
                chain.append(at)
                stack += leads[at]
        want |= {x: (first[root], len(chain)) for x in chain if len(chain) > 1}
    got = C.reference_chains(spark.createDataFrame(rows, "ord long, reference string, reference_additional string")).collect()
    assert {x.reference: (x.chain, x.size) for x in got} == want
    assert len(got) == len(want) > 5


def test_topics(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 2.0]), (3, "a", [3.0, 3.0]), (4, "b", [1.0, 1.0]), (5, "b", [0.0, 0.0]), (6, "b", None)]
    got = {r.id: r for r in C.topic_vectors(spark.createDataFrame(rows, "id long, topic string, vector array<float>")).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].coherence == pytest.approx(2 * math.sqrt(0.5) / 3) and got[4].coherence is None
    assert [round(got[i].membership, 6) for i in (1, 2, 3, 4)] == [round(math.sqrt(0.5), 6), round(math.sqrt(0.5), 6), 1.0, 1.0]
    texts = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["y"]), ("b", ["y", "z"]), ("b", None)], "topic string, terms array<string>")
    assert [(r.topic, r.term, r.rank) for r in C.topic_keywords(texts, 1).orderBy("topic").collect()] == [("a", "x", 1), ("b", "z", 1)]
