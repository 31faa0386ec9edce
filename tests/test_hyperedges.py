"""Similar hyperedges: small and large sets, frequent nodes, and how few pairs are looked at."""

import random

import pytest

from tessella.operators import hypergraph


@pytest.mark.parametrize("least,common,skewed", [(0.5, 3, False), (0.5, 3, True), (0.3, 2, True), (0.6, 1, False)])
def test_sets_of_any_size(spark, monkeypatch, least, common, skewed):
    monkeypatch.setattr(hypergraph, "PAIRED", 6)
    monkeypatch.setattr(hypergraph, "OFTEN", 1.5 if skewed else 1000)
    r = random.Random(7)
    sets = {}
    for i in range(0, 120, 2):
        base = set(r.sample(range(40), r.randrange(1, 14)))
        sets[i], sets[i + 1] = base, {*base} - set(r.sample(sorted(base), len(base) // 4)) | ({0} if skewed else set())
    rows = [(i, "tu"[i % 3 == 0], n) for i, s in sets.items() for n in s] + [(1, None, 3), (2, "t", None)]
    m = spark.createDataFrame(rows + rows[:50], "edge_id long, edge_type string, node_id long")
    got = sorted((x.edge_a, x.edge_b, x.n_common) for x in hypergraph.similar_hyperedges(m, least, common).collect())
    want = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and (a % 3 == 0) == (b % 3 == 0) and len(sets[a] & sets[b]) >= common and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > least]
    assert got == sorted(want) and want


def test_a_shared_node_alone_makes_no_candidates(spark, monkeypatch):
    """400 sets of three, a hundred to a node that all of them hold: they met on it before, each with each."""
    m = spark.createDataFrame([(i, "t", n) for i in range(400) for n in (i % 4, 1000 + 2 * i, 1001 + 2 * i)], "edge_id long, edge_type string, node_id long")
    monkeypatch.setattr(hypergraph, "OFTEN", 1e9)
    candidates = []
    distinct = type(m).distinct
    monkeypatch.setattr(type(m), "distinct", lambda self: candidates.append(distinct(self)) or candidates[-1])
    assert hypergraph.similar_hyperedges(m, 0.25, 2).count() == 0
    assert [c.count() for c in candidates if c.columns[-1] == "edge_b"] == [0]
