"""Operators on small literals: edge cases and results worked out by hand or by a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.functions import vectors
from tessella.operators import blocks, chunking, evaluation, graph, hypergraph, memory, plangraph, relational, retrieval, sections
from tessella.operators.components import connected_components
from tessella.sources import files


def test_components_match_a_plain_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_length_chunks_cover_the_text(spark):
    rows = [(1, "abcdefghij" * 25), (2, ""), (3, "x" * 100), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.length_chunks(docs, 100, 20).orderBy("doc_id", "chunk_no").collect()
    assert [(r.doc_id, r.chunk_no, len(r.corpus)) for r in got] == [(1, 0, 100), (1, 1, 100), (1, 2, 90), (3, 0, 100)]
    with pytest.raises(ValueError):
        chunking.length_chunks(docs, 10, 10)


def test_heading_sections_keep_the_path(spark):
    text = ["front", "# A", "a1", "## B", "b1", "b2", "### C $x$ d", "## D", "# E", "### F", "f"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, pos int, line string")
    got = chunking.heading_sections(lines).orderBy("section").collect()
    assert [(r.hierarchy, r.corpus) for r in got] == [("A", "a1"), ("A > B", "b1\nb2"), ("A > B > C  d", ""), ("A > D", ""), ("E", ""), ("E > F", "f")]


def test_section_parts_and_labels(spark):
    df = spark.createDataFrame([("1. one\n2. two\nmore",), ("Table 3 x\n1. y",), ("plain",)], "c string").select(F.posexplode(chunking.split_section("c")).alias("i", "p"))
    got = [r[0] for r in df.select(chunking.part_label(F.col("p"), F.col("i").cast("string"))).collect()]
    assert got == ["Para 1", "Para 2", "Table 3", "auto0"]


def test_text_functions(spark):
    df = spark.createDataFrame([(" \n a b \t", "```json\n{}\n```", "x/y/my.doc.md", "hi {a} {b} {a}")], "s string, f string, p string, t string")
    r = df.select(fx.strip("s"), fx.without_fence("f"), fx.document_stem("p"), fx.missing_keys("t", F.array(F.lit("b"))), fx.ngrams(F.split(F.lit("a b c"), " "), 2)).first()
    assert list(r) == ["a b", "{}", "MY.DOC", ["a"], ["a b", "b c"]]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [None, None]


def test_vector_search_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, None), (201, [0.0] * 8), (202, [])]
    e = spark.createDataFrame(rows, "id long, v array<float>")
    monkeypatch.setattr(blocks, "QUERIES", 3)
    monkeypatch.setattr(blocks, "ROWS", 11)
    got = defaultdict(list)
    for x in retrieval.vector_search(e.where("id < 8"), e, 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.id)
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v and any(v)}
    for q in range(8):
        best = sorted((i for i in unit if i != q), key=lambda i: (-round(sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), 6), i))[:5]
        assert got[q] == best
    assert retrieval.vector_search(e.where("id = 200"), e, 5).count() == 0


def test_operation_lists(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    got = relational.apply_operations(df, [{"type": "filter", "params": {"k": ["a"]}}, {"type": "group", "params": {"by": ["k"], "agg": {"v": "sum"}}}]).collect()
    assert [tuple(r) for r in got] == [("a", 4)]
    with pytest.raises(ValueError):
        relational.apply_operations(df, [{"type": "pivot", "params": {}}])


def test_limits_tell_zero_from_none(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -1.0)], "id long, score double")
    assert relational.limit_results(df, top_p=0.0).count() == 1
    assert relational.limit_results(df, top_k=0).count() == 0
    assert relational.limit_results(df).count() == 2


def test_lcs_and_bleu(spark):
    df = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), (["x"], []), (None, ["y"])], "g array<string>, r array<string>")
    assert [(r[0].lcs, round(r[0].p, 6), round(r[0].r, 6)) for r in df.select(evaluation.rouge_l(F.col("g"), F.col("r"))).collect()] == [(4, round(4 / 7, 6), round(4 / 6, 6)), (0, 0.0, 0.0), (0, 0.0, 0.0)]
    same = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "b", "c", "d"]), (["a", "b"], ["c", "d"])], "g array<string>, r array<string>")
    assert [r[0] for r in same.select(evaluation.bleu_unclipped(F.col("g"), F.col("r"))).collect()] == [1.0, 0.0]


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "node long")
    got = {r.node: r.betweenness for r in graph.betweenness(e, nodes).collect()}
    assert got == {1: 0.0, 2: 4.0, 3: 4.0, 4: 0.0}  # each pair counted from both ends


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_lcs_matches_the_table():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 30))] for _ in range(2))
        assert evaluation.lcs(a, b) == plain_lcs(a, b)


def plain_betweenness(nodes, near):
    """Over all ordered pairs of ends, the share of shortest paths through a node."""
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, distance, paths, before = [s], {s: 0}, {s: 1}, defaultdict(list)
        for v in order:
            for w in near[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    paths[w] = 0
                    order.append(w)
                if distance[w] == distance[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


def test_betweenness_matches_a_plain_version(spark):
    r = random.Random(8)
    edges = {tuple(sorted(r.sample(range(25), 2))) for _ in range(34)} | {(i, i + 1) for i in range(30, 42)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {x.node: x.betweenness for x in graph.betweenness(e, graph.sampled_pivots(e)).collect()}
    want = plain_betweenness(sorted(near), near)
    assert got == pytest.approx({n: want[n] for n in got}) and {n for n, v in want.items() if v} <= set(got)
    assert max(x.distance for x in graph.distances(graph.undirected(e), spark.createDataFrame([(30,)], "node long")).collect()) == 12


def test_streams_over_folders_and_nothing(spark, tmp_path, data):
    """A table of three files, one of a single file, and an empty one."""
    from tessella.streaming import events

    whole = spark.read.parquet(f"{data}/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "a" / "events.parquet"))
    whole.where("false").write.parquet(str(tmp_path / "none" / "events.parquet"))
    n = {}
    for folder in (str(tmp_path / "a"), data, str(tmp_path / "none")):
        s = events.first_of(events.read_events(spark, folder, "events.parquet"), ["event_id"])
        counts = events.windowed_counts(events.read_events(spark, folder, "events.parquet"), ["event_type"], "1 day")
        n[folder] = events.run_available(s).count(), sum(r.n for r in events.run_available(counts, "complete").collect())
    assert list(n.values()) == [(whole.count(), whole.count())] * 2 + [(0, 0)]


def test_merge_keeps_rows_of_either_side(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    assert memory.merge_scores(a.selectExpr("id", "1.0D AS score"), a.selectExpr("id + 1 AS id", "0.5D AS score"), ["id"]).count() == 3


def test_sections_follow_the_list(spark):
    """A repeated heading takes the level of its next entry, a skipped level is added, a table stays whole, numbers are labels."""
    text = ["front", "## Scope", "1. one", "2. two", "## Rules", "Table 3 x", "1. y", "## Deep", "plain", "## Rules", "9. last", "## Attachment B", "z"]
    listed = [(1, "1", " Scope "), (2, "2", "Rules"), (3, "3", "Deep"), (4, "1", "Rules"), (5, "1", "Attachment B"), (6, "x", "Bad"), (7, "1", None)]
    lines = spark.createDataFrame([("doc", i, x) for i, x in enumerate(text)], "doc string, pos int, line string")
    headings = spark.createDataFrame([("the DOC list", i, level, h) for i, level, h in listed] + [("other", 1, "1", "Scope")], "file string, idx int, level string, heading string")
    got = [(r.hierarchy, r.reference, r.corpus) for r in sections.hierarchy_chunks(lines, headings).orderBy("section", "part").collect()]
    assert got == [
        ("doc > doc - Scope", "doc Para 1.", "1. one"), ("doc > doc - Scope", "doc Para 2.", "2. two"), ("doc > doc - Scope > Rules", "doc Table 3", "Table 3 x\n1. y"),
        ("doc > doc - Scope > Rules > Deep", "doc Orphan 1", "plain"), ("doc > doc - Rules", "doc Para 9.", "9. last"), ("doc > Attachment B", "doc, Attachment B Orphan 1", "z"),
    ]


def test_plan_levels_with_a_cycle(spark):
    nodes = spark.createDataFrame([("p", i) for i in range(1, 7)] + [("q", 1), ("q", 2)], "plan_id string, node int")
    edges = spark.createDataFrame([("p", a, b) for a, b in ((1, 2), (1, 3), (2, 4), (3, 5), (4, 5), (5, 6))] + [("q", 1, 2), ("q", 2, 1)], "plan_id string, src int, dst int")
    got = {(r.plan_id, r.node): r.level for r in plangraph.topological_levels(nodes, edges).collect()}
    assert got == {("p", 1): 1, ("p", 2): 2, ("p", 3): 2, ("p", 4): 3, ("p", 5): 4, ("p", 6): 5, ("q", 1): None, ("q", 2): None}


def test_similar_hyperedges_match_all_pairs(spark):
    r = random.Random(5)
    sets = {i: set(r.sample(range(14), r.randrange(2, 7))) for i in range(60)}
    m = spark.createDataFrame([(i, "t" if i % 2 else "u", n) for i, s in sets.items() for n in s], "edge_id long, edge_type string, node_id long")
    got = {(x.edge_a, x.edge_b) for x in hypergraph.similar_hyperedges(m).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and len(sets[a] & sets[b]) >= 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5}
    assert got == want and want


def test_memory_merge_with_an_empty_side(spark):
    a = spark.createDataFrame([(1, 0.5)], "id long, score double")
    none = spark.createDataFrame([], "id long, score double")
    assert memory.merge_scores(a, none, ["id"]).collect()[0].score == 0.5
    b = spark.createDataFrame([(2, 1.0), (1, 1.0)], "id long, score double")
    assert {r.id: round(r.score, 6) for r in memory.merge_scores(a, b, ["id"]).collect()} == {1: 0.65, 2: 0.3}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Guide.md").write_text("# T\nbody\n", encoding="utf-8")
    (tmp_path / "in" / "skip.bin").write_bytes(b"x")
    found = files.discover_documents(spark, str(tmp_path / "in"))
    assert [(r.document_name, r.extension) for r in found.collect()] == [("GUIDE", "md")]
    assert chunking.heading_sections(files.read_lines(spark, str(tmp_path / "in" / "Guide.md"))).first().corpus == "body"
    (tmp_path / "h.csv").write_text("﻿Level,Heading,File,Index\n1, Scope ,DOCA,1\nx,Bad,DOCA,2\n2,,DOCA,3\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_headings(spark, str(tmp_path / "h.csv")).collect()] == [(1, "Scope", "DOCA", 1)]
    nodes, edges = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(1, 2, "SIMILAR")], "src long, dst long, edge_type string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 1 and e.first().edge_type == "SIMILAR"
    with pytest.raises(ValueError):
        files.read_checked(spark, str(tmp_path / "g" / "nodes"), ["node", "text"])
    files.export_json(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().v == "[1.0]"
