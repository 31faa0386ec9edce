"""Incremental builds against a build of everything, with broken runs, touched and vanished files."""

import os

import pytest

from tessella.operators import building
from tessella.sources import files


def write(folder, name, text, time):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)
    os.utime(f"{folder}/{name}", (time, time))


MD = "front\n# Scope\nAll of it.\n## Limits\n" + "Some limits apply here. " * 120 + "\n# End\nDone."


@pytest.fixture
def folder(tmp_path):
    path = f"{tmp_path}/raw"
    write(path, "a.md", MD, 1_700_000_000)
    write(path, "b.txt", "plain words " * 200, 1_700_000_000)
    write(path, "empty.txt", "", 1_700_000_000)
    write(path, "c.pdf", "not text", 1_700_000_000)
    return path


def tables(spark, base):
    return {t: sorted(map(repr, building.read_base(spark, base, t).select(*sorted(building.read_base(spark, base, t).columns)).collect())) for t in building.TABLES}


def test_two_runs_equal_one_and_read_new_files_only(spark, folder, tmp_path):
    base = f"{tmp_path}/base"
    first = building.build_folder(spark, folder, base)
    assert (first["run"], first["read"], first["built"], first["kept"], first["gone"]) == (1, 2, 2, 0, 0)  # Spark lists no empty files
    # other content under the same size and time: a run that read it would see it
    write(folder, "b.txt", "other words " * 200, 1_700_000_000)
    write(folder, "d.md", "# Title\nNew text.", 1_700_000_100)
    write(folder, "a.md", MD + " More.", 1_700_000_200)
    second = building.build_folder(spark, folder, base)
    assert (second["run"], second["read"], second["built"], second["kept"], second["gone"]) == (2, 2, 2, 1, 0)
    stats = building.statistics(spark, base).first()
    assert (stats.runs, stats.documents) == (2, 4) and stats.distinct_terms == 17
    write(folder, "b.txt", "plain words " * 200, 1_700_000_000)
    building.build_folder(spark, folder, f"{tmp_path}/whole")
    assert tables(spark, base) == tables(spark, f"{tmp_path}/whole")
    os.utime(f"{folder}/d.md", (1_700_000_900,) * 2)
    os.remove(f"{folder}/a.md")
    third = building.build_folder(spark, folder, base)
    assert (third["read"], third["built"], third["kept"], third["gone"]) == (1, 0, 1, 1)
    assert {r.document_name for r in building.read_base(spark, base, "chunks").collect()} == {"B", "D"}
    again = building.build_folder(spark, folder, base)
    assert (again["read"], again["chunks"]) == (0, 0)


def test_a_broken_run_leaves_the_last_base(spark, folder, tmp_path, monkeypatch):
    base = f"{tmp_path}/base"
    building.build_folder(spark, folder, base)
    before = tables(spark, base)
    write(folder, "d.md", "# Title\nNew text.", 1_700_000_100)
    real = building.episodes
    monkeypatch.setattr(building, "episodes", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        building.build_folder(spark, folder, base)
    assert os.path.isdir(f"{base}/chunks/run=1") and tables(spark, base) == before
    monkeypatch.setattr(building, "episodes", real)
    assert building.build_folder(spark, folder, base)["run"] == 2
    assert {r.document_name for r in building.read_base(spark, base, "chunks").collect()} == {"A", "B", "D"}
    with pytest.raises(ValueError):
        building.build_folder(spark, folder, f"{tmp_path}/none", building.Options(embedding="unknown"))
    assert not os.path.exists(f"{tmp_path}/none")


def test_what_is_built(spark, folder, tmp_path):
    base = f"{tmp_path}/base"
    building.build_folder(spark, folder, base)
    chunks = building.read_base(spark, base, "chunks").collect()
    a = sorted((r.section, r.chunk_no, r.hierarchy, r.level) for r in chunks if r.document_name == "A")
    assert a == [(1, 0, "Scope", 1), *((2, i, "Scope > Limits", 2) for i in range(4)), (3, 0, "End", 1)]
    assert all(len(r.corpus_vector) == 256 and len(r.corpus) <= 1000 for r in chunks) and len({r.chunk_id for r in chunks}) == len(chunks)
    assert not [r for r in chunks if r.document_name == "EMPTY"]
    nodes, edges = building.read_base(spark, base, "nodes").collect(), building.read_base(spark, base, "edges").collect()
    named = {r.node: (r.node_type, r.label) for r in nodes}
    assert len(named) == len(nodes) and all(e.src in named and e.dst in named for e in edges)
    children = {}
    for e in edges:
        children.setdefault(named[e.src], set()).add(named[e.dst])
    assert children[("Document", "A")] == {("Section", "Scope"), ("Section", "End")}
    assert ("Section", "Limits") in children[("Section", "Scope")] and ("Chunk", "A 1.1") in children[("Section", "Scope")]
    assert len(edges) == len(nodes) - 2  # a tree for each document
    memories = building.read_base(spark, base, "memories").collect()
    assert sorted(r.entity for r in memories) == ["A"] * 5 + ["B"] * 3
    assert files.discover_documents(spark, folder).count() == 3
