import hashlib
import random
import zlib

import pytest

from tests.compare import spark_rows, sql_rows
from tessella.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(digests, arity=3):
    """The root, and for each digest its path: (siblings before, siblings after) a level."""
    groups = [[i] for i in range(len(digests))]  # the leaves below each node
    paths, nodes = [[] for _ in digests], list(digests)
    while len(nodes) > 1:
        up, up_groups = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for i in range(len(run)):
                for leaf in groups[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            up_groups.append([x for g in groups[at : at + arity] for x in g])
        nodes, groups = up, up_groups
    return nodes[0], paths


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: b"" if s is None else b"1" + s.encode())
    trees = {}
    for s in order:
        own = sorted(by_source[s], key=lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), plain_leaf(r, r["text"])))
        trees[s] = own, *plain_tree([plain_leaf(r, r["text"]) for r in own])
    root, tops = plain_tree([trees[s][1] for s in order]) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            leaf, whole = plain_leaf(r, r["text"]), path + top
            cut = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and cut is not None:
                cut = cut.replace("\n", "")
            x = plain_leaf(r, cut)
            for before, after in whole:
                x = h(before, x, after)
            out.append((r["doc_id"], leaf, subroot, root, h(*(b + a for b, a in whole)), x, x == root))
    return out


def query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = M.op13_merkle(spark, str(tmp_path)).collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got]


def test_sql_and_query_match_a_plain_version(spark, data, documents):
    columns, rows = spark_rows(M.op13_merkle(spark, data))
    assert (columns, rows) == sql_rows(M.OP13_SQL, data)
    want = plain_manifest([r.asDict() for r in documents.collect()])
    order = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    at = [columns.index(c) for c in order]
    assert sorted(tuple(r[i] for i in at) for r in rows) == sorted(want)
    assert {r[6] for r in want} == {True, False}


def test_odd_rows(spark, odd, empty, tmp_path):
    got = query(spark, odd, tmp_path / "odd")
    assert sorted(got, key=repr) == sorted(plain_manifest([r.asDict() for r in odd.collect()]), key=repr)
    assert query(spark, empty, tmp_path / "empty") == []


@pytest.mark.parametrize("sources,rows", [(1, 1), (1, 40), (30, 100), (9, 9)])
def test_shapes_of_trees(spark, tmp_path, sources, rows):
    """Trees of unlike heights, a hot source, equal ids and rows, null sources."""
    rng = random.Random(rows)
    made = [(rng.choice([None, *range(rows)]), rng.choice(["a\nb", "c", None, ""]), "en", None if i % sources == 0 else f"s{min(i % sources, 5 + i % 2 * 20)}", i % 3) for i in range(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(query(spark, docs, tmp_path), key=repr) == sorted(plain_manifest([r.asDict() for r in docs.collect()]), key=repr)


def test_binary_trees(spark, documents):
    got = {r.doc_id: r for r in M.manifest(documents, arity=2).select("doc_id", "leaf", "root", M.fold(M.F.col("leaf"), M.F.col("path")).alias("folded")).collect()}
    assert len(got) == documents.count() and len({bytes(r.root) for r in got.values()}) == 1
    assert all(r.folded == bytes(r.root).hex() for r in got.values())
