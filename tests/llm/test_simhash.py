import random
import re

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{key: smallest key reachable} from {key: fingerprint}, by comparing all pairs."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], dtype=np.uint64)
    label = list(range(len(keys)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def test_query_matches_all_pairs(spark, data, documents):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in documents.select("doc_id", "text").collect()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, data).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


@pytest.mark.parametrize("plan", [S.THREE_BLOCKS, S.TWO_BLOCKS])
def test_links_of_planted_fingerprints(spark, monkeypatch, plan):
    """A dense cloud, chains of steps of 4 bits, pairs at 4 and at 5 bits, and strangers; small blocks force the grid."""
    monkeypatch.setattr(S, "HOMES", 8)
    monkeypatch.setattr(S, "VISITORS", 64)
    r = random.Random(11)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    centre = r.getrandbits(64)
    values = {flip(centre, r.randrange(0, 4)) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    for n in (4, 4, 4, 5, 5, 5):
        x = r.getrandbits(64)
        values |= {x, flip(x, n)}
    x = r.getrandbits(64)
    for _ in range(10):
        x = flip(x, 4)
        values.add(x)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = S.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), plan=plan).collect()
    back = {s: v for v, s in signed.items()}
    assert {e.src for e in links} | {e.dst for e in links} <= set(back)  # stars: their ends need not be near each other
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for e in links:
        a, b = find(back[e.src]), find(back[e.dst])
        label[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == plain_components({v: v for v in values})


def test_anchors_cover_every_close_pair():
    r = random.Random(2)
    for plan in (S.THREE_BLOCKS, S.TWO_BLOCKS):
        for _ in range(40):
            x = r.getrandbits(64)
            y = x ^ sum(1 << b for b in r.sample(range(64), 4))
            row, cell, visitor = S.anchors(np.array([x, y], dtype=np.uint64), plan)
            homes = set(cell[(row == 0) & (visitor == 0)].tolist())
            assert homes & set(cell[(row == 1) & (visitor == 1)].tolist())


def test_odd_rows(spark, odd, empty):
    got = [(r.doc_id, r.component_id) for r in S.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by = dict(got)
    assert by[1] == by[2] == by[3] == 1 and by[5] == by[6] == 5
    assert S.near_duplicates(empty).count() == 0
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted({c for i, c in got if i})
    assert S.drop_near_duplicates(empty).count() == 0


def test_unlike_texts_under_one_id_both_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (2, "Alpha beta gamma delta epsilon zeta"), (None, "one two three four five six seven"), (None, "quite another text that stands alone")]
    kept = sorted(map(tuple, S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([rows[0], rows[1], rows[4]], key=str)


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 4)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(300)]
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 300, 10)] + [" ".join(r.choice(words) for _ in range(50)) for _ in range(10)]
    got = {x.doc_id: x.component_id for x in S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == plain_components({i: plain_fingerprint(t) for i, t in enumerate(texts)})
