import hashlib
import math
from collections import Counter

import xxhash

from tessella.llm import imatch as M


def plain_fingerprint(text, words):
    """64 hashes of 16 digits, one for each random subset of the lexicon; a text without lexicon terms uses all its terms."""
    own = set(text.encode().lower().split())
    own = own & words or own
    out = []
    for k in range(64):
        share = 1 / 8 if k < 8 else 1 / 32 if k < 20 else 1 / 128 if k < 40 else 1 / 512
        chosen = sorted(t for t in own if xxhash.xxh64(t, seed=k).intdigest() < int(share * 2**64))
        out.append(xxhash.xxh64(b" ".join(chosen)).hexdigest() if chosen else "." * 16)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x[0] != "." or y[0] != "."]
    return 1.0 if a == b else sum(x == y for x, y in used) / len(used)


def plain(docs):
    """doc_id -> the query's columns, from (doc_id, text) rows with distinct ids."""
    df = Counter(w for _, t in docs for w in set(t.encode().lower().split()))
    words = {w for w, n in df.items() if math.ceil(0.0005 * len(docs)) <= n <= 0.2 * len(docs)}
    order = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        p, q, n = (plain_fingerprint(x, words) for x in (t, e, after))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(p), "".join(q), plain_likeness(p, q), plain_likeness(p, n))
    return out


def test_query_matches_a_plain_version(spark, data, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in M.op3_imatch(spark, data).collect()}
    assert got == plain(docs)
    assert sum(v[4] > v[5] for v in got.values()) > 0.85 * len(got)


def test_equal_texts_and_likeness():
    words = frozenset({b"a", b"b"})
    assert M.fingerprint("b a A", words) == M.fingerprint("a\nb", words)
    assert M.likeness(M.fingerprint("", words), M.fingerprint(" ", words)) == 1.0
    long = " ".join(f"w{i}" for i in range(400))
    lex = frozenset(f"w{i}".encode() for i in range(800))
    near, far = M.fingerprint(long.replace("w7 ", "w700 "), lex), M.fingerprint(" ".join(f"w{i}" for i in range(400, 800)), lex)
    own = M.fingerprint(long, lex)
    assert 1 > M.likeness(own, near) > 0.7 and M.likeness(own, far) < 0.1


def test_odd_rows(spark, odd, empty):
    got = M.compare_neighbours(odd).collect()
    assert len(got) == odd.count()
    assert M.compare_neighbours(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[2].n_chars == 0 and by[2].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].fingerprint == by[5].fingerprint and by[6].near_next == 1.0
    one = M.compare_neighbours(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abab").hexdigest()]


def test_a_large_band_gives_a_lexicon_of_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i, i + 30))) for i in range(100)], "doc_id long, text string")
    whole = M.lexicon(docs, 0.0, 1.0)
    monkeypatch.setattr(M, "MOST_TERMS", 20)
    part = M.lexicon(docs, 0.0, 1.0)
    assert len(part) == 20 and part < whole and part == M.lexicon(docs.repartition(3), 0.0, 1.0)
    assert len({r.fingerprint for r in M.compare_neighbours(docs).collect()}) > 50
