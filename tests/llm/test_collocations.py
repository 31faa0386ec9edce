import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import spark_rows, sql_rows
from tessella.llm import collocations as C


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def plain_counts(rows):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        for piece in plain_words(text):
            sizes[lang or "und"] += len(piece)
            for size in range(1, 5):
                for i in range(len(piece) - size + 1):
                    counts[lang or "und", tuple(piece[i : i + size])] += 1
    return counts, sizes


def plain_collocations(rows, least=30, top=2000):
    counts, sizes = plain_counts(rows)
    f = {k: n for k, n in counts.items() if n >= least}
    held = {}
    for (lang, p), n in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                k = lang, p[i : i + size]
                held[k] = max(held.get(k, 0), n)
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or 100 * held.get((lang, p), -1) >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, sizes[lang], -score) for lang, found in out.items() for i, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_sql_and_query_match_a_plain_version(spark, data, documents):
    columns, rows = spark_rows(C.op12_collocations(spark, data))
    assert len(rows) > 20 and (columns, rows) == sql_rows(C.OP12_SQL, data)
    want = plain_collocations([(r.lang, r.text) for r in documents.collect()])
    assert rows_of(C.op12_collocations(spark, data)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aAbé漢 \t\n\x0b\x0c\r.,;:!?\x1c\x85\xa0-\x00")), max_size=40), max_size=5))
def test_words_of_any_text(texts):
    codes, words, piece = C.split_words([t.encode() for t in texts])
    found = {}
    for c, p in zip(codes, piece, strict=True):
        found.setdefault(p, []).append(words[c].as_py().decode())
    assert list(found.values()) == [p for t in texts for p in plain_words(t) if p]


def shifting(rows=120):
    """Words and phrases that get frequent in some shards only, so that cycles start at every step."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "Of", "漢字"]
    made = []
    for i in range(rows):
        chosen = vocabulary[: 2 + i % 4 * 3] if i % 7 else vocabulary
        made.append((rng.choice(["en", "en", "en", None, "fr"]), rng.choice([" ", "  "]).join(rng.choices(chosen, k=rng.randint(0, 40))) + rng.choice(["", ". the of w1 w2, w3", "\nw1 w2 w3 w4"])))
    return made


def test_counts_are_exact_for_any_cycle_table_and_chunk(spark):
    """A table of two slots says yes to everything; one chunk a text says as little as can be known."""
    made = shifting()
    docs = spark.createDataFrame(made, "lang string, text string").repartition(3)
    counts, sizes = plain_counts(made)
    want = {(lang, " ".join(p)): n for (lang, p), n in counts.items() if n >= 10}
    assert len({len(p) for _, p in counts}) == 4
    for cycle, slots, chunk in ((1, 1 << 20, 1 << 20), (4, 1 << 20, 1), (3, 2, 100), (5, 64, 1 << 20)):
        phrases, words = C.frequent_phrases(docs, least=10, cycle=cycle, slots=slots, chunk=chunk)
        assert {(r.lang, r.phrase): r.f for r in phrases.collect()} == want and phrases.count() == len(want)
        assert {r.lang: r.n for r in words.collect()} == dict(sizes)
    assert rows_of(C.collocations(docs, top=9, least=10)) == plain_collocations(made, 10, 9)


def test_long_phrases_of_many_words_do_not_overflow():
    codes = np.array([0, 1, 2, 3, 0, 1, 2, 3, 0], dtype=np.int32)
    at, counts = C.distinct_grams(codes, np.arange(6), 4, 1 << 30)
    assert sorted(zip(at.tolist(), counts.tolist(), strict=True)) == [(0, 2), (1, 2), (2, 1), (3, 1)]


def test_odd_rows(spark, odd, empty):
    want = plain_collocations([(r.lang, r.text) for r in odd.collect()], 1)
    assert rows_of(C.collocations(odd, least=1)) == want and any("word word word word" == r[2] for r in want)
    assert C.collocations(empty).count() == 0
