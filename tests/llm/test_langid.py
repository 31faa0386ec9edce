import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid as L


@pytest.fixture(scope="module")
def learned(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return L.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(1)
    scores, transitions = rng.normal(size=(3, 4, 3)) * 3, rng.normal(size=(3, 3))
    filled = np.arange(4) < np.array([[4], [2], [1]])
    chances, expected, log_z = L.forward_backward(scores, transitions, filled)
    want_steps = np.zeros((3, 3))
    for r, n in enumerate((4, 2, 1)):
        total, sums, steps = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for labels in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[r, t, y] for t, y in enumerate(labels)) + sum(transitions[a, b] for a, b in itertools.pairwise(labels)))
            total += w
            for t, y in enumerate(labels):
                sums[t, y] += w
            for a, b in itertools.pairwise(labels):
                steps[a, b] += w
        assert np.allclose(chances[r, :n], sums / total)
        assert np.isclose(log_z[r], np.log(total))
        want_steps += steps / total
    assert np.allclose(expected, want_steps)


def test_features_of_words():
    rows, starts = L.word_features(["ab", "x", "漢字", "abc"])
    each = np.split(rows, starts[1:])
    # n-grams of "^ab$": 3 of two, 2 of three; affixes of one and two characters at either end
    assert [len(x) for x in each] == [3 + 2 + 4, 2 + 1 + 2, 3 + 2 + 4, 4 + 3 + 6]
    again, _ = L.word_features(["abc"])
    assert sorted(again) == sorted(each[3]) and set(each[0]) & set(each[3]) and rows.max() < L.WEIGHTS


def test_clean_words():
    assert [L.clean(x.encode()) for x in ("abc", "«Été»", "漢字。", "–", "ÉÈ")] == ["abc", "été", "漢字", "", "éè"]


def test_lexicon_counts_every_word_of_the_texts_to_learn_from(spark):
    docs = spark.createDataFrame([("en", "The cat the. Été 5cats"), ("en", "cat"), ("fr", "le CAT")], "lang string, text string").repartition(3)
    assert {(r.lang, r.word): r.n for r in L.word_counts(docs).collect()} == {("en", "the"): 2, ("en", "cat"): 2, ("en", "été"): 1, ("en", "cats"): 1, ("fr", "le"): 1, ("fr", "cat"): 1}
    labels, lexicon, odds = L.lexicon_of(L.word_counts(docs))
    assert labels == ["en", "fr"] and odds[lexicon["cat"]].argmax() == 1 and odds[lexicon["the"]].argmax() == 0 and not odds[0].any()


def test_held_out_accuracy(spark, data, documents):
    got = L.op11_langid(spark, data).collect()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_only_rows_to_learn_from_count(spark, data, documents, learned, tmp_path):
    """Languages, sources and ids of held-out rows changed: no prediction changes."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.op11_langid(spark, d).collect()} for d in (data, str(tmp_path)))
    assert a == b


def test_switches_within_a_text(spark, documents, learned):
    """A text of two languages is cut where they meet, in code points; every word is labelled, over more than one run."""
    de, fr = (documents.where(f"lang = '{x}' AND n_chars > 800").orderBy("doc_id").first().text[:700].rsplit(" ", 1)[0] for x in ("de", "fr"))
    texts = spark.createDataFrame([(1, f"🙂 {de} {fr}"), (2, None), (3, "1 2 – 3"), (4, f"{fr} {de} " * 40)], "doc_id long, text string")
    spans = sorted(tuple(r) for r in L.language_spans(texts, learned).collect())
    one = [s for s in spans if s[0] == 1]
    right = sum(min(e, 2 + len(de)) - max(s, 2) for _, s, e, lang in one if lang == "de" and s < 2 + len(de))
    assert right > 0.95 * len(de) and one[-1][3] == "fr" and one[-1][2] <= 3 + len(de) + len(fr)
    assert {s[0] for s in spans} == {1, 4}
    got = {r.doc_id: r for r in L.predict(texts, learned, [F.col("doc_id")]).collect()}
    assert (got[2].lang_pred, got[3].lang_pred, got[2].score) == ("und", "und", 0.0) and got[4].lang_pred in ("de", "fr")
    assert got[4].n_words > 64 * 10 and got[1].n_words == len(L.split_bytes(f"{de} {fr}".encode(), L._KIND)[1])


def test_small_slices_and_batches_give_the_same(spark, learned, monkeypatch):
    texts = [b"the cat and the dog " * 30, b"", "le été des aux ".encode() * 50, b"x"]
    whole = [np.concatenate(x) for x in zip(*L.label_chunk(texts, learned), strict=True)]
    monkeypatch.setattr(L, "BLOCKS", 2)
    parts = [np.concatenate(x) for x in zip(*L.label_chunk(texts, learned), strict=True)]
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_odd_rows(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty), ("unlabelled", odd.withColumn("lang", F.lit(None).cast("string"))), ("single", odd.withColumn("lang", F.lit("en")))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = L.op11_langid(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == docs.count()
        assert {r.lang_pred for r in got} <= {"en", "und"}
        assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
