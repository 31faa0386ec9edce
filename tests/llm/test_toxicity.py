import math
import random
import zlib

import numpy as np

from tessella.llm import toxicity as T


def all_maximal(scores):
    """Maximal scoring segments by definition: the best segment, then those of what lies on either side."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best[0] + 1e-12 or abs(s - best[0]) <= 1e-12 and s > 0 and (j - i) < best[2] - best[1]:
                best = (s, i, j)
    if best[0] <= 0:
        return []
    _, a, b = best
    return all_maximal(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in all_maximal(scores[b:])]


def test_segments_match_the_definition():
    r = random.Random(6)
    for _ in range(200):
        scores = [r.choice([-3.1, -1.3, -0.7, 1.1, 2.3, 3.7]) + r.random() / 7 for _ in range(r.randrange(1, 14))]
        got = [(a, b) for a, b, _ in T.maximal_segments(np.array(scores))]
        assert got == all_maximal(scores)
    assert T.maximal_segments(np.array([])) == [] and T.maximal_segments(np.array([-1.0])) == []


def test_a_late_passage_is_found():
    """Evidence that came often before counts again in the last passage, and each copy of a passage is reported."""
    model = T.Model({b"=vermin": 2.0, b"=scum": 2.5}, cost=-0.1)
    passage, gap = "vermin scum vermin scum", "plain " * 200
    text = (gap + passage + " ") * 5
    found = T.passages(text.encode(), model)
    assert [(a, b) for a, b, *_ in found] == [(204 * k + 200, 204 * k + 204) for k in range(5)]


def planted(n=900, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "do", "ki", "lu", "me", "sa"]) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [word() for _ in range(r.randrange(20, 200))]
        if toxic:
            for _ in range(max(2, len(words) // 40)):
                words.insert(r.randrange(len(words)), r.choice(["vermin", "zorg" + word(), "ZORG" + word() + "."]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in T.score_toxicity(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((score[i] >= T.THRESHOLD) == bool(labels[i][1]) for i in held)
    assert right >= 0.97 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = planted(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lie = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one, two = (T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, lie))
    assert one.scores == two.scores and np.allclose(one.curve, two.curve)


def test_query_and_odd_rows(spark, data, odd, empty):
    got = T.op8_toxicity(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    rows, labels = planted(300)
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = T.score_toxicity(odd, model).collect()
    assert len(scored) == odd.count() and len({r.score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    none = T.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in T.score_toxicity(odd, none).collect()} == {0.5} and T.score_toxicity(empty, none).count() == 0


def plain_counts(rows):
    """Evidence of (text, toxic, fold) rows: binary digits of its count in each text, and texts, by fold and class."""
    out = {}
    for text, toxic, fold in rows:
        found = []
        for w in text.lower().split():
            w = w.strip(T.EDGES)
            found += ["=" + w] + ["^" + w[:n] for n in (4, 5, 6, 7) if len(w) >= n]
        for e in set(found):
            row = out.setdefault(e.encode(), [0] * 8)
            row[2 * fold + toxic] += len(bin(found.count(e))) - 2
            row[4 + 2 * fold + toxic] += 1
    return {e: tuple(x) for e, x in out.items()}


def test_counts_and_scores_match_a_plain_version(spark):
    texts, labels = planted(200, seed=5)
    rows = [(t, y, i % 2) for (i, t), (_, y) in zip(texts, labels, strict=True)]
    got = {bytes(r.term): tuple(r)[1:] for r in T.evidence_counts(spark.createDataFrame(rows, "text string, toxic int, fold int").repartition(3)).collect()}
    assert got == plain_counts(rows)
    docs = spark.createDataFrame([(i, t[:120]) for i, t in texts], "doc_id long, text string")
    model = T.fit(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in T.score_toxicity(docs, model).collect():
        scores = []
        for w in texts[r.doc_id][1][:120].lower().split():
            w = w.strip(T.EDGES)
            own = model.scores.get(b"=" + w.encode())
            begun = [s for n in (7, 6, 5, 4) if len(w) >= n and (s := model.scores.get(b"^" + w[:n].encode(), 0)) > 0]
            scores.append(own if own is not None else begun[0] if begun else model.cost)
        bits = [(sum(scores[a:b]), (model.decay * sum(scores[a:b]) - math.log(0.1 * max(len(scores), 2))) / math.log(2)) for a, b in all_maximal(scores)]
        bits = [x for x in bits if x[1] > 0]
        a, b, c = model.curve
        x = a + b * math.log1p(sum(x for _, x in bits)) + c * max((s for s, _ in bits), default=0.0)
        assert abs(r.score - 1 / (1 + math.exp(-x))) < 1e-6


def test_a_rare_class_is_fitted_whole(spark):
    rows, labels = planted(900, seed=7)
    labels = [(i, y if i % 50 == 0 else 0) for i, y in labels]
    rows = [(i, t) for (i, t), (_, y) in zip(rows, labels, strict=True) if y or i % 5]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, marks, (60, 60))
    score = {r.doc_id: r.score for r in T.score_toxicity(docs, model).collect()}
    toxic = {i for i, y in labels if y}
    assert model.scores and sum(score[i] for i in toxic) / len(toxic) > 5 * sum(v for i, v in score.items() if i not in toxic) / (len(score) - len(toxic))


def test_clashing_labels_are_toxic_on_every_run(spark):
    rows, labels = planted(300)
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in rows], "doc_id long, text string")
    twice = labels + [(1000 + i, 0) for i, _ in labels]
    one, two = (T.fit(docs.repartition(n), spark.createDataFrame(twice, "doc_id long, toxic int")) for n in (1, 5))
    assert one.scores == two.scores and np.allclose(one.curve, two.curve)
