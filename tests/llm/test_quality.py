import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality as Q


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def test_query_matches_a_plain_version(spark, data, documents):
    want = {}
    for r in documents.collect():
        c = plain_counts(r.text)
        want[r.doc_id] = (*c, c[0] < 10 or 100 * c[4] > 20 * c[0])
    got = {r.doc_id: r for r in Q.op6_quality(spark, data).collect()}
    assert {i: tuple(r)[1:7] for i, r in got.items()} == want
    assert not any(r.base_failed and r.kept for r in got.values())


def test_outliers_go_and_clean_rows_stay(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("aeinorst"), r.integers(2, 9)))
    rows = [(i, "en", f"s{i % 2}", " ".join(word() for _ in range(int(r.integers(30, 400))))) for i in range(400)]
    rows += [(1000 + i, "en", "s0", " ".join(word() + "#%$!!" for _ in range(120))) for i in range(20)]
    rows += [(2000 + i, "fr", "s9", " ".join(word() for _ in range(100))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    kept = {x.row.doc_id: x.kept for x in Q.judge(df).collect()}
    assert sum(kept[i] for i in range(400)) >= 399
    assert not any(kept[1000 + i] for i in range(20))
    assert all(kept[2000 + i] for i in range(3))  # too few to judge


def test_concentration_finds_the_majority(spark):
    """A fifth of far rows does not draw the estimate away: its mean is that of the others."""
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (500, Q.P))
    x[:100] += 30
    fit = Q.fit_groups(vectors(spark, x)).first()
    assert all(abs(m) < 0.3 for m in fit["mean"])


def vectors(spark, x):
    whole = np.round(x * Q.UNIT).astype(int)
    return spark.createDataFrame([("g", *map(int, v)) for v in whole], "grp string, " + ", ".join(f"x{i} int" for i in range(Q.P)))


def plain_mcd(x, starts, r):
    """The least determinant, with its mean and covariance, over concentration steps from many random starts."""
    best = None
    for _ in range(starts):
        own = x[r.choice(len(x), Q.P + 2, replace=False)]
        mean, cov, last = own.mean(0), np.cov(own.T) + np.diag(np.square(Q.FLOORS)), np.inf
        while True:
            d = x - mean
            near = x[np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))[: len(x) // 2]]
            mean, cov = near.mean(0), Q.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(Q.FLOORS))
            logdet = np.linalg.slogdet(cov)[1]
            if logdet > last - 1e-6:
                break
            last = logdet
        if best is None or logdet < best[0]:
            best = logdet, mean, cov
    return best


def test_the_estimate_is_as_tight_as_a_plain_search(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (600, Q.P)) @ r.normal(0, 0.5, (Q.P, Q.P))
    x[:200] = x[200] + 15 + r.normal(0, 0.01, (200, Q.P))  # a third in one far place
    fit = Q.fit_groups(vectors(spark, x)).first()
    cov = np.linalg.inv(np.array(fit["inverse"]).reshape(Q.P, Q.P))
    logdet, mean, _ = plain_mcd(x, 40, r)
    assert np.linalg.slogdet(cov)[1] <= logdet + 0.3
    assert np.abs(np.array(fit["mean"]) - mean).max() < 0.3


def test_more_groups_and_starts_than_a_task_holds(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = vectors(spark, r.normal(0, 1, (300, Q.P))).withColumn("grp", F.concat(F.lit("g"), F.col("x0") % 3))
    want = sorted(map(tuple, Q.fit_groups(df).collect()))
    monkeypatch.setattr(Q, "HELD", 10)
    assert sorted(map(tuple, Q.fit_groups(df.repartition(7)).collect())) == want


def test_a_third_of_junk_copies_goes(spark):
    """A tight junk group of a third of its source is not kept whole, and the rows beside it stay."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("aeinorst"), r.integers(2, 9)))
    junk = " ".join(word() + "#%$!!" for _ in range(120))
    rows = [(i, "en", "s", " ".join(word() for _ in range(int(r.integers(30, 400))))) for i in range(400)]
    rows += [(1000 + i, "en", "s", junk) for i in range(200)]
    kept = {x.row.doc_id: x.kept for x in Q.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert not any(kept[1000 + i] for i in range(200))
    assert sum(kept[i] for i in range(400)) >= 396


def test_odd_rows(spark, odd, empty):
    got = Q.judge(odd)
    assert got.count() == odd.count() and not any(r.kept for r in got.where("counts.n_words < 10").collect())
    assert Q.judge(empty).count() == 0
    assert Q.keep_good(odd).columns == odd.columns
    for _, t in [(0, "a b c d e " * 4), (0, "x\n\n \nx\ny\nx"), (0, None)]:
        assert Q.count_text(t.encode() if t else None)[:5] == plain_counts(t)


def test_plans_stay_small(spark, monkeypatch):
    """The driver holds every plan: the distance names each estimate a few times, and no step carries the plan of the one before."""
    plans = []
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(Q, "materialize", lambda df, name="table", write=Q.materialize: (plans.append(plan_of(df)), write(df, name))[1])
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 500, draw.integers(20, 200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, "en", "s", x) for i, x in enumerate(texts)], "doc_id long, lang string, source string, text string")
    judged = Q.judge(docs)
    assert plan_of(judged).count("mean#") < 20 and plan_of(judged).count("ln(") == 0
    assert max(p.count("Join") for p in plans) <= 4
    assert judged.where("kept").count() > 140
