"""Merged sketches against exact counts."""

import random

from tessella.operators import statistics as S


def test_two_runs_merge_into_one(spark):
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(20_000)}" for _ in range(rng.randrange(60))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    half = spark.createDataFrame([(t,) for t in texts[:1000]], "text string"), spark.createDataFrame([(t,) for t in texts[1000:]], "text string")
    merged = S.merged_statistics(S.run_statistics(half[0], 1).unionAll(S.run_statistics(half[1], 2))).first()
    whole = S.merged_statistics(S.run_statistics(df, 1)).first()
    assert (merged.documents, merged.bytes, merged.occurrences) == (whole.documents, whole.bytes, whole.occurrences) == (3002, sum(len(t or "") for t in texts), sum(len((t or "").split()) for t in texts))
    exact = len({w for t in texts for w in (t or "").split()})
    lengths = sorted(len(t or "") for t in texts)
    for r in (merged, whole):
        assert abs(r.distinct_terms - exact) <= S.HLL_ERROR * exact
        for q, v in zip((0.25, 0.5, 0.75), r.length_quantiles, strict=True):
            low, high = sum(x < v for x in lengths) / len(lengths), sum(x <= v for x in lengths) / len(lengths)
            assert low - S.KLL_ERROR <= q <= high + S.KLL_ERROR


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string")
    r = S.merged_statistics(S.run_statistics(empty, 1)).first()
    assert (r.documents, r.bytes, r.distinct_terms, r.length_quantiles) == (0, 0, 0, None)
