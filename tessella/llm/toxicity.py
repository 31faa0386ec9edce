"""Toxicity by maximum-scoring segments.

Tokens get log odds of toxic against other documents under an informative Dirichlet prior; only what is left of them at
a confidence bound counts, all else costs a little. The maximal scoring segments of a text, found in one pass, are its
toxic passages. Under the extreme-value law of such segments a passage's score turns into bits of surprise for a text of
that length; a logistic curve fitted on training rows turns these into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.runtime import materialize

#: Labelled rows of other and of toxic texts that the model is fitted on, at most in expectation: a random part of a class
#: beyond it, which the curve's intercept makes up for.
FIT_ROWS = (6_000, 2_000)
#: The prior: a flat part, and a share of a token's own count, both dealt to the classes by their size.
FLAT, SHARE = 0.2, 0.02
#: Standard errors, counted in documents, taken off log odds: the one is used whose curve fits best across two folds.
CONFIDENCES = (1.5, 2.0, 3.0, 4.0)
LEAST_DOCS, LEAST_IN_FOLD = 5, 3
K = 0.1  # of the extreme-value law, at its usual size
THRESHOLD = 0.7
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lengths of the word beginnings that are evidence too: what inflected forms have in common.
BEGINNINGS = range(4, 8)
#: Words whose scores a worker remembers.
REMEMBERED = 200_000


def evidence_of(word: str) -> list[str]:
    """A lower-case word without the marks around it, then its beginnings, longest first."""
    w = word.strip(EDGES)
    return ["=" + w, *("^" + w[:n] for n in reversed(BEGINNINGS) if len(w) >= n)]


def words_of(text: bytes) -> list[str]:
    return text.decode(errors="replace").lower().split()


def evidence(text: bytes) -> Counter:
    """The evidence of a text and how often each occurs."""
    found: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for e in evidence_of(word):
            found[e] += n
    return found


class WordScores(dict):
    """Scores of words as they stand in a text, worked out at first sight: that of the word's own evidence, else its longest beginning's against it."""

    def __init__(self, scores: dict[bytes, float], cost: float):
        super().__init__()
        named = {e.decode(): s for e, s in scores.items()}
        self.whole = {e[1:]: s for e, s in named.items() if e[0] == "="}
        self.begun = {e[1:]: s for e, s in named.items() if e[0] == "^" and s > 0}
        self.cost = cost

    def _score(self, w: str) -> float:
        found = self.whole.get(w)
        if found is None and len(w) >= BEGINNINGS[0]:
            for n in range(min(len(w), BEGINNINGS[-1]), BEGINNINGS[0] - 1, -1):
                if (found := self.begun.get(w[:n])) is not None:
                    return found
        return self.cost if found is None else found

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self._score(word.strip(EDGES))
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass(frozen=True)
class Model:
    """Scores of evidence, the cost of a word without any, the decay of the extreme-value law, and the logistic curve over (log bits, best score)."""

    scores: dict[bytes, float]
    cost: float = -0.02
    decay: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @cached_property
    def words(self) -> WordScores:
        return WordScores(self.scores, self.cost)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: each candidate remembers the one that it was held against."""
    if not len(scores) or scores.max() <= 0:
        return []
    starts = np.flatnonzero(np.concatenate([[True], (scores[1:] > 0) != (scores[:-1] > 0)]))
    sums = np.add.reduceat(scores, starts)
    ends = np.append(starts[1:], len(scores))
    low, high, span, held = [], [], [], []  # cumulative scores at either end, tokens, candidate with a lower left end
    total = 0.0
    for start, end, s in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if s <= 0:
            total += s
            continue
        left, right = total, total + s
        total = right
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = held[j]
            if j < 0 or high[j] >= right:
                break
            left, start = low[j], span[j][0]
            del low[j:], high[j:], span[j:], held[j:]
        low.append(left)
        high.append(right)
        span.append((start, end))
        held.append(j)
    return [(a, b, r - x) for (a, b), x, r in zip(span, low, high, strict=True)]


def word_scores(text: bytes, model: Model) -> np.ndarray:
    """A score for each word, wherever it stands and however often its evidence came before."""
    words = words_of(text)
    return np.fromiter(map(model.words.__getitem__, words), np.float64, len(words))


def passages(text: bytes, model: Model) -> list[tuple[int, int, float, float]]:
    """(first word, end, score, bits) of the segments that a text of this length would seldom hold by chance."""
    scores = word_scores(text, model)
    noise = math.log(K * max(len(scores), 2))
    return [(a, b, s, bits) for a, b, s in maximal_segments(scores) if (bits := (model.decay * s - noise) / math.log(2)) > 0]


def features(text: bytes, model: Model) -> tuple[float, float]:
    found = passages(text, model)
    return (math.log1p(sum(bits for *_, bits in found)), max(s for _, _, s, _ in found)) if found else (0.0, 0.0)


def probability(x: tuple[float, float], model: Model) -> float:
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x[0] + c * x[1]))))


def in_training(doc_id: Column) -> Column:
    """True where the labels of a document may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def decay_of(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum p exp(decay * s) = 1."""
    total = lambda x: float(np.sum(chances * np.expm1(np.minimum(x * scores, 700.0))))
    lo, hi = 0.0, 1.0
    while total(hi) < 0 and hi < 1e3:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 0 else (lo, mid)
    return hi


def logistic_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Newton's method with a small ridge on the slopes."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    keep = ridge * np.diag([1e-3, 1.0, 1.0]) * max(1, len(x)) / 10
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta))


def feature_column(text: Column, model: Model, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([features(t.as_py() or b"", shared.value) for t in texts], dtype=np.float64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["bits", "best"])

    measure.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(measure, T.StructType([T.StructField("bits", T.DoubleType()), T.StructField("best", T.DoubleType())]))(text.cast("binary"))


COUNTED = [f"{what}{fold}_{cls}" for what in "nd" for fold in (0, 1) for cls in (0, 1)]


def evidence_counts(rows: DataFrame) -> DataFrame:
    """term and its counts n (the binary digits of its number in each text, which damps repeats) and d (texts), by fold and class, from rows of text, toxic and fold."""
    schema = pa.schema([("term", pa.binary()), *((c, pa.int64()) for c in COUNTED)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def flush():
            table = np.array(list(sums.values()), dtype=np.int64).reshape(-1, len(COUNTED))
            out = pa.RecordBatch.from_arrays([pa.array([e.encode() for e in sums], type=pa.binary()), *(pa.array(c) for c in table.T)], schema=schema)
            sums.clear()
            return out

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                at = 2 * fold + toxic
                for e, n in evidence(text or b"").items():
                    if e not in sums:
                        sums[e] = [0] * len(COUNTED)
                    sums[e][at] += n.bit_length()
                    sums[e][at + 4] += 1
                if len(sums) > 300_000:
                    yield flush()
        yield flush()

    narrow = rows.select(F.col("text").cast("binary").alias("text"), F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold"))
    counted = narrow.mapInArrow(count, "term binary, " + ", ".join(f"{c} long" for c in COUNTED))
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTED))


@dataclass(frozen=True)
class Weights:
    """Log odds of evidence at one confidence, before the cost and the decay are known."""

    terms: list[bytes]
    scores: np.ndarray
    toxic: np.ndarray  # chances of the evidence among the words of toxic and of other texts
    other: np.ndarray
    kept: float  # part of the odds that the confidence bound leaves


def weigh(terms: np.ndarray, n0, n1, d0, d1, words0: float, words1: float, confidence: float, least: int) -> Weights:
    part1 = words1 / (words0 + words1)
    prior, prior_d = FLAT + SHARE * (n0 + n1), FLAT + SHARE * (d0 + d1)
    q1 = (n1 + prior * part1) / (words1 * (1 + SHARE))
    q0 = (n0 + prior * (1 - part1)) / (words0 * (1 + SHARE))
    odds = np.log(q1 / q0)
    doubt = confidence * np.sqrt(1 / (d1 + prior_d) + 1 / (d0 + prior_d))
    keep = (np.abs(odds) > doubt) & (d0 + d1 >= least)
    scores = np.where(odds > 0, odds - doubt, np.maximum(odds + doubt, -2.0))
    good = keep & (odds > 0)
    kept = float((scores[good] * q1[good]).sum() / (odds[good] * q1[good]).sum()) if good.any() else 1.0
    return Weights([bytes(t) for t in terms[keep]], scores[keep], q1[keep], q0[keep], kept)


def settle(w: Weights, hits: tuple[float, float]) -> Model:
    """A model from weights and the shares of words with evidence in other and in toxic texts: the cost falls to the words without."""
    good = w.scores > 0
    if not good.any():
        return Model({})
    chances = w.other[good] * min(1.0, hits[0] / w.other[good].sum())  # each word counts for one of its evidence
    rest = 1 - chances.sum()
    cost = min(-1e-3, w.kept * math.log((1 - hits[1]) / (1 - hits[0])), -1.2 * float((chances * w.scores[good]).sum()) / rest)
    decay = decay_of(np.append(w.scores[good], cost), np.append(chances, rest))
    return Model(dict(zip(w.terms, w.scores.tolist(), strict=True)), cost, decay)


def hit_rates(rows: DataFrame, sets: list[list[Weights]], spark) -> np.ndarray:
    """[set, weights, class]: share of words with evidence; set 0 and 1 over their own folds, set 2 over all."""
    shared = spark.sparkContext.broadcast([[Model(dict(zip(w.terms, w.scores.tolist(), strict=True))) for w in ws] for ws in sets])
    width = len(sets[0])

    def count(texts: pa.Array, folds: pa.Array) -> pa.Array:
        out = []
        for t, fold in zip(texts, folds.to_pylist(), strict=True):
            words = words_of(t.as_py() or b"")
            out.append([len(words), *(sum(m.words[w] > 0 for w in words) for k in (fold, 2) for m in shared.value[k])])
        return pa.array(out, type=pa.list_(pa.int64()))

    count.__annotations__ = {"texts": pa.Array, "folds": pa.Array, "return": pa.Array}
    found = rows.select("fold", "toxic", F.arrow_udf(count, T.ArrayType(T.LongType()))(F.col("text").cast("binary"), F.col("fold")).alias("h"))
    sums = found.groupBy("fold", "toxic").agg(*(F.sum(F.col("h")[i]).alias(f"h{i}") for i in range(1 + 2 * width))).collect()
    hit, words = np.full((3, width, 2), 0.5), np.ones((3, 1, 2))
    for r in sums:
        for k, at in ((r.fold, 1), (2, 1 + width)):
            hit[k, :, r.toxic] += [r[f"h{at + i}"] for i in range(width)]
            words[k, 0, r.toxic] += r.h0
    return hit / words


def fold_features(rows: DataFrame, models: list[list[Model]], spark) -> pd.DataFrame:
    """toxic, and for each confidence the features of every row under the other fold's model: at most about FIT_ROWS rows."""
    shared = spark.sparkContext.broadcast(models)

    def measure(texts: pa.Array, folds: pa.Array) -> pa.Array:
        rows = [[x for m in shared.value[1 - fold] for x in features(t.as_py() or b"", m)] for t, fold in zip(texts, folds.to_pylist(), strict=True)]
        return pa.array(rows, type=pa.list_(pa.float64()))

    measure.__annotations__ = {"texts": pa.Array, "folds": pa.Array, "return": pa.Array}
    return rows.select("toxic", F.arrow_udf(measure, T.ArrayType(T.DoubleType()))(F.col("text").cast("binary"), F.col("fold")).alias("x")).toPandas()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: tuple[int, int] = FIT_ROWS) -> Model:
    """A model from the labelled training rows; one that scores every text 0.5 where there are no rows of either class.

    Only rows that in_training allows are read. Evidence is counted in two folds; the curve, and the confidence that gives
    the best one, come from rows scored by the other fold's evidence; the final evidence is that of both. A row with several
    labels is toxic if one of them is.
    """
    spark = docs.sparkSession
    usable = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = materialize(usable, "labels")
    size = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = [min(1.0, fit_rows[cls] / max(size.get(cls, 0), 1)) for cls in (0, 1)]
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most about the fit_rows' ids
    # copies of a text are no further evidence, and fall into one fold; where their labels differ, it is toxic
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    rows = materialize(rows, "examples")
    sizes = rows.groupBy("fold", "toxic").count().collect()
    if len({(r.fold, r.toxic) for r in sizes}) < 4:
        return Model({})
    counts = materialize(evidence_counts(rows), "evidence")
    words = {c: v or 0 for c, v in counts.where("substr(term, 1, 1) = X'3D'").agg(*(F.sum(c).alias(c) for c in COUNTED)).first().asDict().items()}
    total = sum(F.col(c) for c in COUNTED if c[0] == "d")
    table = counts.where(total >= LEAST_IN_FOLD).toPandas()  # bounded: evidence of at most about fit_rows texts
    terms = table.term.to_numpy()
    column = lambda what, cls, folds: sum(table[f"{what}{f}_{cls}"].to_numpy(float) for f in folds)
    sets = []
    for folds, least in (((0,), LEAST_IN_FOLD), ((1,), LEAST_IN_FOLD), ((0, 1), LEAST_DOCS)):
        size = [sum(words[f"n{f}_{cls}"] for f in folds) for cls in (0, 1)]
        sets.append([weigh(terms, column("n", 0, folds), column("n", 1, folds), column("d", 0, folds), column("d", 1, folds), *size, c, least) for c in CONFIDENCES])
    rates = hit_rates(rows, sets, spark)
    models = [[settle(w, tuple(r)) for w, r in zip(ws, rs, strict=True)] for ws, rs in zip(sets, rates, strict=True)]
    seen = fold_features(rows, models[:2], spark)
    y, x = seen.toxic.to_numpy(float), np.array(seen.x.tolist(), dtype=float).reshape(len(seen), -1)
    best = None
    for i, model in enumerate(models[2]):
        curve = logistic_curve(x[:, 2 * i : 2 * i + 2], y)
        p = 1 / (1 + np.exp(-np.clip(curve[0] + x[:, 2 * i : 2 * i + 2] @ np.array(curve[1:]), -30, 30)))
        loss = -float(np.mean(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        if best is None or loss < best[0]:
            best = loss, Model(model.scores, model.cost, model.decay, (curve[0] + math.log(share[0] / share[1]), *curve[1:]))
    return best[1]


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text. Null and empty texts have no passage and the score of such texts; very long ones are scanned whole; equal texts and
    repeated rows score alike, each row on its own; an empty table stays empty; other columns, whatever their names, are ignored."""
    a, b, c = model.curve
    x = feature_column(F.col("text"), model, docs.sparkSession)
    return docs.select(F.col("doc_id").alias("doc_id"), x.alias("x")).select("doc_id", (1 / (1 + F.exp(-(F.lit(a) + b * F.col("x.bits") + c * F.col("x.best"))))).alias("score"), "x.bits", "x.best")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "bits", "best")
