"""Quality rules: word and repetition counts, then robust multivariate outliers for each language and source.

The outlier test transforms a document's counts into a vector and rejects it when its Mahalanobis distance, under a
minimum-covariance-determinant estimate of its group, is too large. The estimate covers all documents of the group: each
concentration step sums over all its vectors within tasks first, so a group may hold any share of the rows. Starts come from
samples, as in the published fast algorithm; steps over all rows go on until the determinant falls no more, and the least
one is taken.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.rows import named, row_of
from tessella.runtime import materialize

SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes that continue a code point
UPPER = bytes(range(0x41, 0x5B))
PUNCTUATION = b"!\"'(),-./:;?@[\\]^_`{}~+="
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
FIELDS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
#: Smallest standard deviation of each entry of the vector: keeps the determinant from 0 where a group has no spread,
#: and a trace of an unusual character from counting as an outlier.
FLOORS = (0.5, 0.15, 0.04, 0.10, 0.12, 0.07, 0.07)
P = len(FLOORS)
#: Share of a group that the estimate rests on (the least, so up to half of a group may be junk), rows below which a group is
#: pooled, and the factor that makes the covariance of a normal group's nearest half that of the group:
#: SHARE / P(chi-square with 9 degrees of freedom < CHI2_HALF).
SHARE, LEAST, CONSISTENCY = 0.5, 60, 1.6942
#: Starts come from about so many distinct vectors a group, drawn by hash: of RANDOM_STARTS random ones, the KEPT_STARTS of
#: least determinant on the sample go on over all rows, each until the logarithm of its determinant falls by less than
#: SETTLED. The logarithm has a lower bound, by FLOORS, so every start ends.
SAMPLE, RANDOM_STARTS, KEPT_STARTS, SETTLED = 1500, 30, 2, 0.02
#: Medians and cut-off of chi-square with 7 degrees of freedom: the cut-off is exceeded by one normal vector in 1e9.
CHI2_HALF, CHI2_CUT = 6.3458, 56.1
BINS = 64  # bins of squared distance per doubling
#: Entries are whole numbers of this part, so that sums over any number of tasks are exact: up to 4e10 rows a group.
UNIT = 1024
HELD = 200_000  # sums that a task holds before it hands on what it has


def repeated_words(words: list[bytes]) -> int:
    """Words in 5-word windows that occur twice or more."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 5 - max(i, end)
            end = i + 5
    return total


def count_text(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; all are 0 for a null or blank one."""
    text = text or b""
    words = text.split()
    solid = text.translate(None, SPACE)
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (
        len(words),
        len(solid.translate(None, NOT_FIRST)),
        len(solid) - len(solid.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(solid) - len(solid.translate(None, UPPER)),
        len(solid) - len(solid.translate(None, PUNCTUATION)),
    )


@F.arrow_udf(FIELDS)
def _count_udf(text: pa.Array) -> pa.Array:
    rows = np.array([count_text(t.as_py()) for t in text], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=list(COUNTS))


def text_counts(text: Column | str) -> Column:
    return _count_udf(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def base_failed(c: str) -> Column:
    return (F.col(f"{c}.n_words") < 10) | (100 * F.col(f"{c}.n_repeat_words") > 20 * F.col(f"{c}.n_words"))


def vector(c: str) -> list[Column]:
    """Logarithms of sizes and square roots of shares, near normal for running text, in whole UNITs."""
    n = lambda k: F.col(f"{c}.{k}").cast("double")
    share = lambda a, b: F.sqrt(n(a) / F.greatest(n(b), F.lit(1.0)))
    entries = [
        F.log1p(n("n_words")),
        F.log((n("word_chars") + 1) / (n("n_words") + 1)),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "word_chars"),
        share("n_punct", "word_chars"),
    ]
    return [F.round(e * UNIT).cast("int") for e in entries]


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P + 1) for j in range(i, P + 1)]
MOMENTS = [f"s{i}_{j}" for i, j in PAIRS]  # of (1, x0, ..., x6): s0_0 counts rows
#: mean has P entries, inverse P * P, by rows.
ESTIMATE = "grp string, start int, logdet double, mean array<double>, inverse array<double>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in, one row for each group of a batch out: its vectors as 32-bit numbers."""
    for batch in batches:
        names = batch.column("grp").dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False)
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in X]).astype("<i4")
        order = np.argsort(at, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
        yield pa.RecordBatch.from_pydict({"grp": [names.dictionary[int(at[p[0]])].as_py() for p in parts], "data": [x[p].tobytes() for p in parts]}, schema=pa.schema([("grp", pa.string()), ("data", pa.binary())]))


def _distances(batch: pa.RecordBatch) -> Iterator[tuple[str, dict, np.ndarray, np.ndarray]]:
    """(grp, estimate, vectors, bins of their squared distances) of every block under every estimate of its group."""
    for grp, data, estimates in zip(*(batch.column(c).to_pylist() for c in ("grp", "data", "estimates")), strict=True):
        x = np.frombuffer(data, dtype="<i4").reshape(-1, P)
        for e in estimates:
            d = x / UNIT - np.array(e["mean"])
            d2 = np.einsum("ni,ij,nj->n", d, np.array(e["inverse"]).reshape(P, P), d)
            yield grp, e, x, np.floor(np.log2(np.maximum(d2, 1e-9)) * BINS).astype(np.int64)


def _count_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("start", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])
    sums: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*((*k, n) for k, n in sums.items()), strict=True) if sums else [[]] * 4, schema, strict=True)], schema=schema)
        sums.clear()
        return out

    for batch in batches:
        for grp, e, _, bins in _distances(batch):
            for b, n in zip(*(a.tolist() for a in np.unique(bins, return_counts=True)), strict=True):
                sums[grp, e["start"], b] += n
            if len(sums) > HELD:
                yield flush()
    yield flush()


def _sum_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("start", pa.int32()), *((m, pa.int64()) for m in MOMENTS)])
    upper = tuple(np.array(PAIRS).T)
    sums: dict[tuple[str, int], np.ndarray] = {}

    def flush():
        table = np.array(list(sums.values()), dtype=np.int64).reshape(-1, len(MOMENTS))
        keys = list(zip(*sums, strict=True)) if sums else [[], []]
        out = pa.RecordBatch.from_arrays([pa.array(keys[0], type=pa.string()), pa.array(keys[1], type=pa.int32()), *(pa.array(c) for c in table.T)], schema=schema)
        sums.clear()
        return out

    for batch in batches:
        for grp, e, x, bins in _distances(batch):
            near = x[bins <= e["cut"]].astype(np.int64)
            one = np.column_stack([np.ones(len(near), dtype=np.int64), near])
            key = grp, e["start"]
            sums[key] = sums.get(key, 0) + (one.T @ one)[upper]
            if len(sums) > HELD // 10:
                yield flush()
    yield flush()


def _estimates(moments: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a group and start of moments in, its mean, inverse covariance and determinant out."""
    for rows in moments:
        out = []
        for r in rows.to_dict("records"):
            full = np.zeros((P + 1, P + 1))
            for (i, j), m in zip(PAIRS, MOMENTS, strict=True):
                full[i, j] = full[j, i] = float(r[m]) / UNIT ** ((i > 0) + (j > 0))
            mean = full[0, 1:] / full[0, 0]
            cov = np.diag(np.square(FLOORS)) + CONSISTENCY * (full[1:, 1:] / full[0, 0] - np.outer(mean, mean))
            out.append([r["grp"], r["start"], np.linalg.slogdet(cov)[1], mean.tolist(), np.linalg.inv(cov).ravel().tolist()])
        yield pd.DataFrame(out, columns=["grp", "start", "logdet", "mean", "inverse"])


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows`` of x0..x6, mean, inverse and scale with their squared distance over the scale; null without an estimate.

    The deviations are columns of their own, and the inverse is symmetric, so that the expression stays short.
    """
    apart = rows.select("*", *((F.col(x) / UNIT - F.get("mean", F.lit(i))).alias(f"d{i}") for i, x in enumerate(X)))
    term = lambda i, j: (1 + (i < j)) * F.get("inverse", F.lit(P * i + j)) * F.col(f"d{i}") * F.col(f"d{j}")
    total = sum((term(i, j) for i in range(P) for j in range(i, P)), F.lit(0.0))
    return apart.withColumn("distance", total / F.col("scale"))


def _concentrate(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """A concentration step on a sample: (logdet, mean, inverse) of the nearest half."""
    d = x - mean
    near = x[np.argpartition(np.einsum("ni,ij,nj->n", d, inverse, d), (len(x) - 1) // 2)[: (len(x) + 1) // 2]]
    cov = CONSISTENCY * np.cov(near.T, bias=True) + np.diag(np.square(FLOORS))
    return np.linalg.slogdet(cov)[1], near.mean(0), np.linalg.inv(cov)


def _sample_estimates(rows: pd.DataFrame) -> pd.DataFrame:
    """The best estimates of one group's sample: two steps from each random start, then the best ones to their ends."""
    x = np.unique(rows[X].to_numpy(), axis=0) / UNIT
    draw, found = np.random.default_rng(0), []
    for _ in range(RANDOM_STARTS):
        own = x[draw.choice(len(x), min(len(x), P + 1), replace=False)]
        now = 0.0, own.mean(0), np.linalg.inv(np.cov(own.T, bias=True) + np.diag(np.square(FLOORS)))
        for _ in range(2):
            now = _concentrate(x, *now[1:])
        found.append(now)
    ends = []
    for now in sorted(found, key=lambda e: e[0])[: 2 * KEPT_STARTS]:
        while (after := _concentrate(x, *now[1:]))[0] < now[0] - SETTLED / 10:
            now = after
        ends.append(now)
    best = sorted(ends, key=lambda e: e[0])[:KEPT_STARTS]
    grp = rows["grp"].iloc[0]
    return pd.DataFrame([[grp, k, math.inf, mean.tolist(), inverse.ravel().tolist()] for k, (_, mean, inverse) in enumerate(best)], columns=["grp", "start", "logdet", "mean", "inverse"])


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates to start from, by group, on samples of distinct vectors, so that copies count once."""
    value = F.xxhash64(*X)
    sizes = materialize(rows.groupBy("grp").agg(F.approx_count_distinct(value).alias("size")), "sizes")
    drawn = rows.join(sizes, "grp").where(F.pmod(value, F.lit(1 << 30)) < (1 << 30) * (SAMPLE / F.col("size"))).select("grp", *X).distinct()
    return materialize(drawn.groupBy("grp").applyInPandas(_sample_estimates, ESTIMATE), "estimate")


def _per_group(estimates: DataFrame, *columns: str) -> DataFrame:
    """(grp, estimates): the few estimates of a group in one row, to meet its blocks."""
    return estimates.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("start", *columns))).alias("estimates"))


def _cuts(blocks: DataFrame, estimates: DataFrame, share: float) -> DataFrame:
    """(grp, start, cut): the bin that ends the nearest ``share`` of a group."""
    met = blocks.join(_per_group(estimates, "mean", "inverse"), "grp")
    counts = met.mapInArrow(_count_bins, "grp string, start int, bin long, n long").groupBy("grp", "start", "bin").agg(F.sum("n").alias("n"))
    own = W.partitionBy("grp", "start")  # bins, not rows
    upto = counts.select("*", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("total"))
    return upto.where(F.col("upto") >= share * F.col("total")).groupBy("grp", "start").agg(F.min("bin").alias("cut"))


def _step(blocks: DataFrame, active: DataFrame) -> DataFrame:
    """One concentration step of every start: the estimate of the nearest half under the last one, and that one's logdet as ``before``."""
    cut = materialize(active.join(_cuts(blocks, active, SHARE), ["grp", "start"]), "cut")
    met = blocks.join(_per_group(cut, "mean", "inverse", "cut"), "grp")
    sums = met.mapInArrow(_sum_moments, "grp string, start int, " + ", ".join(f"{m} long" for m in MOMENTS)).groupBy("grp", "start").agg(*(F.sum(m).alias(m) for m in MOMENTS))
    found = sums.mapInPandas(_estimates, ESTIMATE)
    return materialize(found.join(active.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"]), "estimate")


def fit_groups(rows: DataFrame) -> DataFrame:
    """(grp, mean, inverse, scale) for groups of vectors grp, x0..x6: of several starts, the one of least determinant.

    Vectors are kept as blocks, one row a task and group, so that a step moves estimates to blocks and no vectors.
    """
    blocks = materialize(rows.mapInArrow(_blocks, "grp string, data binary"), "blocks")
    active, settled = _starts(rows), []
    while not active.isEmpty():
        found = _step(blocks, active)
        falls = F.col("logdet") < F.col("before") - SETTLED
        settled.append(found.where(~falls).drop("before"))
        # starts that have met go on as one
        same = F.row_number().over(W.partitionBy("grp", F.round("logdet", 6), *(F.round(F.get("mean", F.lit(i)), 6) for i in range(P))).orderBy("start"))
        # a step names these few rows three times: written, they keep the plans small that the driver holds
        active = materialize(found.where(falls).drop("before").withColumn("same", same).where("same = 1").drop("same"), "active")
    ends = reduce(DataFrame.unionByName, settled, active)  # active is empty
    best = ends.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inverse"), F.struct("logdet", "start")).alias("e"))
    estimate = materialize(best.select("grp", "e.*"), "estimate")
    middle = F.pow(2.0, (F.col("cut") + 0.5) / BINS)
    return materialize(estimate.join(_cuts(blocks, estimate, 0.5), ["grp", "start"]).select("grp", "mean", "inverse", F.greatest(middle / CHI2_HALF, F.lit(1.0)).alias("scale")), "fit")


def group_names(counted: DataFrame) -> DataFrame:
    """(lang, source, grp): the two where they have LEAST rows that pass the base rules, else pooled by language, else all pooled.

    A pool below LEAST rows has a null grp: its rows are left to the base rules. Nulls are values of their own.
    """
    sizes = counted.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    name = lambda *c: F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), x), F.lit("")) for x in c)))
    small = sizes.where(F.col("n") < LEAST)
    pools = small.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < LEAST).agg(F.sum("pool")).first()[0] or 0
    own = F.when(F.col("n") >= LEAST, name("lang", "source")).when(F.col("pool") >= LEAST, name("lang"))
    if rest >= LEAST:
        own = own.otherwise(F.lit("all"))
    return sizes.join(pools, F.col("lang").eqNullSafe(F.col("l")), "left").select("lang", "source", own.alias("grp"))


def judge(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the named columns, all by default), counts (a struct of COUNTS), base_failed, kept and distance.

    Null and blank texts have no words and fail; very long texts are counted whole; ties and repeated rows are judged
    alike; null languages and sources are values of their own; an empty table stays empty. The input's columns stay
    inside ``row``, so none of their names can clash. The counts and the vector of each text are made once, in a written
    table that the later passes read by column.
    """
    counts = docs.select(row_of(docs, columns), named("lang").alias("lang"), named("source").alias("source"), text_counts("text").alias("counts"))
    counted = materialize(counts.select("*", base_failed("counts").alias("base_failed"), *(x.alias(n) for n, x in zip(X, vector("counts"), strict=True))), "counted")
    names = materialize(group_names(counted.select("lang", "source", "base_failed")), "groups").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "grp")
    grouped = counted.join(names, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    fit = fit_groups(grouped.where(~F.col("base_failed") & F.col("grp").isNotNull()).select("grp", *X))
    fine = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CHI2_CUT)
    return with_distance(grouped.join(fit, "grp", "left")).select("row", "counts", "base_failed", fine.alias("kept"), "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the outlier test."""
    return judge(docs).where("kept").select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return judged.select("row.doc_id", *(F.col(f"counts.{c}").alias(c) for c in COUNTS[:5]), "base_failed", "kept")
