"""Text and ranking metrics, one row a pair or a query."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import ngrams


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def held_by(items: pa.Array, other: pa.Array) -> pa.Array:
    """For each item of an array whether another array has it, with one set lookup an item."""
    return pa.array([[x in own for x in a] if (own := set(b or ())) or a else [] for a, b in zip((x or [] for x in items.to_pylist()), other.to_pylist(), strict=True)], type=pa.list_(pa.bool_()))


def bleu_unclipped(generated: Column, reference: Column, n: int = 4) -> Column:
    """Geometric mean of the shares of generated n-grams that the reference has anywhere, with the brevity penalty; arrays of tokens in."""

    def share(k: int) -> Column:
        g, r = ngrams(generated, k), ngrams(reference, k)
        return F.when(F.size(g) > 0, F.size(F.filter(held_by(g, r), lambda x: x)) / F.size(g)).otherwise(F.lit(0.0))

    shares = [share(k) for k in range(1, n + 1)]
    brevity = F.when(F.size(generated) < F.size(reference), F.exp(1 - F.size(reference) / F.size(generated))).otherwise(F.lit(1.0))
    logs = sum((F.log(F.when(s > 0, s)) for s in shares), F.lit(0.0)) / n
    return F.coalesce(brevity * F.exp(logs), F.lit(0.0))


def rouge_n(generated: Column, reference: Column, n: int = 1) -> dict[str, Column]:
    """Precision, recall and F of distinct n-grams."""
    g, r = F.array_distinct(ngrams(generated, n)), F.array_distinct(ngrams(reference, n))
    both = F.size(F.array_intersect(g, r))
    p = F.when(F.size(g) > 0, both / F.size(g)).otherwise(F.lit(0.0))
    q = F.when(F.size(r) > 0, both / F.size(r)).otherwise(F.lit(0.0))
    return {"p": p, "r": q, "f": F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(F.lit(0.0))}


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one whole number."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.StructType([T.StructField("lcs", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in "prf")]))
def rouge_l(generated: pa.Array, reference: pa.Array) -> pa.Array:
    """Longest common subsequence of two token arrays, its share of each, and their F1."""
    out = []
    for g, r in zip(generated.to_pylist(), reference.to_pylist(), strict=True):
        n = lcs(g or [], r or [])
        p, q = n / len(g) if g else 0.0, n / len(r) if r else 0.0
        out.append({"lcs": n, "p": p, "r": q, "f": 2 * p * q / (p + q) if p + q > 0 else 0.0})
    return pa.array(out, type=pa.struct([("lcs", pa.int64()), *((c, pa.float64()) for c in "prf")]))


def meteor(generated: Column, reference: Column) -> Column:
    """Set matches over token counts, with the penalty for runs of matched tokens."""
    m = F.size(F.array_intersect(generated, reference))
    p, r = m / F.size(generated), m / F.size(reference)
    hit = F.array_join(F.transform(held_by(generated, reference), lambda h: F.when(h, "x").otherwise("-")), "")
    runs = F.regexp_count(hit, F.lit("x+"))
    f = 2 * p * r / (p + r)
    return F.when(m > 0, f * (1 - 0.5 * F.pow(runs / m, 3))).otherwise(F.lit(0.0))


def ranking_metrics(ranked: DataFrame, keys: list[str], position: str, relevance: str, depth: int = 10) -> DataFrame:
    """ndcg at ``depth`` (ideal order of the retrieved rows alone) and average precision of each key."""
    by = W.partitionBy(*keys)
    placed = ranked.withColumns({
        "_i": F.row_number().over(by.orderBy(position)),
        "_j": F.row_number().over(by.orderBy(F.desc(relevance), position)),
        "_hits": F.sum((F.col(relevance) > 0).cast("int")).over(by.orderBy(position).rowsBetween(W.unboundedPreceding, 0)),
    })
    gain = lambda at: F.sum(F.when(F.col(at) <= depth, (F.pow(2.0, F.col(relevance)) - 1) / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    precision = F.avg(F.when(F.col(relevance) > 0, F.col("_hits") / F.col("_i")))
    out = placed.groupBy(*keys).agg(gain("_i").alias("dcg"), gain("_j").alias("idcg"), F.coalesce(precision, F.lit(0.0)).alias("average_precision"))
    return out.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)))


def perplexity(log_probability: Column) -> Column:
    return F.exp(-F.avg(log_probability))
