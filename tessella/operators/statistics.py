"""Statistics of a run that add up over runs: counts, and sketches of what counts cannot tell.

Distinct terms are a HyperLogLog sketch, lengths a quantile sketch; either has a bounded size whatever the input, and two merge into the
sketch of both. So a base's statistics come from its runs' rows, without reading what they built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import terms

#: 2^14 registers: a relative standard error of about 1.04 / 128, under one percent. Quantiles are within about half a percent of the ranks.
HLL_BITS, KLL_K = 14, 500
HLL_ERROR, KLL_ERROR = 0.03, 0.02  # what tests hold them to: over three standard errors


def run_statistics(texts: DataFrame, run: int) -> DataFrame:
    """One row: run, documents, bytes, occurrences of terms, and the sketches of terms and lengths, from (text)."""
    each = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    lengths = each.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.kll_sketch_agg_bigint(F.length("text").cast("long"), F.lit(KLL_K)).alias("lengths"))
    words = each.select(F.explode(terms("text")).alias("term")).agg(F.count("*").alias("occurrences"), F.hll_sketch_agg("term", F.lit(HLL_BITS)).alias("terms"))
    return lengths.crossJoin(words).select(F.lit(run).cast("long").alias("run"), "documents", "bytes", "occurrences", "terms", "lengths")  # a row by a row


def merged_statistics(runs: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row over all runs: documents, bytes, occurrences, distinct terms by estimate, and quantiles of lengths."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "bytes", "occurrences")]
    filled = F.when(F.col("documents") > 0, F.col("lengths"))
    whole = runs.agg(F.count("*").alias("runs"), *sums, F.hll_union_agg("terms").alias("t"), F.kll_merge_agg_bigint(filled).alias("l"))
    at = F.when(F.col("documents") > 0, F.kll_sketch_get_quantile_bigint("l", F.array(*map(F.lit, quantiles))))
    return whole.select("runs", "documents", "bytes", "occurrences", F.hll_sketch_estimate("t").alias("distinct_terms"), at.alias("length_quantiles"))
