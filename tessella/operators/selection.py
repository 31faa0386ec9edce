"""Choosing among candidates, and scoring sets of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import characters, jaccard
from tessella.functions.vectors import cosine

def candidate_sets(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, texts, sets): the answers to each prompt, in order, and their sets of characters; a prompt has a few answers."""
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("x"))
    return gathered.select(*keys, F.transform("x", lambda s: s[text]).alias("texts"), F.transform("x", lambda s: characters(s[text])).alias("sets"))


def mean_likeness(sets: Column) -> Column:
    """For each answer the mean Jaccard of its characters with the other answers'; 0 for an only one."""
    others = lambda a, i: F.filter(F.transform(sets, lambda b, j: F.when(i != j, jaccard(a, b))), lambda v: v.isNotNull())
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).otherwise(0.0)
    return F.transform(sets, lambda a, i: mean(others(a, i)))


def consistency(means: Column) -> Column:
    """Mean Jaccard over all pairs of answers, from the means of each answer; 1 for an only one."""
    return F.when(F.size(means) > 1, F.aggregate(means, F.lit(0.0), lambda s, x: s + x) / F.size(means)).otherwise(F.lit(1.0))


def most_like_the_rest(means: Column) -> Column:
    """Place of the answer with the highest mean, the first on a tie."""
    return F.array_position(F.transform(means, lambda x: F.round(x, 9)), F.array_max(F.transform(means, lambda x: F.round(x, 9)))).cast("int")


def majority(rows: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """(keys, answer, votes, answers): the commonest answer, the smallest on a tie, and all answers in order."""
    votes = rows.groupBy(*keys, answer).agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct(F.col(answer).alias("answer"), "votes"), F.struct((-F.col("votes")).alias("v"), F.col(answer)))
    return votes.groupBy(*keys).agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set(answer)), " | ").alias("answers")).select(*keys, "b.answer", "b.votes", "answers")


def vector_set_score(reference: Column, generated: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays of vectors: means of the largest cosines by row and by column."""
    best = lambda a, b: F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: cosine(x, y))))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    p, r = mean(best(generated, reference)), mean(best(reference, generated))
    return {"p": p, "r": r, "f": 2 * p * r / (p + r + 1e-8)}


def dependency_context(nodes: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes (plan_id, node) with the results of the nodes that they wait for, in order; an empty array for none."""
    met = edges.join(results.select("plan_id", F.col("node").alias("src"), "result"), ["plan_id", "src"])
    gathered = met.groupBy("plan_id", F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct("src", "result"))).alias("context"))
    return nodes.join(gathered, ["plan_id", "node"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<struct<src: int, result: string>>")))


def relevance(rows: DataFrame, keys: list[str], rank: str, relevant: str) -> DataFrame:
    """(keys, retrieved, hits, precision, recall, mrr) from retrieved rows (rank not null) and relevant ones (a boolean)."""
    hit = F.col(relevant) & F.col(rank).isNotNull()
    counts = rows.groupBy(*keys).agg(F.count(rank).alias("retrieved"), F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(F.col(relevant), 1)).alias("n_relevant"), F.min(F.when(hit, F.col(rank))).alias("first"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select(*keys, "retrieved", "hits", ratio("hits", "retrieved").alias("precision"), ratio("hits", "n_relevant").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))
