"""Searches over graphs, hypergraphs and layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.blocks import best_rows
from tessella.operators.graph import same_keywords
from tessella.operators.relational import first_claim, top_per_key
from tessella.operators.retrieval import unit_rows
from tessella.runtime import materialize

EDGE_WEIGHTS = {"semantic_cluster": 1.2, "reference": 1.1, "REFERENCES": 1.3}


def _grown_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, cutoff: int, between: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Simple directed paths of 1 to ``cutoff`` edges from ``starts`` (start) to ``ends`` (end), of which ``between`` keeps those that are asked for.

    Edges are (src, dst, weight, edge_type). Paths grow from the starts and are kept where they come to an end; the last
    edge only joins where it comes to an end, so the widest round is not written.
    """
    e = materialize(edges.select("src", "dst", "weight", (F.col("edge_type") == "REFERENCES").cast("int").alias("ref")).distinct(), "edges")
    grown = starts.select("start").distinct().select("start", F.array("start").alias("path"), F.lit(0.0).alias("weight"), F.lit(0).alias("references"))
    into_ends = e.join(ends.select(F.col("end").alias("dst")).distinct(), "dst", "left_semi")
    found = None
    for step in range(1, cutoff + 1):
        after = lambda through, grown=grown: grown.withColumn("src", F.element_at("path", -1)).join(through, "src").where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path"), (grown.weight + through.weight).alias("weight"), (F.col("references") + F.col("ref")).alias("references"))
        ended = between(after(into_ends).withColumn("end", F.element_at("path", -1)))
        found = ended if found is None else found.unionByName(ended)
        if step < cutoff:
            grown = materialize(after(e), "paths")
    return found.select("start", "end", "path", "weight", "references")


def paths_between(edges: DataFrame, pairs: DataFrame, cutoff: int = 4) -> DataFrame:
    """(start, end, path, weight, references): simple directed paths of 1 to ``cutoff`` edges between the pairs of nodes."""
    wanted = materialize(pairs.select("start", "end").where("start <> end").distinct(), "pairs")
    return _grown_paths(edges, wanted, wanted, cutoff, lambda paths: paths.join(wanted, ["start", "end"], "left_semi"))


def paths_within(edges: DataFrame, starts: DataFrame, ends: DataFrame, cutoff: int = 4) -> DataFrame:
    """``paths_between`` all pairs of a start (start, group) and an end (end, group) of one group; the pairs themselves are never made."""
    a = materialize(starts.where("start IS NOT NULL").groupBy("start").agg(F.collect_set("group").alias("from")), "starts")
    b = materialize(ends.where("end IS NOT NULL").groupBy("end").agg(F.collect_set("group").alias("to")), "ends")
    return _grown_paths(edges, a, b, cutoff, lambda paths: paths.join(a, "start").join(b, "end").where(F.arrays_overlap("from", "to")))


def path_scores(paths: DataFrame) -> DataFrame:
    """Paths with the sum of their weights over their number of nodes as score."""
    return paths.withColumn("score", F.col("weight") / F.size("path"))


def scored_paths(edges: DataFrame, pairs: DataFrame, cutoff: int = 4) -> DataFrame:
    """Paths between pairs, with their scores."""
    return path_scores(paths_between(edges, pairs, cutoff))


def path_search(edges: DataFrame, nodes: DataFrame, keywords: DataFrame, starts: int = 10, cutoff: int = 3) -> DataFrame:
    """(query_id, path, references, score) of paths between a query's first ``starts`` keyword nodes, in node order, one for each set of nodes.

    Nodes are (node, terms), keywords (query_id, keyword). Score: the keywords on the path over half its nodes, with a
    fifth more for each REFERENCES edge. A query's first nodes are among the first of each of its keywords, so only these meet it, and
    queries of the same keywords are answered as one.
    """
    like, questions = same_keywords(keywords)
    held = nodes.select("node", F.explode(F.array_distinct("terms")).alias("keyword"))
    held = materialize(held.join(questions.select("keyword").distinct(), "keyword", "left_semi").distinct(), "held")
    first = top_per_key(held, ["keyword"], [F.col("node")], starts).drop("rank")
    hits = questions.join(first, "keyword").select("like", "node").distinct()
    chosen = materialize(top_per_key(hits, ["like"], [F.col("node")], starts), "starts")
    ends = chosen.select("like", F.col("node").alias("end"), F.col("rank").alias("r2"))
    pairs = materialize(chosen.withColumnRenamed("node", "start").join(ends, "like").where("rank < r2").select("like", "start", "end"), "pairs")  # at most 45 a question
    paths = paths_between(edges, pairs, cutoff).join(pairs, ["start", "end"])
    once = paths.withColumn("nodes", F.array_sort("path")).withColumn("_r", F.row_number().over(W.partitionBy("like", "nodes").orderBy(F.desc("references"), "path"))).where("_r = 1")
    on_path = once.select("like", "path", "references", F.size("path").alias("length"), F.explode("path").alias("node")).join(held, "node").join(questions, ["like", "keyword"])
    matched = materialize(on_path.groupBy("like", "path", "references", "length").agg(F.countDistinct("keyword").alias("matches")), "matched")
    return like.join(matched, "like").select("query_id", "path", "references", (F.col("matches") / (0.5 * F.col("length")) * (1 + 0.2 * F.col("references"))).alias("score"))


def claimed_weights(members: DataFrame) -> DataFrame:
    """(node_id, edge_id, weight): each node with the first hyperedge that holds it and the weight of its type."""
    known = F.create_map(*(x for k, v in EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    first = first_claim(members.select("edge_id", "edge_type", "node_id"), "node_id", ["edge_id"])
    return first.select("node_id", "edge_id", F.coalesce(F.try_element_at(known, F.col("edge_type")), F.lit(1.0)).alias("weight"))


def _node_scores(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """(0.7 cosine + 0.3 keyword share) * weight; a missing vector counts 0. Blocks are (id, vector, terms[, weight])."""
    width = max((n for c in (queries, rows) for n in c.column(1).combine_chunks().value_lengths().fill_null(0).to_pylist()), default=0)
    cos = np.nan_to_num(unit_rows(queries.column(1), width) @ unit_rows(rows.column(1), width).T)
    asked: dict[str, list[int]] = {}
    sizes = np.ones(queries.num_rows)
    for i, words in enumerate(queries.column(2).to_pylist()):
        sizes[i] = max(1, len(words or []))
        for w in words or []:
            asked.setdefault(w, []).append(i)
    askers = {w: np.array(x) for w, x in asked.items()}
    share = np.zeros(cos.T.shape)  # by rows, so that a row's counts lie together
    for own, words in zip(share, rows.column(2).to_pylist(), strict=True):
        for w in words or []:
            if w in askers:
                own[askers[w]] += 1
    s = (0.7 * cos + 0.3 * share.T / sizes[:, None]) * rows.column(3).to_numpy()[None, :]
    s[(np.round(s, 6) <= 0) | (queries.column(0).to_numpy()[:, None] == rows.column(0).to_numpy()[None, :])] = -np.inf
    return s


def hypergraph_search(queries: DataFrame, nodes: DataFrame, members: DataFrame, top_k: int = 5) -> DataFrame:
    """(query_id, id, score, rank) over the nodes of hyperedges: queries and nodes are (id, vector, distinct terms)."""
    weights = claimed_weights(members).select(F.col("node_id").alias("id"), "weight")
    return best_rows(queries, nodes.join(weights, "id").select(*nodes.columns, "weight"), _node_scores, top_k)


def layer_scores(nodes: DataFrame, keywords: list[str], hierarchy: str, attributes: list[str], ranks: DataFrame) -> DataFrame:
    """(layer, node_id, score) for one query: keyword share, depth of a matching path, rank by references, matching attributes.

    ``nodes`` have node_id and terms; ``ranks`` (node, rank) is a personalised rank from the matching nodes.
    """
    words = F.array(*map(F.lit, keywords))
    holds = lambda c: F.exists(words, lambda w: F.contains(F.lower(c), w))
    share = F.size(F.array_intersect(F.array_distinct("terms"), words)) / max(1, len(keywords))
    depth = F.when(holds(F.col(hierarchy)), 1 / (F.size(F.split(hierarchy, " > ")) + 1.0)).otherwise(0.0)
    count: Column = sum((holds(F.col(a)).cast("int") for a in attributes), F.lit(0))
    layers = F.array(*(F.struct(F.lit(name).alias("layer"), c.cast("double").alias("score")) for name, c in (("content", share), ("structure", depth), ("metadata", count))))
    rows = nodes.select("node_id", F.explode(layers).alias("x")).select("x.layer", "node_id", "x.score").where("score > 0")
    return rows.unionByName(ranks.select(F.lit("reference").alias("layer"), F.col("node").alias("node_id"), F.col("rank").alias("score")))


def schema_violations(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: dict[str, tuple[str, str]]) -> DataFrame:
    """(problem, n): nodes and edges of unknown types, edges with a missing end, and edges between the wrong types of nodes."""
    kinds = nodes.select("node", "node_type")
    met = edges.join(kinds.select(F.col("node").alias("src"), F.col("node_type").alias("a")), "src", "left").join(kinds.select(F.col("node").alias("dst"), F.col("node_type").alias("b")), "dst", "left")
    known = F.create_map(*(x for k, (a, b) in edge_types.items() for x in (F.lit(k), F.lit(f"{a}>{b}"))))
    wants = F.try_element_at(known, F.col("edge_type"))
    problem = F.when(wants.isNull(), "unknown edge type").when(F.col("a").isNull() | F.col("b").isNull(), "missing end").when(F.concat_ws(">", "a", "b") != wants, "wrong ends")
    wrong = met.select(problem.alias("problem")).unionAll(nodes.select(F.when(~F.col("node_type").isin(node_types), "unknown node type").alias("problem")))
    return wrong.where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
