"""Property graphs as node and edge tables: building, paths, centrality and communities.

Edges are (src, dst) rows. Iterative operators write each round to the shared folder and keep only counters on the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.operators.relational import top_per_key
from tessella.runtime import materialize, release


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once in either direction, without loops and repeats."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): centrality is the degree over the number of other nodes."""
    d = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    n = d.count()
    return d.withColumn("centrality", F.col("degree") / F.lit(max(n - 1, 1)))


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering). Edges run from the lower to the higher degree, so no node opens many wedges."""
    both = materialize(undirected(edges), "undirected")
    degree = materialize(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "degree")
    rank = F.struct("degree", "node")
    ends = both.join(degree.select(F.col("node").alias("src"), rank.alias("a")), "src").join(degree.select(F.col("node").alias("dst"), rank.alias("b")), "dst")
    up = materialize(ends.where("a < b").select("src", "dst", "b"), "oriented")
    one, two = up.select("src", F.col("dst").alias("x"), F.col("b").alias("bx")), up.select("src", F.col("dst").alias("y"), F.col("b").alias("by"))
    wedges = one.join(two, "src").where("bx < by").select("src", "x", "y")
    closed = wedges.join(up.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"])
    per_node = closed.select(F.explode(F.array("src", "x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    counted = degree.join(per_node, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return counted.withColumn("clustering", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(F.lit(0.0)))


def pagerank(edges: DataFrame, restart: DataFrame | None = None, damping: float = 0.85, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """(node, rank) after a fixed number of rounds; ``restart`` (node, weight) makes it personalised. Dangling rank restarts.

    With a ``tolerance`` rounds go on until ranks change by less than that a node on average; if ``rounds`` do not suffice it is an error.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    out = materialize(e.groupBy("src").agg(F.count("*").alias("out")), "out")
    nodes = materialize(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    n = nodes.count()
    if restart is None:
        start = nodes.withColumn("base", F.lit(1.0 / max(n, 1)))
    else:
        total = restart.agg(F.sum("weight")).first()[0] or 1.0
        start = nodes.join(restart, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / total).alias("base"))
    state = materialize(start.withColumn("rank", F.col("base")), "rank")
    for _ in range(rounds):
        dangling = state.join(out, F.col("node") == F.col("src"), "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        sent = e.join(out, "src").join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        flow = damping * (F.coalesce("got", F.lit(0.0)) + dangling * F.col("base"))
        after = state.join(sent, F.col("node") == F.col("dst"), "left").select("node", "base", ((1 - damping) * F.col("base") + flow).alias("rank"), F.col("rank").alias("before"))
        past, state = state, materialize(after, "rank")
        release(past)
        if tolerance is not None and (state.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) < n * tolerance:
            return state.select("node", "rank")
    if tolerance is not None and n:
        raise RuntimeError(f"ranks have not settled in {rounds} rounds")
    return state.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): each round a node takes its neighbours' commonest label, the smallest on a tie."""
    both = materialize(undirected(edges), "undirected")
    state = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("label")).alias("smallest"))).alias("m"))
        past, state = state, materialize(best.select("node", (-F.col("m.smallest")).alias("label")), "labels")
        release(past)
    return state


def settled_labels(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, label) by label propagation to its end: every node has a label that no other label beats among its neighbours.

    In a round a half of the nodes, drawn anew, take their neighbours' commonest label, the smallest on a tie, but only where it beats
    their own. So neighbours seldom change at once, and labels do not swing. Over ``limit`` rounds it is an error, not a result.
    """
    both = materialize(undirected(edges), "undirected")
    state = materialize(both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for turn in range(limit):
        votes = both.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("votes"))
        best = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("label")).alias("smallest"))).alias("m"))
        own = state.join(votes, ["node", "label"], "left").select("node", "label", F.coalesce("votes", F.lit(0)).alias("own"))
        wishes = materialize(own.join(best, "node").where("m.votes > own").select("node", (-F.col("m.smallest")).alias("wish")), "wishes")
        if wishes.isEmpty():
            return state
        drawn = wishes.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        past, state = state, materialize(state.join(drawn, "node", "left").select("node", F.coalesce("wish", "label").alias("label")), "labels")
        release(past, wishes)
    raise RuntimeError(f"labels have not settled in {limit} rounds")


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, distance) by breadth-first rounds along directed edges, until nothing new is reached or for ``most`` steps."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    seen = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance")).distinct(), "reached")
    frontier = seen
    for step in count(1) if most is None else range(1, most + 1):
        found = frontier.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        frontier = materialize(found.join(seen, ["source", "node"], "left_anti").withColumn("distance", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier), "reached")
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, cutoff: int = 3) -> DataFrame:
    """All paths without a repeated node, of 1 to ``cutoff`` directed edges, from the start nodes; path is an array."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    paths = starts.select(F.array("node").alias("path"))
    found = None
    for _ in range(cutoff):
        grown = paths.withColumn("at", F.element_at("path", -1)).join(e, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = materialize(grown.select(F.concat("path", F.array("dst")).alias("path")), "paths")
        found = paths if found is None else found.unionAll(paths)
    return found


def sampled_pivots(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node): up to ``most`` nodes drawn by a hash, all of a smaller graph."""
    return undirected(edges).select(F.col("src").alias("node")).distinct().orderBy(F.xxhash64("node"), "node").limit(most)


def betweenness(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """(node, betweenness) summed over all shortest paths from the pivots: path counts outwards, then dependencies back, by rounds."""
    e = materialize(undirected(edges), "undirected")
    level = materialize(pivots.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("s", "node")
    while True:
        grown = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = materialize(grown.join(seen, ["s", "node"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "node"))
    depends = levels[-1].select("s", "node", "paths", F.lit(0.0).alias("d"))
    total = depends
    for level in reversed(levels[:-1]):
        back = depends.join(e, F.col("node") == F.col("src")).select("s", F.col("dst").alias("node"), ((1 + F.col("d")) / F.col("paths")).alias("share"))
        got = level.join(back, ["s", "node"], "left").groupBy("s", "node", "paths").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("shares"))
        depends = materialize(got.select("s", "node", "paths", (F.col("paths") * F.col("shares")).alias("d")), "depends")
        total = total.unionByName(depends)
    return total.where("s <> node").groupBy("node").agg(F.sum("d").alias("betweenness"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, inner, degree, part): part is inner / m - (degree / 2m)^2; the parts add up to the modularity."""
    both = materialize(undirected(edges), "undirected")
    m = both.count() / 2
    named = both.join(communities.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").join(communities.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst")
    sums = named.groupBy(F.col("c1").alias("community")).agg(F.sum(F.when(F.col("c1") == F.col("c2"), 0.5).otherwise(0.0)).alias("inner"), F.count("*").alias("degree"))
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(sums, "community").withColumn("part", F.col("inner") / m - F.pow(F.col("degree") / (2 * m), 2))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ends = nodes.select("node")
    return edges.join(ends, F.col("src") == F.col("node"), "left_semi").join(ends, F.col("dst") == F.col("node"), "left_semi")


def containment(rows: DataFrame, path: list[str]) -> DataFrame:
    """(src, dst, ord) CONTAINS edges along the columns of ``path``, each once; ord is the child's place under its parent."""
    parts = None
    for a, b in zip(path, path[1:], strict=False):
        part = rows.select(F.concat_ws(":", F.lit(a), a).alias("src"), F.concat_ws(":", F.lit(b), b).alias("dst")).distinct()
        parts = part if parts is None else parts.unionAll(part)
    return parts.withColumn("ord", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)


def resolve_references(references: DataFrame, chunks: DataFrame, top: int = 3) -> DataFrame:
    """Best chunks for each reference text: 10 if its words are in the content, 5 in the document name, 3 in the hierarchy.

    Content candidates meet on the reference's rarest word, so a reference is compared with chunks that may hold it only.
    """
    word = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    refs = references.where(F.length(F.trim("reference")) >= 3).select("ref_id", F.lower("reference").alias("reference"), word(F.col("reference")).alias("words"))
    asked = refs.select("ref_id", F.explode("words").alias("word"))
    kept = asked.select("word").distinct()
    held = chunks.select("chunk_id", F.explode(word(F.concat_ws(" ", "content", "document_name", "hierarchy"))).alias("word")).join(kept, "word", "left_semi")
    held = materialize(held, "held")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    rare = top_per_key(asked.join(counts, "word"), ["ref_id"], [F.col("n"), F.col("word")], 1).select("ref_id", "word")
    pairs = rare.join(held, "word").select("ref_id", "chunk_id").join(refs.select("ref_id", "reference"), "ref_id").join(chunks, "chunk_id")
    inside = lambda c, points: F.when(F.contains(F.lower(c), F.col("reference")), points).otherwise(0)
    scored = pairs.withColumn("score", inside(F.col("content"), 10) + inside(F.col("document_name"), 5) + inside(F.col("hierarchy"), 3)).where("score > 0")
    return top_per_key(scored.select("ref_id", "chunk_id", "score"), ["ref_id"], [F.desc("score"), F.col("chunk_id")], top)


def structural_search(edges: DataFrame, nodes: DataFrame, keywords: DataFrame, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), between: DataFrame | None = None) -> DataFrame:
    """(query_id, node, score): share of the query's keywords in a node's text, its degree centrality, and its part of the largest ``between``ness where that is given.

    Nodes are (node, terms), keywords (query_id, keyword); only nodes that hold a keyword meet a query.
    """
    asked = keywords.select("query_id", "keyword").distinct()
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n_keywords"))
    held = nodes.select("node", F.explode(F.array_distinct("terms")).alias("keyword"))
    hits = asked.join(held, "keyword").groupBy("query_id", "node").agg(F.count("*").alias("hits"))
    scored = hits.join(sizes, "query_id").join(degrees(edges), "node", "left")
    score = weights[0] * F.col("hits") / F.col("n_keywords") + weights[1] * F.coalesce("centrality", F.lit(0.0))
    if between is not None:
        b = materialize(between, "between")
        largest = b.agg(F.max("betweenness")).first()[0] or 1.0
        scored = scored.join(b, "node", "left")
        score = score + weights[2] * F.coalesce(F.col("betweenness") / (largest or 1.0), F.lit(0.0))
    return scored.select("query_id", "node", score.alias("score"))


def same_keywords(keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, like) and (like, keyword, n_keywords): queries of one set of keywords are one question, under the least of their ids."""
    asked = keywords.select("query_id", "keyword").where("query_id IS NOT NULL").distinct()
    sets = materialize(asked.groupBy("query_id").agg(F.array_sort(F.collect_set("keyword")).alias("words"), F.count("*").alias("n_keywords")), "keyword-sets")
    first = sets.groupBy("words", "n_keywords").agg(F.min("query_id").alias("like"))
    like = sets.join(first, ["words", "n_keywords"]).select("query_id", "like")
    return materialize(like, "like"), materialize(first.select("like", F.explode("words").alias("keyword"), "n_keywords"), "questions")


def best_matches(terms: DataFrame, items: DataFrame, keywords: DataFrame, score: Column, order: list[Column], top_k: int) -> DataFrame:
    """(query_id, item, columns of items, score, rank): of the items that hold a keyword of a query the ``top_k`` by ``score``, the greatest first, then by ``order``.

    ``terms`` are (item, keyword), ``keywords`` (query_id, keyword), ``items`` have what else is known of an ``item``, a row each; ``score`` is of
    ``hits``, ``n_keywords`` and these columns. What a query finds depends on its set of keywords alone, and of items that hold the same
    ones of all keywords asked for only the best can be among its best, for each number of hits. So each such class is cut to
    ``top_k`` once, before questions and classes meet, and no row is made for a query and each item that it hits.
    """
    like, questions = same_keywords(keywords)
    held = terms.select("item", "keyword").join(questions.select("keyword").distinct(), "keyword", "left_semi")
    classed = materialize(held.groupBy("item").agg(F.array_sort(F.collect_set("keyword")).alias("held")).join(items, "item", "left"), "classed")
    classes = classed.select("held").distinct()
    met = classes.select("held", F.explode("held").alias("keyword")).join(questions, "keyword").groupBy("like", "held", "n_keywords").agg(F.count("*").alias("hits"))
    met = materialize(met, "met")
    scored = classed.join(met.select("held", "hits", "n_keywords").distinct(), "held").withColumn("score", score)
    by = [F.desc("score"), *order]
    best = materialize(top_per_key(scored, ["held", "hits", "n_keywords"], by, top_k).drop("rank"), "best")
    found = top_per_key(met.join(best, ["held", "hits", "n_keywords"]).drop("held", "hits", "n_keywords"), ["like"], by, top_k)
    return like.join(found, "like").drop("like")


def _exploded(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("item"), F.explode(F.array_distinct("terms")).alias("keyword"))


def structural_best(edges: DataFrame, nodes: DataFrame, keywords: DataFrame, top_k: int, order: list[Column] | None = None, weights: tuple[float, float, float] = (0.6, 0.2, 0.2), between: DataFrame | None = None) -> DataFrame:
    """(query_id, node, score, rank): the ``top_k`` of ``structural_search`` by score in six digits, then by ``order`` (of ``item``, the node), without all the others."""
    items = degrees(edges).select(F.col("node").alias("item"), "centrality")
    score = weights[0] * F.col("hits") / F.col("n_keywords") + weights[1] * F.coalesce("centrality", F.lit(0.0))
    if between is not None:
        b = materialize(between, "between")
        largest = b.agg(F.max("betweenness")).first()[0] or 1.0
        items = items.join(b.withColumnRenamed("node", "item"), "item", "full")
        score = score + weights[2] * F.coalesce(F.col("betweenness") / (largest or 1.0), F.lit(0.0))
    found = best_matches(_exploded(nodes), items, keywords, F.round(score, 6), order or [F.col("item")], top_k)
    return found.select("query_id", F.col("item").alias("node"), "score", "rank")


def _community_factor() -> Column:
    return F.when(F.col("size") < 3, 0.5).when(F.col("size") > 50, 0.7).otherwise(1.0)


def community_search(communities: DataFrame, nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, community, size, score): share of the keywords found in a community's texts, less for very small and large ones."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    held = nodes.join(communities, "node").select("community", F.explode(F.array_distinct("terms")).alias("keyword")).distinct()
    asked = keywords.select("query_id", "keyword").distinct()
    counts = asked.groupBy("query_id").agg(F.count("*").alias("n_keywords"))
    hits = asked.join(held, "keyword").groupBy("query_id", "community").agg(F.count("*").alias("hits"))
    return hits.join(counts, "query_id").join(sizes, "community").select("query_id", "community", "size", (F.col("hits") / F.col("n_keywords") * _community_factor()).alias("score"))


def community_best(communities: DataFrame, nodes: DataFrame, keywords: DataFrame, top_k: int, order: list[Column] | None = None) -> DataFrame:
    """(query_id, community, size, score, rank): the ``top_k`` of ``community_search`` by score in six digits, then by ``order`` (of ``item``, the community)."""
    known = communities.where("community IS NOT NULL")
    sizes = known.groupBy(F.col("community").alias("item")).agg(F.count("*").alias("size"))
    held = _exploded(nodes.join(known, "node").select(F.col("community").alias("node"), "terms"))
    score = F.round(F.col("hits") / F.col("n_keywords") * _community_factor(), 6)
    found = best_matches(held, sizes, keywords, score, order or [F.col("item")], top_k)
    return found.select("query_id", F.col("item").alias("community"), "size", "score", "rank")


def descendants(edges: DataFrame, roots: DataFrame, most: int = 3) -> DataFrame:
    """(root, node, depth, path) of a tree or DAG below the roots, path as text."""
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.col("node").cast("string").alias("path"))
    found = level
    for step in range(1, most + 1):
        level = level.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(step).alias("depth"), F.concat_ws(" > ", "path", F.col("dst").cast("string")).alias("path"))
        found = found.unionAll(level)
    return found
