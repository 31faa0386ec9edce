"""Communities by Louvain's method: moves of single nodes, many at once, then the same on the graph of the communities.

Moves of one round must not undo each other's gain. A round goes by one of two rules, either of which makes the sum of the
gains a lower bound of what the modularity rises by:

- Every community is a sender or a receiver, by a hash of it and the round. Nodes of senders ask for the best receiver, and move
  where the gain stays above 0 even if all others that ask for that receiver came first and all others that ask to leave had left.
- Of all moves that a community takes part in, at either end, it picks the best; a move picked by both ends is made. The
  best of all is always made, so a round of this kind never stands still while any node has a move that gains.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.graph import undirected
from tessella.runtime import materialize, release

#: Gains under this (in edges) are rounding.
LEAST_GAIN = 1e-9


def _proposals(nodes: DataFrame, links: DataFrame, two_m: float, resolution: float, seed: int, by_role: int | None) -> DataFrame:
    """(node, k, c, into, gain, w, sum_c, sum_into): each node's best move that gains, its community c and the one it would join."""
    named = links.join(nodes.select(F.col("node").alias("b"), F.col("c").alias("into")), "b").groupBy("a", "into").agg(F.sum("w").alias("w"))
    own = nodes.withColumnRenamed("node", "a")
    sums = nodes.groupBy("c").agg(F.sum("k").alias("total"))
    met = named.join(own, "a")
    stay = met.where("into = c").select("a", F.col("w").alias("w_own"))
    moves = met.where("into <> c")
    if by_role is not None:
        role = lambda c: F.pmod(F.xxhash64(c, F.lit(by_role), F.lit(seed)), F.lit(2))
        moves = moves.where((role("c") == 0) & (role("into") == 1))
    full = moves.join(stay, "a", "left").join(sums.withColumnRenamed("total", "sum_c"), "c").join(sums.select(F.col("c").alias("into"), F.col("total").alias("sum_into")), "into")
    w = F.col("w") - F.coalesce("w_own", F.lit(0.0))
    gain = w - resolution * F.col("k") / two_m * (F.col("sum_into") - F.col("sum_c") + F.col("k"))
    best = F.max(F.struct(gain.alias("gain"), F.xxhash64("into", F.lit(seed)).alias("tie"), "into", "c", "k", w.alias("w"), "sum_c", "sum_into"))
    return full.groupBy("a").agg(best.alias("x")).where(F.col("x.gain") > LEAST_GAIN).select(F.col("a").alias("node"), "x.*")


def _safe(asks: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """Moves from senders to receivers that gain whatever the others do."""
    coming = asks.groupBy("into").agg(F.sum("k").alias("coming"))
    leaving = asks.groupBy("c").agg(F.sum("k").alias("leaving"))
    worst = F.col("w") - resolution * F.col("k") / two_m * (F.col("sum_into") + F.col("coming") - F.col("sum_c") + F.col("leaving") - F.col("k"))
    return asks.join(coming, "into").join(leaving, "c").where(worst > LEAST_GAIN).select("node", "into")


def _mutual(asks: DataFrame, seed: int) -> DataFrame:
    """Moves that both communities would pick of all they take part in."""
    order = F.struct("gain", F.xxhash64("node", F.lit(seed)).alias("t"), "node")
    ends = asks.select(F.explode(F.array("c", "into")).alias("end"), order.alias("o"))
    picked = ends.groupBy("end").agg(F.max("o").alias("best")).select("end", F.col("best.node").alias("picked"))
    first = asks.join(picked.select(F.col("end").alias("c"), F.col("picked").alias("p1")), "c").join(picked.select(F.col("end").alias("into"), F.col("picked").alias("p2")), "into")
    return first.where("node = p1 AND node = p2").select("node", "into")


def _settle(nodes: DataFrame, links: DataFrame, two_m: float, resolution: float, seed: int) -> tuple[DataFrame, bool]:
    """Move nodes (node, c, k) until no single move gains; and whether any was made."""
    moved, by_role = False, True
    for turn in count():
        asks = materialize(_proposals(nodes, links, two_m, resolution, seed, turn if by_role else None), "asks")
        n = asks.count()
        if n == 0 and not by_role:
            release(asks)
            return nodes, moved
        chosen = materialize(_safe(asks, two_m, resolution) if by_role else _mutual(asks, seed), "chosen")
        made = chosen.count()
        if made:
            after = materialize(nodes.join(chosen, "node", "left").select("node", F.coalesce("into", "c").alias("c"), "k"), "members")
            release(nodes)
            nodes, moved = after, True
        release(asks, chosen)
        # roles go on while they move most of those that ask, and come back where the other rule leaves many
        by_role = 4 * made >= n > 0 if by_role else n > 8 * made


def _try(links: DataFrame, start: DataFrame, two_m: float, resolution: float, seed: int, refine: bool) -> DataFrame:
    """(node, c): levels of moves and contractions until neither single nodes nor whole communities gain by a move."""
    level = materialize(start, "members")
    for turn in count():
        level, moved = _settle(level, links, two_m, resolution, seed)
        named = level
        if turn and not moved:
            return named
        up_nodes, up_links, up_moved = named, links, False
        while True:  # the graph of the communities, again and again
            left = up_links.join(up_nodes.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(up_nodes.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
            up_links = materialize(left.where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "links")
            own_groups = materialize(up_nodes.groupBy(F.col("c").alias("node")).agg(F.sum("k").alias("k")).withColumn("c", F.col("node")).select("node", "c", "k"), "members")
            up_nodes, any_ = _settle(own_groups, up_links, two_m, resolution, seed)
            if not any_:
                break
            up_moved = True
            joined = up_nodes.select(F.col("node").alias("old"), F.col("c").alias("new"))
            named = materialize(named.join(joined, F.col("c") == F.col("old")).select("node", F.col("new").alias("c"), "k"), "members")
        if not up_moved or not refine:
            return named
        level = named  # single nodes may gain again


def _modularity(links: DataFrame, named: DataFrame, two_m: float, resolution: float) -> float:
    inside = links.join(named.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    inner = inside.where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = named.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inner / two_m - resolution * squares / two_m**2


def louvain_communities(edges: DataFrame, resolution: float = 1.0, tries: int = 1, start: DataFrame | None = None, refine: bool = False) -> DataFrame:
    """(node, community) of the edges (src, dst, and weight where there is one), undirected; community is the smallest node of each.

    Every end of an edge is in one community; loops and repeats are ignored, repeats with weights add up. Each try breaks ties
    in its own way; the one of the highest modularity is taken. ``start`` (node, community) begins one more try, whose result is
    never worse than it. ``refine`` goes back to single nodes after the last level, and through the levels again, until no node gains by
    a move; without it that holds of the communities of the last level.
    """
    if "weight" in edges.columns:
        e = edges.where("src <> dst AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("w"))
        both = e.unionAll(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    else:
        both = undirected(edges).withColumn("w", F.lit(1.0))
    links = materialize(both.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), "links")
    two_m = links.agg(F.sum("w")).first()[0] or 0.0
    degrees = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    if not two_m:
        return degrees.select("node", F.col("node").alias("community"))
    starts = [(degrees.select("node", F.col("node").alias("c"), "k"), seed) for seed in range(tries)]
    if start is not None:
        starts.append((degrees.join(start, "node", "left").select("node", F.coalesce("community", "node").alias("c"), "k"), tries))
    best, named = None, None
    for first, seed in starts:
        found = _try(links, first, two_m, resolution, seed, refine)
        value = _modularity(links, found, two_m, resolution) if len(starts) > 1 else 0.0
        if best is None or value > best:
            best, named = value, found
    least = named.groupBy("c").agg(F.min("node").alias("community"))
    return named.join(least, "c").select("node", "community")
