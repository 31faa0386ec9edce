"""Groups of nodes by modularity, chains of references, and measures of given groups of vectors and texts."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import dot, unit
from tessella.operators.graph import undirected
from tessella.operators.relational import top_per_key
from tessella.runtime import materialize


def greedy_communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community): groups merge while a merge raises the modularity; community is a group's smallest node.

    In each round every group asks for its best neighbour. Two that ask for each other make a centre, and all that ask
    for a centre join it where the gain stays above 0 even if all the others join too; the best of them always may. So each
    round raises the modularity, many merges happen at once, and it ends when no merge of two groups is a gain. Ties go by
    a hash of the pair and the round, so that chains of equal gains do not wait for each other.
    """
    both = materialize(undirected(edges), "undirected")
    two_m = both.count()  # read from the files' footers
    named = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    links = materialize(both.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("w")), "links")
    sizes = materialize(both.groupBy(F.col("src").alias("a")).agg(F.count("*").alias("d")), "degrees")
    moves = []
    for step in count():
        gain = (F.col("w") - resolution * F.col("da") * F.col("db") / two_m).alias("gain")
        ends = links.join(sizes.select("a", F.col("d").alias("da")), "a").join(sizes.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
        low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
        wish = F.max(F.struct(gain, F.xxhash64(F.least("a", "b"), F.greatest("a", "b"), F.lit(step)).alias("tie"), low, high, "b", "w", "da", "db"))
        asks = materialize(ends.groupBy("a").agg(wish.alias("best")).where("best.gain > 0").select("a", "best.*"), "asks")
        if asks.isEmpty():
            break
        centres = asks.select(F.col("a").alias("c"), F.col("b").alias("partner")).join(asks.select("a", F.col("b").alias("back")), F.col("partner") == F.col("a")).where("c = back AND c < partner").select("c")
        joiners = materialize(asks.join(centres, F.col("b") == F.col("c"), "left_semi"), "joiners")
        all_ = joiners.groupBy("b").agg(F.sum("da").alias("asked"), F.max(F.struct("gain", "tie", "a")).alias("first"))
        safe = F.col("w") - resolution * F.col("da") * (F.col("db") + F.col("asked") - F.col("da")) / two_m > 0
        merged = materialize(joiners.join(all_, "b").where(safe | (F.col("a") == F.col("first.a"))).select("a", F.col("b").alias("into")), "merged")
        moves.append(merged)
        new = lambda c: F.coalesce("into", c)
        sizes = materialize(sizes.join(merged, "a", "left").groupBy(new("a").alias("a")).agg(F.sum("d").alias("d")), "degrees")
        half = links.join(merged, "a", "left").select(new("a").alias("a"), "b", "w")
        moved = half.join(merged.select(F.col("a").alias("b"), "into"), "b", "left").select("a", new("b").alias("b"), "w")
        links = materialize(moved.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    for merged in moves:
        named = named.join(merged, F.col("community") == F.col("a"), "left").select("node", F.coalesce("into", "community").alias("community"))
    named = materialize(named, "named")
    least = named.groupBy("community").agg(F.min("node").alias("least"))
    return named.join(least, "community").select("node", F.col("least").alias("community"))


def reference_chains(rows: DataFrame) -> DataFrame:
    """(reference, chain, size): rows that lead on from each other, as a walk from each row in order would gather them.

    Rows are (ord, reference, reference_additional), the last a comma-separated list of references. A row belongs to the
    first row from which it can be reached; chain is that row's ord. Chains of one are left out, as are unknown references;
    of rows that repeat a reference the first counts. Each round only rows with a new chain pass it on.
    """
    nodes = rows.where("reference IS NOT NULL").groupBy("reference").agg(F.min_by(F.struct("ord", "reference_additional"), F.col("ord")).alias("r"))
    nodes = materialize(nodes.select("reference", "r.*"), "references")
    asked = nodes.select(F.col("ord").alias("src"), F.explode(F.split("reference_additional", ",")).alias("r")).select("src", F.trim("r").alias("reference"))
    edges = materialize(asked.join(nodes.select("reference", F.col("ord").alias("dst")), "reference").where("src <> dst").select("src", "dst").distinct(), "leads")
    state = materialize(nodes.select(F.col("ord").alias("node"), F.col("ord").alias("chain")), "chains")
    fresh = state
    while True:
        offers = fresh.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("chain").alias("offer"))
        fresh = materialize(offers.join(state, F.col("dst") == F.col("node")).where("offer < chain").select("node", F.col("offer").alias("chain")), "fresh")
        if fresh.isEmpty():
            break
        state = materialize(state.join(fresh.withColumnRenamed("chain", "new"), "node", "left").select("node", F.coalesce("new", "chain").alias("chain")), "chains")
    sizes = state.groupBy("chain").agg(F.count("*").alias("size")).where("size > 1")
    return nodes.select("reference", F.col("ord").alias("node")).join(state, "node").join(sizes, "chain").select("reference", "chain", "size")


def topic_vectors(vectors: DataFrame) -> DataFrame:
    """(id, topic, membership, size, coherence) from (id, topic, vector): cosine to the topic's centroid, and the mean cosine of its pairs.

    The mean over pairs follows from the length of the sum of unit vectors, so no pairs are formed; it is null for a topic
    of one. Vectors without length are left out.
    """
    units = materialize(vectors.select("id", "topic", unit("vector").alias("u")).where("u IS NOT NULL"), "units")
    sums = units.select("topic", F.posexplode("u").alias("at", "x")).groupBy("topic", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("s"))  # one entry a dimension
    n = units.groupBy("topic").agg(F.count("*").alias("size"))
    length = dot("s", "s")
    topics = whole.join(n, "topic").select("topic", "size", "s", length.alias("length"))
    pairs = F.col("size") * (F.col("size") - 1)
    coherence = F.when(pairs > 0, (F.col("length") - F.col("size")) / pairs)
    membership = F.when(F.col("length") > 0, dot("u", "s") / F.sqrt("length"))
    return units.join(topics, "topic").select("id", "topic", membership.alias("membership"), "size", coherence.alias("coherence"))


def topic_keywords(texts: DataFrame, top: int = 5) -> DataFrame:
    """(topic, term, score, rank) from (topic, terms): a topic's terms of most occurrences times ln(texts / texts with the term)."""
    n = texts.count()
    own = texts.select("topic", F.explode("terms").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    held = texts.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    scored = own.join(held, "term").select("topic", "term", F.round(F.col("tf") * F.log(n / F.col("df")), 6).alias("score"))
    return top_per_key(scored, ["topic"], [F.desc("score"), F.col("term")], top)
