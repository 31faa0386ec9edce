"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Every document of a source gets a rate, the number of times that it is wanted. Among the rates between 0 and 2 that give
the source its target of words, entropy balancing takes those nearest to 1 in relative entropy; by duality they are
exponential tilts that stop at the limit, min(2, exp(lambda * size / mean size)), with one lambda a source. Newton's
method finds the lambdas: the dual's gradient and curvature are sums over the sizes that occur, one grouped aggregation
a step. The rates are then rounded into whole copies, first class by class (source and size), then within each class.

All sums that decide anything are of whole numbers, so that the order of rows and tasks can't change a result.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.rows import named, row_of
from tessella.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
UNIT, PARTS = 1 << 20, 1 << 30  # rates, and words in sums, are whole numbers of these parts
NEWTON_STEPS, GAP = 200, 1e-7  # steps until the search is given up with an error, and the part of a target that may be missed
NEAR, EXCHANGES = 0.005, 12  # part of a target that is near enough, and rounds that may exchange copies to come there
RANKED = 20_000  # rows of a class that one task ranks


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with source_no, from 1 in code-point order with null last; ranges of sources are numbered apart."""
    ranges = materialize(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    own = F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return ranges.withColumn("own", own).join(F.broadcast(before), "part").withColumn("source_no", F.col("before") + F.col("own")).drop("part", "own", "before")


def targets(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """A row for each source, in code-point order with null last: its number, size, weight and target.

    Weights repeat along the order. Sources are filled by weight from total times all sizes; one that reaches ``most``
    times its own size stops there, and the others share the rest: a common level that rises until no more stop.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long")
    filled = materialize(numbered_sources(sources).withColumn("weight", weight), "sources")
    cap = most * F.col("source_size")
    everything = total * (filled.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and with each round at least one more source has stopped
        stopped = cap <= level * F.col("weight")
        full, open_weight = filled.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (everything - (full or 0)) / open_weight
        if raised <= level:
            break
        level = raised
    return filled.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(lam * size / mean, F.log(F.lit(float(MOST)))))


def _whole(x: Column) -> Column:
    """Sums in whole parts of a word: exact in any order."""
    return F.round(x * PARTS).cast("decimal(38,0)")


def solve(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_no, lam): Newton's method on the dual, kept inside a bracket; null where a source is taken whole MOST times."""
    mean = F.col("source_size") / F.col("source_rows")
    none = F.lit(None).cast("double")
    open_ = (F.col("source_size") > 0) & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-9))
    state = materialize(sources.where(open_).select("source_no", mean.alias("mean"), "target", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), F.lit(1.0).alias("gap")), "dual")
    for step in range(NEWTON_STEPS + 1):
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= GAP:
            break
        if step == NEWTON_STEPS:
            raise ArithmeticError(f"a source misses its target by {worst} of it")
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        r = rate(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size")
        # a rate at its limit does not move with lambda
        sums = classes.join(state.select("source_no", "lam", "mean"), "source_no").groupBy("source_no").agg(
            F.sum(_whole(words * r)).alias("got"),
            F.sum(F.when(tilt < math.log(MOST), _whole(words * r * F.col("size") / F.col("mean"))).otherwise(_whole(F.lit(0.0)))).alias("slope"),
        )
        over = F.col("got") / PARTS - F.col("target")
        moved = state.join(sums, "source_no").withColumns({"over": over.cast("double"), "slope": (F.col("slope") / PARTS).cast("double")})
        moved = moved.withColumns({"lo": F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi"))})
        reach = 2 * (1 + F.abs("lam"))
        move = F.greatest(-reach, F.least(reach, F.coalesce(-F.col("over") / F.nullif("slope", F.lit(0.0)), -F.signum("over") * reach)))
        aim = F.col("lam") + move
        inside = F.coalesce((aim > F.col("lo")), F.lit(True)) & F.coalesce((aim < F.col("hi")), F.lit(True))
        gap = F.abs("over") / F.col("target")
        # a source that is near enough keeps its lambda
        lam = F.when(gap <= GAP, F.col("lam")).when(inside, aim).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialize(moved.select("source_no", "mean", "target", lam.alias("lam"), "lo", "hi", gap.alias("gap")), "dual")
    return state.select("source_no", "lam")


def _settle(classes: DataFrame, exchange: bool = True) -> DataFrame:
    """One round, with the copies ``more`` that it moves, towards what is left of each source's target and never past it.

    Classes add or drop copies, largest sizes first. Where no size is small enough, and over NEAR of the target is left,
    copies of two sizes are exchanged: of neighbours that can, those whose difference fits best.
    """
    own = W.partitionBy("source_no")
    up = own.orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    larger = own.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("target") - F.sum(F.col("k") * F.col("size")).over(own)
    add, drop = MOST * F.col("n") - F.col("k"), F.col("k")
    sided = classes.withColumn("left", left).withColumns({"gap": F.abs("left"), "with_": F.when(F.col("left") > 0, add).otherwise(drop), "against": F.when(F.col("left") > 0, drop).otherwise(add)})
    room = F.when((F.col("size") > 0) & (F.col("size") <= F.col("gap")), F.col("with_")).otherwise(0).cast("long")
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
    fitting = F.floor((F.col("gap") - before) / F.nullif("size", F.lit(0)))
    more = F.when(F.col("room") > 0, F.least(F.col("room"), F.greatest(F.lit(0).cast("long"), fitting))).otherwise(0)
    moved = sided.withColumn("room", room).withColumn("more", more.cast("long"))
    lower = F.last(F.when((F.col("against") > 0) & (F.col("size") > 0), F.struct(F.col("size").alias("b"), "against")), ignorenulls=True).over(up)
    paired = moved.withColumn("lower", lower).withColumn("by", F.col("size") - F.col("lower.b"))
    times = F.least("with_", F.col("lower.against"), F.floor(F.col("gap") / F.nullif("by", F.lit(0))))
    pair = F.when(F.lit(exchange) & (F.col("gap") > NEAR * F.col("target")) & (F.max("room").over(own) == 0) & (times > 0), F.struct("by", F.col("size").alias("a"), "lower.b", times.alias("times")))
    best = paired.withColumn("pair", pair).withColumn("best", F.max("pair").over(own))
    swap = F.when(F.col("size") == F.col("best.a"), F.col("best.times")).when(F.col("size") == F.col("best.b"), -F.col("best.times")).otherwise(0)
    step = F.col("more") + F.coalesce(swap, F.lit(0))
    return best.withColumn("k", F.col("k") + (F.signum("left") * step).cast("long")).withColumn("more", F.abs(step).cast("long")).select(*classes.columns, "more")


def class_copies(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_no, size, n, lam, k): the copies k that all n documents of a size get together."""
    lam = solve(classes, sources)
    tilted = classes.join(sources.select("source_no", "source_size", "source_rows", "target"), "source_no").join(lam, "source_no", "left")
    r = F.coalesce(rate(F.col("lam"), F.col("size"), F.col("source_size") / F.col("source_rows")), F.lit(float(MOST)))
    tilted = tilted.withColumn("rate", r).withColumn("units", F.round(F.col("n") * F.col("rate") * UNIT).cast("long"))
    upto = F.floor(F.sum("units").over(W.partitionBy("source_no").orderBy("size").rowsBetween(W.unboundedPreceding, 0)) / UNIT + 0.5)
    before = F.lag("upto", 1, 0).over(W.partitionBy("source_no").orderBy("size"))
    rounded = tilted.withColumn("upto", upto).withColumn("k", F.col("upto") - before).select("source_no", "size", "n", "rate", "target", "k")
    rounded = materialize(rounded, "rounded")
    for i in count():  # each round brings every source nearer to its target or leaves it
        settled = materialize(_settle(rounded, i < EXCHANGES), "settled")
        rounded = settled.drop("more")
        if not settled.agg(F.max("more")).first()[0]:
            return rounded


def mix(docs: DataFrame, columns: list[str] | None = None, weights=WEIGHTS, total: float = TOTAL) -> DataFrame:
    """row (a struct of the named columns, all by default), size, source_size, target, rate and copies of each document.

    Null and blank texts have size 0 and are rated like the others of that size; very long texts are counted whole; a
    null source is a source of its own, the last; repeated rows each have their copies; an empty table stays empty.
    Columns of the input stay inside ``row``, so that no name can clash. Documents of a class are ranked in parts of about
    RANKED rows.
    """
    sized = materialize(docs.select(row_of(docs, columns), named("doc_id").alias("id"), named("source").alias("source"), word_count("text").alias("size")), "sized")
    salts = 1 + sized.count() // RANKED  # the count is read from the files' footers
    sources = materialize(targets(sized.select("source", "size"), weights, total), "targets")
    numbered = sized.join(sources.select(F.col("source").alias("s"), "source_no"), F.col("source").eqNullSafe(F.col("s")))
    numbered = numbered.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    parts = materialize(numbered.groupBy("source_no", "size", "salt").agg(F.count("*").alias("n")), "parts")
    copies = class_copies(parts.groupBy("source_no", "size").agg(F.sum("n").alias("n")), sources)
    along = W.partitionBy("source_no", "size").orderBy("salt")
    spread = parts.withColumn("c", F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spread = spread.join(copies.select("source_no", "size", F.col("n").alias("all_n"), "rate", "k"), ["source_no", "size"])
    share = lambda c: (F.col("k").cast("decimal(38,0)") * c / F.col("all_n")).cast("decimal(38,6)")
    quota = F.floor(share(F.col("c"))) - F.floor(share(F.col("c") - F.col("n")))
    quotas = materialize(spread.select("source_no", "size", "salt", "n", "rate", quota.cast("long").alias("quota")), "quotas")
    rank = F.row_number().over(W.partitionBy("source_no", "size", "salt").orderBy(F.xxhash64("id", F.lit("rank")), "id"))
    ranked = numbered.select("row", "size", "source_no", "salt", rank.alias("rank")).join(quotas, ["source_no", "size", "salt"])
    copies_of = F.floor(F.col("quota") / F.col("n")) + F.when(F.col("rank") <= F.col("quota") % F.col("n"), 1).otherwise(0)
    return ranked.select("row", "size", "source_no", "rate", copies_of.cast("long").alias("copies")).join(sources.select("source_no", "source_size", "target"), "source_no").select("row", "size", "source_size", "target", "rate", "copies")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    return mix(docs).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op7_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
