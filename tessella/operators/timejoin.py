"""Joins on time: ranges that overlap, and the last row on or before another, without nested loops and without a task for a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.ordering import RANGE_ROWS
from tessella.runtime import materialize

#: Each level's bins are so many times as wide as those of the level below.
STEP = 4
LEVELS = 24


def on_line(value: Column, kind: T.DataType) -> Column:
    """A number or time as a number; microseconds for times, without a time zone for those that have none."""
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(value.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
        return day + (F.hour(value) * 3600 + F.minute(value) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    return value.cast("double")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed ranges share a point; one column given twice makes points of a side.

    A row is filed by a level, the first whose bins (``width`` times a power of STEP) are as long as its range, so it lies in one or
    two bins there, however long it is. At every level from its own up it offers these bins; two rows meet at the higher
    of their levels, in the first bin that they share. So the join is on equal keys, level and bin. A null end has no limit; rows with
    a null start or key, or an end before the start, meet nothing. Columns of the sides must have names of their own, keys apart.
    """
    sides = []
    for df, (start, end) in ((left, left_ends), (right, right_ends)):
        a, b = on_line(F.col(start), df.schema[start].dataType), on_line(F.col(end), df.schema[end].dataType)
        sides.append(df.withColumn("_a", a / width).withColumn("_b", b / width).where("_a IS NOT NULL"))
    last = reduce(lambda x, y: max(x, y), (v for s in sides for v in s.agg(F.max("_a"), F.max("_b")).first() if v is not None), 0.0)
    sides = [s.withColumn("_b", F.coalesce("_b", F.lit(float(last)))) for s in sides]
    level = F.least(F.ceil(F.log(float(STEP), F.greatest(F.col("_b") - F.col("_a"), F.lit(1.0)))).cast("int"), F.lit(LEVELS))
    sides = [s.where("_b >= _a").withColumn("_level", level) for s in sides]
    most = max((s.agg(F.max("_level")).first()[0] or 0) for s in sides)

    def filed(s: DataFrame, mark: str) -> DataFrame:
        at = s.withColumn("_at", F.explode(F.sequence(F.col("_level"), F.lit(most))))
        size = F.pow(F.lit(float(STEP)), F.col("_at"))
        bins = at.withColumn("_first", F.floor(F.col("_a") / size)).withColumn("_bin", F.explode(F.sequence(F.col("_first"), F.floor(F.col("_b") / size))))
        return bins.select(*keys, "_at", "_bin", *(F.col(c).alias(f"{c}_{mark}") for c in ("_a", "_b", "_level", "_first")), *(c for c in s.columns if c not in keys and not c.startswith("_")))

    pairs = filed(sides[0], "l").join(filed(sides[1], "r"), [*keys, "_at", "_bin"])
    met = pairs.where((F.col("_at") == F.greatest("_level_l", "_level_r")) & (F.col("_bin") == F.greatest("_first_l", "_first_r")) & (F.col("_a_l") <= F.col("_b_r")) & (F.col("_a_r") <= F.col("_b_l")))
    return met.select(*keys, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))


def interval_summary(spans: DataFrame, points: DataFrame, keys: list[str], ends: tuple[str, str], time: str, value: str) -> DataFrame:
    """Each row of ``spans`` that holds a point of equal ``keys`` in its closed range, with n, the number of these points, and least, the least ``value`` of them.

    No pair of a span and a point is made. Starts, points and ends are sorted as one and dealt by ranges of that order, so that a span
    is a run of numbered points and n the difference of two numbers. A run is put together from blocks of 1, STEP,
    STEP * STEP ... points, a few of each size, and a table of the blocks has the least of each. A null end has no limit; rows with a null
    start, time or key, or an end before the start, meet nothing.
    """
    line = lambda df, c: on_line(F.col(c), df.schema[c].dataType)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
    spans = spans.withColumn("_a", line(spans, ends[0])).withColumn("_b", line(spans, ends[1])).where(known & F.col("_a").isNotNull() & F.coalesce(F.col("_b") >= F.col("_a"), F.lit(True)))
    spans = materialize(spans.withColumn("_span", F.monotonically_increasing_id()), "spans")
    kind = points.schema[value].dataType
    marks = [spans.select(*keys, F.col(c).alias("_t"), F.col(c).isNull().alias("_open"), F.lit(side).alias("_side"), "_span", F.lit(None).cast(kind).alias("_value")) for c, side in (("_a", 0), ("_b", 2))]
    marks.append(points.select(*keys, line(points, time).alias("_t"), F.lit(False).alias("_open"), F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_span"), F.col(value).alias("_value")).where(known & F.col("_t").isNotNull()))
    both = reduce(DataFrame.unionAll, marks)
    size = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // RANGE_ROWS))
    order = [*keys, "_open", "_t", "_side", "_span"]
    dealt = both.repartitionByRange(size, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(dealt.select("_side", "_span", "_value", "_place"), "on-line").withColumn("_range", F.shiftright("_place", 33)).withColumn("_point", (F.col("_side") == 1).cast("long"))
    held = placed.groupBy("_range").agg(F.sum("_point").alias("held"))  # a row a range
    starts = held.select("_range", F.coalesce(F.sum("held").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    along = W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.withColumn("_seen", F.sum("_point").over(along)).join(F.broadcast(starts), "_range").select("_side", "_span", "_value", (F.col("_seen") + F.col("before")).alias("_rank"))
    ranked = materialize(ranked, "ranked")
    last = lambda side: F.max(F.when(F.col("_side") == side, F.col("_rank")))
    runs = materialize(ranked.where("_side <> 1").groupBy("_span").agg(last(0).alias("_lo"), last(2).alias("_hi")).where("_hi > _lo"), "runs")
    longest = runs.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 0
    levels = next(k for k in range(64) if STEP**k >= longest)
    up = lambda k: (F.floor((F.col("_lo") + (STEP**k - 1)) / STEP**k), F.floor(F.col("_hi") / STEP**k))
    run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
    named = lambda blocks, k: F.transform(blocks, lambda x: F.struct(F.lit(k).alias("_level"), x.alias("_block")))
    parts = []
    for k in range(levels + 1):  # whole blocks of this size on either side of those of the next, or all if there are none
        (lo, hi), (more_lo, more_hi) = up(k), up(k + 1)
        blocks = F.when(more_lo < more_hi, F.concat(run(lo, more_lo * STEP), run(more_hi * STEP, hi))).otherwise(run(lo, hi)) if k < levels else run(lo, hi)
        parts.append(named(blocks, k))
    asked = runs.select("_span", F.explode(F.concat(*parts)).alias("x")).select("_span", "x.*")
    numbers = ranked.where("_side = 1").select((F.col("_rank") - 1).alias("_idx"), "_value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    table = numbers.groupBy("_level", F.floor(F.col("_idx") / F.pow(F.lit(float(STEP)), F.col("_level"))).alias("_block")).agg(F.min("_value").alias("_value"))
    least = asked.join(table, ["_level", "_block"]).groupBy("_span").agg(F.min("_value").alias("least"))
    met = spans.join(runs, "_span").join(least, "_span")
    return met.select(*(c for c in spans.columns if c not in ("_a", "_b", "_span")), (F.col("_hi") - F.col("_lo")).alias("n"), "least")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: list[str] | None = None, strict: bool = False, most: float | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same keys on or before it (before it, if ``strict``); nulls where there is none.

    Both sides are sorted as one by keys and time and dealt by ranges of that order, so a key may be in many tasks. Within a range
    the last right row is carried along; what a range starts with is the last right row of the ranges before, from a table of
    one row a key and range. Of right rows at the same time the largest by ``tie`` counts. ``most`` is the longest gap, in the units of
    ``on_line``. Rows of ``right`` without key or time meet nothing. Columns of the sides must have names of their own, keys apart.
    """
    own = [c for c in right.columns if c not in keys]
    carried = F.struct(*own)
    none = F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)
    rows_type = F.struct(*(c for c in left.columns if c not in keys))
    nothing = F.lit(None).cast(left.select(rows_type.alias("x")).schema["x"].dataType)
    l_side = left.select(*keys, on_line(F.col(left_time), left.schema[left_time].dataType).alias("_t"), F.lit(0 if strict else 2).alias("_side"), none.alias("_r"), rows_type.alias("_l"))
    r_side = right.select(*keys, on_line(F.col(right_time), right.schema[right_time].dataType).alias("_t"), F.lit(1).alias("_side"), carried.alias("_r"), nothing.alias("_l"))
    r_side = r_side.where(F.col("_t").isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True)))
    both = l_side.unionAll(r_side)
    size = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // RANGE_ROWS))
    order = ["_t", "_side", *(f"_r.{c}" for c in tie or [])]
    dealt = both.repartitionByRange(size, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(dealt, "as-of").withColumn("_range", F.shiftright("_place", 33))
    lasts = placed.groupBy(*keys, "_range").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_place"))).alias("_last"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = lasts.select(*keys, "_range", F.last("_last", ignorenulls=True).over(before).alias("_start"))
    along = W.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    seen = placed.withColumn("_seen", F.last("_r", ignorenulls=True).over(along))
    same = reduce(lambda a, b: a & b, (seen[k].eqNullSafe(starts[k]) for k in keys), seen["_range"] == starts["_range"])
    met = seen.join(starts, same, "left").where("_l IS NOT NULL").select(*(seen[k] for k in keys), "_t", "_l", F.coalesce("_seen", "_start").alias("_r"))
    if most is not None:
        gap = F.col("_t") - on_line(F.col("_r")[right_time], right.schema[right_time].dataType)
        met = met.withColumn("_r", F.when(gap <= most, F.col("_r")))
    return met.select(*keys, "_l.*", *(F.col("_r")[c].alias(c) for c in own))
