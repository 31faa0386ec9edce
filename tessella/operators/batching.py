"""Batches filled in order under a budget, over any number of rows of a key.

Where a batch ends depends on where it began, so filling is a chain through all rows. It is cut into blocks: for each row of
a block that a batch could start at, the block says at which row of the next block the chain goes on, and how many batches
it started. Such tables compose, so blocks are joined pairwise into larger ones up to a key's whole chain, and the true
starts are handed down again. Every step is a grouping of bounded size, whatever the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import ordinals
from tessella.runtime import materialize

#: Rows of a block, more than any batch holds; blocks joined at once.
BLOCK, FAN = 8192, 16
_TABLE = pa.schema([("key", pa.string()), ("block", pa.int64()), ("goes", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))])
_DDL = "key string, block long, goes array<int>, starts array<long>"


def _next_starts(tokens: np.ndarray, own: int, size: int, budget: int) -> np.ndarray:
    """For each of the first ``own`` rows: the row at which the next batch starts if one starts there."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    by_budget = np.searchsorted(sums, sums[:own] + budget, side="right") - 1
    return np.minimum(by_budget, np.arange(own) + size)


def chain_table(tokens: np.ndarray, own: int, size: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a block's rows: the row of the next block at which the batch after its last one starts, and how many start in this one."""
    following = _next_starts(tokens, own, size, budget)
    goes, starts = following - own, np.ones(own, dtype=np.int64)
    for i in range(own - 1, -1, -1):
        if following[i] < own:
            goes[i], starts[i] = goes[following[i]], starts[following[i]] + 1
    return goes, starts


def budget_batches(rows: DataFrame, key: str, order: str, tokens: str, budget: int = 8000, buffer: float = 0.9, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, order, batch) of the rows in batches, (key, n, skipped, batch_size, batches)).

    A row goes into the open batch unless that would run over the budget or the batch has ``batch_size`` rows, the buffered
    budget over the key's mean tokens, at least 1, and 1 for a single row. Rows over the budget are skipped. Batches are
    numbered from 0. The result is that of a loop over all of a key's rows in order, ties by tokens; null keys are left out.
    """
    block = block or BLOCK
    if block <= budget * buffer:
        raise ValueError("a block must hold any batch")
    base = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens"))
    base = materialize(base, "tokens")
    sizes = base.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("tokens") > budget, 1)).alias("skipped"), F.avg("tokens").alias("mean"))
    size = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.floor(budget * buffer / F.greatest("mean", F.lit(1.0))).cast("int"))).otherwise(1)
    sizes = materialize(sizes.select("key", "n", "skipped", size.alias("batch_size")), "sizes")
    placed = ordinals(base.where(F.col("tokens") <= budget), "key", ["order", "tokens"]).join(sizes.select("key", "batch_size"), "key")
    placed = materialize(placed.withColumn("block", F.floor(F.col("idx") / block)), "placed")
    ahead = placed.where((F.col("idx") % block < F.col("batch_size")) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)

    def table(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        own = int((part.column("idx").to_numpy() // block == group[1].as_py()).sum())
        goes, starts = chain_table(part.column("tokens").to_numpy(), own, part.column("batch_size")[0].as_py(), budget)
        return pa.table({"key": [group[0]], "block": [group[1]], "goes": [goes], "starts": [starts]}, schema=_TABLE)

    levels = [materialize(placed.unionByName(ahead).select("key", "block", "idx", "tokens", "batch_size").groupBy("key", "block").applyInArrow(table, _DDL), "chains")]

    def compose(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        goes, starts = (part.column(c)[0].values.to_numpy() for c in ("goes", "starts"))
        for i in range(1, part.num_rows):
            on, count = (part.column(c)[i].values.to_numpy() for c in ("goes", "starts"))
            inside = goes < len(on)  # beyond a short last block there is nothing
            at = np.where(inside, goes, 0)
            goes, starts = np.where(inside, on[at], 0), starts + np.where(inside, count[at], 0)
        return pa.table({"key": [group[0]], "block": [group[1]], "goes": [goes], "starts": [starts]}, schema=_TABLE)

    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("within", F.col("block")).withColumn("up", F.floor(F.col("block") / FAN))
        levels.append(materialize(up.groupBy("key", "up").applyInArrow(compose, _DDL), "chains"))
    totals = levels[-1].select("key", F.get("starts", F.lit(0)).alias("batches"))
    entries = levels[-1].select("key", "block", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"))
    kind = pa.schema([("key", pa.string()), ("block", pa.int64()), ("entry", pa.int32()), ("before", pa.int64())])

    def hand_down(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        entry, before, out = part.column("entry")[0].as_py(), part.column("before")[0].as_py(), []
        for i in range(part.num_rows):
            out.append((group[0].as_py(), part.column("block")[i].as_py(), entry, before))
            goes = part.column("goes")[i].values
            if entry < len(goes):
                entry, before = goes[entry].as_py(), before + part.column("starts")[i].values[entry].as_py()
            else:
                entry = 0
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.floor(F.col("block") / FAN)).join(entries.withColumnRenamed("block", "up"), ["key", "up"])
        entries = materialize(below.groupBy("key", "up").applyInArrow(hand_down, "key string, block long, entry int, before long"), "entries")

    numbered = pa.schema([("key", pa.string()), ("idx", pa.int64()), ("batch", pa.int64())])

    def number(group: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        values = part.column("tokens").to_numpy()
        following = _next_starts(values, len(values), part.column("batch_size")[0].as_py(), budget)
        new, at = np.zeros(len(values), dtype=np.int64), part.column("entry")[0].as_py()
        while at < len(values):
            new[at], at = 1, following[at]
        batch = part.column("before").to_numpy() + np.cumsum(new) - 1
        return pa.table({"key": part.column("key"), "idx": part.column("idx"), "batch": batch}, schema=numbered)

    given = placed.join(entries, ["key", "block"]).select("key", "block", "idx", "tokens", "batch_size", "entry", "before")
    batches = given.groupBy("key", "block").applyInArrow(number, "key string, idx long, batch long")
    each = placed.select("key", "idx", "order").join(batches, ["key", "idx"]).select(F.col("key").alias(key), F.col("order").alias(order), "batch")
    report = sizes.join(totals, "key", "left").select(F.col("key").alias(key), "n", "skipped", "batch_size", F.coalesce("batches", F.lit(0)).alias("batches"))
    return each, report
