"""Best-fit packing of token sequences by best-two-fit, over the histogram of lengths.

Which lengths share a sequence depends only on how many pieces have each length, and there are at most ``capacity``
lengths. So the plan is made once, on the histogram: a pattern of lengths is filled greedily, its smallest piece is
replaced by two that fill the expanded gap more tightly, and the pattern is used as often as the pieces last. The pieces,
ranked within their length, then look up their places; no piece passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.tokens import task_encoder, vocabulary_path
from tessella.runtime import materialize

CAPACITY, END_ID = 2048, 0
RANKED = 20_000  # pieces of a length that one task ranks


@dataclass(frozen=True)
class Pattern:
    """Lengths (largest first, with how many of each) that fill one sequence, used for ``times`` sequences."""

    lengths: tuple[tuple[int, int], ...]
    times: int


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length in stock up to ``most``, 0 if none."""
    at = np.flatnonzero(counts[: most + 1])
    return int(at[-1]) if len(at) else 0


def tighter_pair(stock: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two lengths in stock whose sum is the largest up to ``room`` and over ``least``."""
    have = np.flatnonzero(stock[:room])
    if not len(have):
        return None
    partner = have[np.maximum(np.searchsorted(have, np.minimum(room - have, have), side="right") - 1, 0)]
    sums = np.where(partner + have <= room, have + partner, 0)
    single = (partner == have) & (stock[have] < 2)
    if single.any():  # its partner is the next smaller one
        lower = np.maximum(np.arange(len(have)) - 1, 0)
        partner = np.where(single, have[lower], partner)
        sums = np.where(single, np.where((np.arange(len(have)) > 0) & (have + partner <= room), have + partner, 0), sums)
    best = int(np.argmax(sums))
    return (int(have[best]), int(partner[best])) if sums[best] > least else None


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up ``counts`` (pieces of each length)."""
    stock = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        stock[length] = n
    plan = []
    while length := _largest(stock, capacity):
        left, bin_ = stock.copy(), Counter({length: 1})
        left[length] -= 1
        gap = capacity - length
        while gap and (more := _largest(left, gap)):
            take = min(int(left[more]), gap // more)
            bin_[more] += take
            left[more] -= take
            gap -= take * more
        while gap and sum(bin_.values()) > 1:
            small = min(bin_)
            pair = tighter_pair(left, gap + small, small)
            if not pair:
                break
            bin_[small] -= 1
            left[small] += 1
            bin_ = +bin_
            for x in pair:
                bin_[x] += 1
                left[x] -= 1
            gap += small - sum(pair)
        times = min(int(stock[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            stock[x] -= times * n
        plan.append(Pattern(tuple(sorted(bin_.items(), reverse=True)), times))
    return plan


def places(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of it in a sequence, offset) in order of rank."""
    used, found, sequence = Counter(), {}, 0
    for p in plan:
        offset = 0
        for length, n in p.lengths:
            found.setdefault(length, []).append((used[length], sequence, n, offset))
            used[length] += n * p.times
            offset += n * length
        sequence += p.times
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` ids, each at most ``capacity``; only the first may be shorter."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, at + capacity) for at in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each text's ids and the end id; a null text is empty."""
    path, end = vocabulary_path(vocabulary), np.array([end_id], dtype="<u4").tobytes()
    names = ("piece", "start", "length", "ids_crc32")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(path) as encoding:
            for batch in batches:
                rows, columns, raws = [], ([], [], [], []), []
                for row, text in enumerate(batch.column("text")):
                    raw = memoryview(encoding.raw(text.as_py() or "") + end)
                    for piece, (a, b) in enumerate(cut_lengths(len(raw) // 4, capacity)):
                        part = raw[4 * a : 4 * b]
                        rows.append(row)
                        for column, value in zip(columns, (piece, a, b - a, zlib.crc32(part)), strict=True):
                            column.append(value)
                        if with_ids:
                            raws.append(bytes(part))
                found = [batch.column("doc_id").take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(found + ([pa.array(raws, type=pa.binary())] if with_ids else []), names=["doc_id", *names] + ["ids"] * with_ids)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in names)] + [T.StructField("ids", T.BinaryType())] * with_ids)
    return docs.select("doc_id", "text").mapInArrow(split, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian 32-bit) of every piece.

    Null and empty texts are packed as their end id alone; repeated rows are packed each; an empty table gives no rows;
    a long text gives as many pieces as it needs. Columns other than doc_id and text are ignored, whatever their names.
    Pieces of a length are ranked in parts of about RANKED rows each, so that no task ranks more.
    """
    pieces = materialize(token_pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    columns = pieces.columns
    salts = 1 + pieces.count() // RANKED  # the count is read from the files' footers
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "parts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    at = places(best_two_fit(counts, capacity))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(own):
                size = int(length[own[0]])
                first, base, n, start = at[size][np.searchsorted(at[size][:, 0], rank[own], side="right") - 1].T
                sequence[own] = base + (rank[own] - first) // n
                offset[own] = start + (rank[own] - first) % n * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    place.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    where = F.arrow_udf(place, T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(parts.select("length", "salt", before.alias("before")), ["length", "salt"])
    placed = ranked.withColumn("at", where(F.col("length"), F.col("before") + F.col("own")))
    return placed.select(*columns, "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian 32-bit), from a table packed ``with_ids``; a sequence is at most ``capacity`` ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("s")).select("sequence_id", F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids)).alias("ids"))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
