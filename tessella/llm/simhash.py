"""SimHash near-duplicates, with candidates found through the anchor points of covering codes.

The 64 bits are cut into blocks. Two fingerprints that differ in at most k bits differ, by the pigeonhole principle, in
at most t bits of some block whenever the blocks' (t + 1) add up to more than k. On each block the anchors are the words
of a covering code: a perfect Hamming code (covering radius 1) on its first bits, every word on the rest. A fingerprint
has its home at the nearest anchor and visits all anchors within covering radius plus t; so any pair within t meets at
the home of either. Comparing homes with visitors per anchor is therefore exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.rows import named, row_of
from tessella.operators.components import connected_components
from tessella.runtime import materialize

#: (first bit, bits, Hamming parity bits r with 2**r - 1 code bits or 0, t). (t + 1) add up to 5 in either plan: k = 4.
THREE_BLOCKS = ((0, 22, 4, 1), (22, 21, 4, 1), (43, 21, 4, 0))
#: 27 anchor bits a block in place of 17 or 18: more copies of each fingerprint, fewer chance meetings. Both plans are exact;
#: this one is cheaper from about 100 million distinct fingerprints.
TWO_BLOCKS = ((0, 32, 5, 2), (32, 32, 5, 1))
#: A block of one anchor's comparison: so many homes against so many visitors; larger anchors are cut into a grid.
HOMES, VISITORS = 4096, 131_072
PAIRS_AT_ONCE = 1 << 20
PART = 10_000  # fingerprints of a group that meet its row in one place


def simhash(text: bytes | None) -> int:
    """64-bit SimHash over 4-word shingles (XXH64, seed 42); A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 4:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[3:], strict=False)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _simhash_udf(text: pa.Array) -> pa.Array:
    return pa.array(np.array([simhash(t.as_py()) for t in text], dtype=np.uint64).view(np.int64))


def simhash_column(text: Column | str) -> Column:
    """The fingerprint as a signed 64-bit column; a null or blank text has fingerprint 0."""
    return _simhash_udf(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def hex16(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def nearest_anchor(block: np.ndarray, r: int) -> np.ndarray:
    """The code word nearest to each block value: its first 2**r - 1 bits decoded by their syndrome, the rest as they are."""
    if not r:
        return block
    syndrome = np.zeros(block.shape, dtype=np.uint64)
    for i in range(1, 1 << r):
        syndrome ^= np.where(block >> np.uint64(i - 1) & np.uint64(1), np.uint64(i), np.uint64(0))
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return block ^ flip


def anchors(fps: np.ndarray, plan=THREE_BLOCKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, visitor): for every fingerprint its homes (visitor 0) and the anchors it visits (visitor 1)."""
    rows, cells, visitors = [], [], []
    for b, (start, width, r, t) in enumerate(plan):
        block = fps >> np.uint64(start) & np.uint64((1 << width) - 1)
        errors = np.array([sum(1 << i for i in bits) for n in range(t + 1) for bits in combinations(range(width), n)], dtype=np.uint64)
        near = np.sort(nearest_anchor(block[:, None] ^ errors, r), axis=1)
        first = np.ones(near.shape, dtype=bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row = np.nonzero(first)[0]
        for own, at, kind in ((np.arange(len(fps)), nearest_anchor(block, r), 0), (row, near[first], 1)):
            rows.append(own)
            cells.append(at | np.uint64(b << 60))
            visitors.append(np.full(len(own), kind, dtype=np.int8))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(visitors)


def _place(plan):
    schema = pa.schema([("cell", pa.int64()), ("visitor", pa.int8()), ("fp", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 1024):
                part = fps[at : at + 1024]
                row, cell, visitor = anchors(part, plan)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(visitor), pa.array(part[row].view(np.int64))], schema=schema)

    return place


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of values linked by the pairs: at most one link for each value, and the same groups."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _compare(k: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and part, homes first; the homes of the last anchor wait for the next batch."""
        open_key, open_homes = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "part_h", "part_v")])
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            if open_key is not None and (key[:, 0] == open_key).all():
                key = np.concatenate([np.repeat(open_key[:, None], len(open_homes), axis=1), key], axis=1)
                visitor = np.concatenate([np.zeros(len(open_homes), dtype=visitor.dtype), visitor])
                fp = np.concatenate([open_homes, fp])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            run = np.zeros(len(fp), dtype=np.int64)
            run[new[1:]] = 1
            run = np.cumsum(run)
            homes = np.add.reduceat((visitor == 0).astype(np.int64), new)
            open_key, open_homes = key[:, -1], fp[new[-1] : new[-1] + homes[-1]].copy()
            at = np.flatnonzero(visitor)
            meets = homes[run[at]]
            at, meets = at[meets > 0], meets[meets > 0]
            total = np.cumsum(meets)
            lo = 0
            while lo < len(at):
                done = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, side="right")))
                n = meets[lo:hi]
                v = np.repeat(at[lo:hi], n)
                h = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + new[run[v]]
                x, y = fp[v], fp[h]
                close = (np.bitwise_count(x ^ y) <= k) & (x != y)
                if close.any():
                    p, q = spanning_links(x[close], y[close])
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], schema=schema)
                lo = hi

    return compare


def links(fingerprints: DataFrame, k: int = 4, plan=THREE_BLOCKS) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp) that differ in at most ``k`` bits.

    A spanning forest of the links that meet at an anchor stands for all of them, so groups of thousands of near copies
    give one row for each member and anchor, not one for each pair; the connected groups are those of all links.
    """
    fps = materialize(fingerprints.select("fp").distinct(), "fps")
    if sum(t + 1 for *_, t in plan) <= k:
        raise ValueError("this plan misses pairs that differ in k bits")
    placed = fps.mapInArrow(_place(plan), "cell long, visitor byte, fp long")
    homes = fps.mapInArrow(_place(tuple((s, w, r, 0) for s, w, r, _ in plan)), "cell long, visitor byte, fp long").where("visitor = 0")
    crowded = materialize(homes.groupBy("cell").count().where(F.col("count") > HOMES), "crowded")
    none = F.lit(1).cast("long")
    if crowded.isEmpty():
        placed = placed.withColumn("h", none).withColumn("v", none)
    else:
        visits = placed.where("visitor = 1").join(crowded.select("cell"), "cell", "left_semi").groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("v"))
        grid = materialize(crowded.join(visits, "cell").select("cell", F.ceil(F.col("count") / HOMES).alias("h"), "v"), "grid")
        placed = placed.join(grid, "cell", "left").withColumns({"h": F.coalesce("h", none), "v": F.coalesce("v", none)})
    salt = F.xxhash64("fp", "cell")
    mine = lambda n: F.pmod(salt, n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    is_home = F.col("visitor") == 0
    placed = placed.select(
        "cell", "visitor", "fp",
        F.when(is_home, F.array(mine(F.col("h")))).otherwise(F.when(F.col("h") == 1, F.array(none - 1)).otherwise(every(F.col("h")))).alias("hs"),
        F.when(~is_home, F.array(mine(F.col("v")))).otherwise(F.when(F.col("v") == 1, F.array(none - 1)).otherwise(every(F.col("v")))).alias("vs"),
    )
    if crowded.isEmpty():
        placed = placed.select("cell", F.lit(0).alias("part_h"), F.lit(0).alias("part_v"), "visitor", "fp")
    else:
        placed = placed.withColumn("part_h", F.explode("hs")).select("cell", "part_h", F.explode("vs").alias("part_v"), "visitor", "fp")
    met = placed.repartition("cell", "part_h", "part_v").sortWithinPartitions("cell", "part_h", "part_v", "visitor")
    return met.mapInArrow(_compare(k), "src long, dst long")


def _grouped(marked: DataFrame, key: Column, k: int) -> DataFrame:
    """(fp, least): of each fingerprint of ``marked``, the smallest ``key`` in its group of linked fingerprints.

    Only fingerprints of groups meet their group's row, and those of large groups in parts of about PART.
    """
    distinct = materialize(marked.groupBy("fp").agg(F.min(key).alias("own")), "distinct")
    groups = materialize(connected_components(links(distinct, k)).select(F.col("node").alias("fp"), "component"), "members")
    members = materialize(distinct.join(groups, "fp"), "member-keys")
    firsts = members.groupBy("component").agg(F.min("own").alias("least"), (F.count("*") / PART).cast("long").alias("more"))
    large = materialize(firsts.where("more > 0").select("component", "more"), "large")  # a row for PART fingerprints or more
    parted = members.join(large, "component", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("more", F.lit(0)) + 1))
    spread = firsts.select("component", "least", F.explode(F.sequence(F.lit(0).cast("long"), "more")).alias("part"))
    named_ = parted.join(spread, ["component", "part"]).select("fp", "least")
    return named_.unionAll(distinct.join(groups, "fp", "left_anti").select("fp", F.col("own").alias("least")))


def near_duplicates(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest doc_id reachable over links of ``k`` bits or fewer.

    Null and blank texts have fingerprint 0 and are linked like any other; very long texts are read whole. Rows that
    repeat each get a row. A null doc_id is never a component's id unless all its members lack one. Only doc_id and text
    are read, whatever other columns there are; an empty table gives an empty result.
    """
    marked = materialize(docs.select("doc_id", simhash_column("text").alias("fp")), "marked")
    return marked.join(_grouped(marked, F.col("doc_id"), k), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 4) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id (null last, ties by place in the table).

    Rows are told apart by their own number, so unlike texts that share a doc_id both stay. Null and blank texts are a
    group like any other; an empty table stays empty; columns of any name stay as they are.
    """
    marked = docs.select(row_of(docs), named("doc_id").alias("doc_id"), simhash_column("text").alias("fp"))
    marked = materialize(marked.withColumn("row_no", F.monotonically_increasing_id()), "marked")  # which fixes the numbers
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no")
    firsts = _grouped(marked.select("doc_id", "fp", "row_no"), place, k).select("least.row_no").distinct()
    gone = marked.select("row_no").join(firsts, "row_no", "left_anti")
    return marked.join(materialize(gone, "gone"), "row_no", "left_anti").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")
