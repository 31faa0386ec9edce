"""A query table against all rows of another, in blocks: only the best rows of each query leave a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered
from tessella.operators.relational import top_per_key
from tessella.runtime import materialize

QUERIES, ROWS = 4096, 4096
#: Bytes of query blocks that are broadcast at once; the other table is read once for each such group.
GROUP_BYTES = 64 << 20

#: Takes a block of queries and a block of rows; gives scores[query, row], -inf where there is none.
Scorer = Callable[[pa.Table, pa.Table], np.ndarray]


def query_blocks(queries: DataFrame, size: int | None = None) -> DataFrame:
    """(block, bytes, asked): all queries in full blocks, however they were partitioned, each an Arrow stream in one value."""
    columns = queries.columns
    dealt = numbered(queries, "block_row").withColumn("block", F.floor(F.col("block_row") / (size or QUERIES)))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        block = rows.sort_by("block_row").select(columns).combine_chunks()
        with pa.ipc.new_stream(sink, block.schema) as stream:
            stream.write_table(block)
        asked = sink.getvalue().to_pybytes()
        return pa.table({"block": [key[0].as_py()], "bytes": [len(asked)], "asked": [asked]}, schema=pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("asked", pa.binary())]))

    return materialize(dealt.groupBy("block").applyInArrow(pack, "block long, bytes long, asked binary"), "query-blocks")


def block_groups(sizes: list[tuple[int, int]], most: int = GROUP_BYTES) -> list[tuple[int, int]]:
    """First and last block of groups of neighbouring blocks (block, bytes) of at most ``most`` bytes, or of one block."""
    groups, held = [], 0
    for block, size in sorted(sizes):
        if groups and held + size <= most:
            groups[-1], held = (groups[-1][0], block), held + size
        else:
            groups.append((block, block))
            held = size
    return groups


class Best:
    """The best rows so far of each query of a block."""

    def __init__(self, queries: pa.Table, top_k: int, text_ids: bool):
        self.queries, self.top_k = queries, top_k
        self.scores = np.full((queries.num_rows, top_k), -np.inf)
        self.ids = np.zeros((queries.num_rows, top_k), dtype=object if text_ids else np.int64)

    def add(self, scores: np.ndarray, own: np.ndarray) -> None:
        """Take in scores[query, row]. What is behind a query's k-th, of those before or of these, is left at once; the few others are sorted."""
        if not self.top_k:
            return
        near = (scores >= self.scores[:, -1:]) & (scores > -np.inf)
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > self.top_k)
        if len(many):
            part = scores[many]
            near[many] &= part >= np.partition(part, -self.top_k, axis=1)[:, -self.top_k, None]
        at, col = np.nonzero(near)
        if not len(at):
            return
        before, place = np.nonzero(self.scores > -np.inf)
        at, s, ids = np.concatenate([before, at]), np.concatenate([self.scores[before, place], scores[at, col]]), np.concatenate([self.ids[before, place], own[col]])
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -s, at))
        at, s, ids = at[order], s[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.top_k
        self.scores[at[kept], rank[kept]], self.ids[at[kept], rank[kept]] = s[kept], ids[kept]


def best_rows(queries: DataFrame, rows: DataFrame, score: Scorer, top_k: int) -> DataFrame:
    """(query_id, id, score, rank): the top_k rows of each query by ``score``, ties by id; the first column of either table is its id, a number or a text (rows without one are left out).

    Queries are gathered into full blocks; a group of blocks of bounded size at a time is broadcast and meets the rows where
    they are read. A task keeps the best rows of each query over all its rows, so what is shuffled is the number of
    tasks times the answers, and the rows themselves never are.
    """
    spark = queries.sparkSession
    queries, rows = (t.where(F.col(t.columns[0]).isNotNull()) for t in (queries, rows))
    kinds = [("string" if t.schema[0].dataType.typeName() == "string" else "long") for t in (queries, rows)]
    q_kind, r_kind = ({"long": pa.int64(), "string": pa.string()}[k] for k in kinds)
    schema = pa.schema([("query_id", q_kind), ("id", r_kind), ("score", pa.float64())])
    ddl = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    asked = query_blocks(queries)

    def meet_with(shared):
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [Best(pa.ipc.open_stream(x).read_all(), top_k, kinds[1] == "string") for x in shared.value]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    r = pa.Table.from_batches([batch.slice(at, ROWS)])
                    own = r.column(0).cast(r_kind).to_pandas().to_numpy()
                    for best in found:
                        best.add(np.round(score(best.queries, r), 6), own)
            for best in found:
                at, col = np.nonzero(np.isfinite(best.scores))
                if len(at):
                    ids = best.queries.column(0).take(pa.array(at)).combine_chunks().cast(q_kind)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(best.ids[at, col], type=r_kind), pa.array(best.scores[at, col])], schema=schema)

        return meet

    parts = []
    for first, last in block_groups([(r.block, r.bytes) for r in asked.select("block", "bytes").collect()]):  # a row a block
        shared = spark.sparkContext.broadcast([bytes(r.asked) for r in asked.where(F.col("block").between(first, last)).sort("block").select("asked").toLocalIterator()])
        found = rows.mapInArrow(meet_with(shared), ddl)
        parts.append(materialize(top_per_key(found, ["query_id"], [F.desc("score"), F.col("id")], top_k), "best"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], f"{ddl}, rank int")
    return reduce(DataFrame.unionAll, parts)
