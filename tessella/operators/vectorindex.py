"""An index of vectors by cells: a search reads the cells nearest to its queries only.

The index is a folder: ``cells`` holds the centroids, fitted on a sample of at most SAMPLE vectors, and ``rows`` every vector
under the partition of its nearest centroid. How many cells a query probes is measured when the index is built, on
vectors of the sample: as many as hold WANTED of their true nearest rows. Vectors without length are not filed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.blocks import best_rows
from tessella.operators.retrieval import unit_rows

SAMPLE, TRIALS, ROUNDS, WANTED = 20_000, 200, 15, 0.97
MOST_CELLS = 4096


def sampled_units(vectors: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Unit vectors of at most ``most`` rows drawn by a hash of the id, whatever the number of rows."""
    drawn = vectors.where(F.size("vector") > 0).withColumn("draw", F.xxhash64("id")).orderBy("draw", F.col("id")).limit(most)
    lists = drawn.select("vector").toArrow().column(0)
    widths = lists.combine_chunks().value_lengths().to_numpy()
    units = unit_rows(lists, int(np.bincount(widths).argmax()) if len(widths) else 0)
    return units[~np.isnan(units).any(axis=1)]


def fit_cells(units: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 by k-means on the sphere, from evenly drawn starts; a cell that loses its rows takes the row least near to any."""
    centroids = units[np.linspace(0, len(units) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = units @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        held = np.bincount(own, minlength=cells)
        worst = np.argsort(near.max(axis=1), kind="stable")
        for i, cell in enumerate(np.flatnonzero(held == 0)):
            sums[cell] = units[worst[i % len(units)]]
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 0, sums / np.where(lengths > 0, lengths, 1.0), centroids)
    return centroids


def cells_to_probe(units: np.ndarray, centroids: np.ndarray, top_k: int = 10, wanted: float = WANTED, trials: int = TRIALS) -> int:
    """How many cells, nearest first, hold ``wanted`` of the nearest rows of trial vectors."""
    tried = units[:: max(1, len(units) // trials)][:trials]
    own = (units @ centroids.T).argmax(axis=1)
    s = tried @ units.T
    s[s > 1 - 1e-9] = -np.inf  # itself
    true = np.argsort(-s, axis=1)[:, : min(top_k, max(1, len(units) - 1))]
    rank = np.argsort(np.argsort(-(tried @ centroids.T), axis=1), axis=1)
    return int(np.quantile(np.take_along_axis(rank, own[true], axis=1), wanted, method="higher")) + 1


def _filed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, vector, cell) of the vectors that have a length and the index's width."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = vectors.schema["id"].dataType.simpleString()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(pa.chunked_array([batch.column(1)]), shared.value.shape[1])
            kept = ~np.isnan(units).any(axis=1)
            cell = (units[kept] @ shared.value.T).argmax(axis=1)
            some = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    return vectors.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(file, f"id {kind}, vector array<float>, cell int")


def _write(filed: DataFrame, path: str, mode: str) -> None:
    # rebalanced: a crowded cell goes to several tasks and files, small cells share a task
    filed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def build_index(vectors: DataFrame, path: str, cells: int | None = None, top_k: int = 10, wanted: float = WANTED) -> None:
    """Write the index of (id, vector) rows; the square root of their number is the default number of cells."""
    v = vectors.select(F.col(vectors.columns[0]).alias("id"), F.col(vectors.columns[1]).alias("vector"))
    units = sampled_units(v)
    if not len(units):
        raise ValueError("no vector has a length")
    cells = min(cells or round(v.count() ** 0.5), MOST_CELLS, len(units))
    centroids = fit_cells(units, max(1, cells))
    probes = cells_to_probe(units, centroids, top_k, wanted)
    table = v.sparkSession.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centroids)], "cell int, centroid array<double>, probes int")
    table.coalesce(1).write.parquet(f"{path}/cells")
    _write(_filed(v, centroids), path, "overwrite")


def read_cells(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/cells").sort("cell").collect()  # at most MOST_CELLS
    return np.array([r.centroid for r in rows]), rows[0].probes


def add_to_index(vectors: DataFrame, path: str) -> None:
    """File more rows under the cells that are there."""
    v = vectors.select(F.col(vectors.columns[0]).alias("id"), F.col(vectors.columns[1]).alias("vector"))
    _write(_filed(v, read_cells(v.sparkSession, path)[0]), path, "append")


def _probed(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cells) of the queries; cells are the nearest ``probes``."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    kind = queries.schema["id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(pa.chunked_array([batch.column(1)]), shared.value.shape[1])
            kept = ~np.isnan(units).any(axis=1)
            s = units[kept] @ shared.value.T
            cells = np.sort(np.argsort(-s, axis=1, kind="stable")[:, :probes], axis=1).astype(np.int32)
            some = batch.filter(pa.array(kept))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["id", "vector", "cells"])

    return queries.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(near, f"id {kind}, vector array<float>, cells array<int>")


def _cell_scores(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """Cosines of the rows in cells that a query probes."""
    out = np.full((queries.num_rows, rows.num_rows), -np.inf)
    lists = queries.column(2).combine_chunks()
    if not queries.num_rows:
        return out
    probed = lists.flatten().to_numpy().reshape(queries.num_rows, -1)
    width = int(queries.column(1).combine_chunks().value_lengths()[0].as_py())
    q, r = unit_rows(queries.column(1), width), unit_rows(rows.column(1), width)
    own = rows.column(2).to_numpy()
    for cell in np.unique(own):
        asking, held = np.flatnonzero((probed == cell).any(axis=1)), np.flatnonzero(own == cell)
        out[np.ix_(asking, held)] = q[asking] @ r[held].T
    same = queries.column(0).to_numpy()[:, None] == rows.column(0).to_numpy()[None, :]
    out[same | np.isnan(out)] = -np.inf
    return out


def probed_rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Rows of the cells that any query probes; Spark lists and reads only these partitions."""
    wanted = sorted(r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())  # at most MOST_CELLS
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(wanted)).select("id", "vector", F.col("cell").cast("int").alias("cell"))


def search_index(queries: DataFrame, path: str, top_k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of (id, vector) queries over the indexed rows, the query's own id left out.

    ``probes`` is as measured by default; as many as there are cells give the exact search.
    """
    spark = queries.sparkSession
    centroids, measured = read_cells(spark, path)
    q = queries.select(F.col(queries.columns[0]).alias("id"), F.col(queries.columns[1]).alias("vector"))
    asked = _probed(q, centroids, min(probes or measured, len(centroids)))
    return best_rows(asked, probed_rows(spark, path, asked), _cell_scores, top_k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results (query_id, id) that were found."""
    both, wanted = found.join(exact, ["query_id", "id"], "left_semi").count(), exact.count()
    return both / wanted if wanted else 1.0
