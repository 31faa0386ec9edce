"""Counts of terms over a whole table, with each task's counts merged before the shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that a task holds before it hands on what it has.
HELD = 200_000


def term_counts(texts: DataFrame, terms: Callable[[bytes], list[bytes]], column: str = "text", classes: str | None = None) -> DataFrame:
    """(term binary, n long) summed over all rows of ``column``; with ``classes``, a 0/1 column, also n1 for the rows at 1.

    ``terms`` gives the terms of a text as they are to be counted (a set for document frequencies).
    """
    chosen = texts.select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text"), (F.col(classes) if classes else F.lit(0)).cast("int").alias("cls"))
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64()), ("n1", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, ones = Counter(), Counter()

        def flush():
            keys = list(both)
            out = pa.RecordBatch.from_pydict({"term": keys, "n": [both[k] for k in keys], "n1": [ones[k] for k in keys]}, schema=schema)
            both.clear()
            ones.clear()
            return out

        for batch in batches:
            for text, cls in zip(batch.column("text"), batch.column("cls").to_pylist(), strict=True):
                found = terms(text.as_py())
                both.update(found)
                if cls:
                    ones.update(found)
                if len(both) > HELD:
                    yield flush()
        yield flush()

    counted = chosen.mapInArrow(count, "term binary, n long, n1 long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    return counted if classes else counted.select("term", "n")
