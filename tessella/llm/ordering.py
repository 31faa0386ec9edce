"""Documents in doc_id order over many tasks: range buckets that follow each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a bucket: more rows make more buckets.
BUCKET_ROWS = 100_000


def bucket_bounds(docs: DataFrame, buckets: int | None = None) -> np.ndarray:
    """Ids that start buckets 1, 2, ..., from the doc_id column alone: one for each shuffle partition or BUCKET_ROWS rows, whichever are more."""
    n = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // BUCKET_ROWS))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0] or []
    return np.unique(np.array(found, dtype=np.int64))


def bucket_of(doc_id: Column | str, bounds: np.ndarray) -> Column:
    """The bucket of an id; null ids come first, in bucket 0."""

    def find(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
        return pa.array(at.astype(np.int32))

    find.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, T.IntegerType())(doc_id)
