"""Embeddings of texts by signed feature hashing: words and their character trigrams, into a fixed width.

No model and no vocabulary are kept, so vectors of one width made anywhere compare with each other.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import TERM

#: Width of each named embedding.
DIMENSIONS = {"hash-64": 64, "hash-128": 128, "hash-256": 256, "hash-1024": 1024}
DEFAULT = "hash-256"


def dimension(model: str) -> int:
    """Width of an embedding's vectors, for columns and checks; an unknown name is an error."""
    if model not in DIMENSIONS:
        raise ValueError(f"no embedding {model}; there are {', '.join(DIMENSIONS)}")
    return DIMENSIONS[model]


def word_features(word: str) -> list[str]:
    """A word and the trigrams of the word with a mark at either end."""
    marked = f"^{word}$"
    return [word, *(marked[i : i + 3] for i in range(len(marked) - 2))]


@lru_cache(200_000)
def word_slots(word: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signs of a word's features: the first eight hex digits of a feature's MD5, by the width; the ninth's lowest bit."""
    digests = [hashlib.md5(f.encode(), usedforsecurity=False).hexdigest() for f in word_features(word)]
    return np.array([int(d[:8], 16) % width for d in digests]), np.array([1.0 - 2.0 * (int(d[8], 16) & 1) for d in digests])


def count_features(text: str | None, width: int) -> np.ndarray:
    """Signed counts of a text's features by slot."""
    out = np.zeros(width)
    for word, n in Counter(re.findall(TERM, (text or "").lower())).items():
        slots, signs = word_slots(word, width)
        np.add.at(out, slots, n * signs)
    return out


def embed_text(text: str | None, width: int) -> np.ndarray:
    out = count_features(text, width)
    length = np.sqrt(out @ out)
    return out / length if length else out


def _vectors(text: Column | str, width: int, kind: np.dtype, spark_type: T.DataType, vector) -> Column:
    def embed(texts: pa.Array) -> pa.Array:
        rows = [vector(t.as_py(), width) for t in texts]
        flat = np.concatenate(rows).astype(kind) if rows else np.zeros(0, kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(flat))

    embed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(embed, T.ArrayType(spark_type))(text)


def embedded(text: Column | str, model: str = DEFAULT) -> Column:
    """array<float> of length 1; all zeros for a null text or one without a word."""
    return _vectors(text, dimension(model), np.float32, T.FloatType(), embed_text)


def hashed_counts(text: Column | str, width: int) -> Column:
    """array<long>: the whole-number counts that ``embedded`` scales."""
    return _vectors(text, width, np.int64, T.LongType(), count_features)
