"""Products of sparse term vectors, many queries by many rows at once: common terms as a dense matrix, the others by postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The terms of most queries of a block that are multiplied as a matrix.
DENSE = 512


def _values(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of the entries of a list column; null lists are empty."""
    whole = lists.combine_chunks()
    return pc.list_parent_indices(whole).to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


class TermMatrix:
    """Weighted terms of a block of queries, each once a query, made once and met with blocks of rows."""

    def __init__(self, terms: pa.ChunkedArray, weights: pa.ChunkedArray | None = None):
        at, values = _values(terms)
        known = values.dictionary_encode()
        code, self.vocabulary = known.indices.to_numpy(zero_copy_only=False).astype(np.int64), known.dictionary
        weight = np.ones(len(at)) if weights is None else _values(weights)[1].to_numpy(zero_copy_only=False).astype(np.float64)
        self.queries, kind = len(terms), np.float32 if weights is None else np.float64  # whole numbers are exact in either
        held = np.bincount(code, minlength=len(self.vocabulary))
        common = np.argsort(-held, kind="stable")[:DENSE]
        self.place = np.full(len(self.vocabulary), -1)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((self.queries, len(common)), dtype=kind)
        inside = self.place[code] >= 0
        self.dense[at[inside], self.place[code[inside]]] = weight[inside]
        order = np.argsort(code, kind="stable")
        self.start, self.held, self.at, self.weight = np.cumsum(held) - held, held, at[order], weight[order]

    def coded(self, terms: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among all entries, row, code) of the entries that any query holds."""
        at, values = _values(terms)
        found = pc.index_in(values, value_set=self.vocabulary)
        kept = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        return kept, at[kept], found.take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, out: np.ndarray, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        """Add the products of these entries to out[query, row] one by one."""
        n, flat = self.held[code], out.reshape(-1)
        for part in np.array_split(np.arange(len(code)), max(1, int(n.sum()) >> 22)):  # bounded memory
            k = n[part]
            entry = np.repeat(part, k)
            posting = np.arange(len(entry)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.start[code[part]], k)
            np.add.at(flat, self.at[posting] * out.shape[1] + row[entry], (self.weight[posting] * weight[entry]).astype(out.dtype))

    def products(self, rows: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """out[query, row]: sums of the products of the weights of common terms."""
        place = self.place[code]
        inside = place >= 0
        dense = np.zeros((rows, self.dense.shape[1]), dtype=self.dense.dtype)
        dense[row[inside], place[inside]] = weight[inside]
        out = self.dense @ dense.T
        self.add(out, row[~inside], code[~inside], weight[~inside])
        return out


def by_parts(score, size: int = 512):
    """A scorer that takes ``size`` rows at a time, so that what it works with stays small beside the scores themselves."""

    def whole(queries: pa.Table, rows: pa.Table) -> np.ndarray:
        out = np.empty((queries.num_rows, rows.num_rows))
        for at in range(0, rows.num_rows, size):
            out[:, at : at + size] = score(queries, rows.slice(at, size))
        return out

    return whole


def kept_matrices(make):
    """``make(queries)``, once for each block of queries that a task meets again and again."""
    known: dict[int, tuple[pa.Table, object]] = {}

    def of(queries: pa.Table):
        if id(queries) not in known:
            known[id(queries)] = queries, make(queries)  # the block is held, so its id stays its own
        return known[id(queries)][1]

    return of
