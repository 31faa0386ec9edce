"""Words of many texts at once, by a table of what each byte is; a task's texts are split without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

IN_WORD, BETWEEN_WORDS, BETWEEN_PIECES = 0, 1, 2
_UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def split_bytes(text: bytes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, the code of each word, the words by code, and where each word starts and ends.

    ``kind`` gives what each of the 256 bytes is: words are longest runs of IN_WORD.
    """
    raw = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    inside = kind[raw] == IN_WORD
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    return raw, words.indices.to_numpy(), words.dictionary, starts, ends
