"""Byte-level BPE token ids by the tokenizers library, with a bounded memory of pieces.

The library's own splitting of a text costs more than the merges do. A text of common characters is cut into pieces by
the vocabulary's published splitting pattern, written out for these characters, and each piece's ids, made by the
library's BPE model at first sight, are remembered. Other texts go through the library in parts or whole, and so do texts
that hold an added token such as <|endoftext|>, and all texts under a tokenizer that is not plain byte-level BPE.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"
#: A space before a visible character always starts a new piece of byte-level BPE's own splitting, so encoding the parts
#: of a text split there gives the ids of the whole.
SPLIT = re.compile(r" (?=\S)")
#: Parts of common characters only: ASCII and Latin letters and marks, without rare white space and control characters.
COMMON = re.compile(r"[\t\n\r -~¡-ɏ]*")
#: Pieces that a task remembers, twice over, and the longest of them: under 150 MB.
REMEMBERED, LONGEST = 300_000, 64


def _of_kind(kind: str) -> str:
    """The common characters of a Unicode category, as a run for a character class."""
    return "".join(re.escape(chr(i)) for i in [*range(0x21, 0x7F), *range(0xA1, 0x250)] if unicodedata.category(chr(i))[0] == kind)


#: The published pattern (public_tokenizers.PATTERN) for common characters, its most frequent cases first.
PIECES = re.compile(rf" ?[{_of_kind('L')}]+|'(?:[stmd]|re|ve|ll)| ?[^\t\n\r {_of_kind('L')}{_of_kind('N')}]+| ?[{_of_kind('N')}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
#: What plain byte-level BPE has in its file: anything else goes through the library whole.
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: visible Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


LETTERS = _byte_letters()


def is_plain(settings: dict) -> bool:
    """Whether a tokenizer file splits and merges as this module does."""
    split, model = settings.get("pre_tokenizer") or {}, settings["model"]
    return not settings.get("normalizer") and all(split.get(k) == v for k, v in PLAIN_SPLIT.items()) and all(model.get(k, v) == v for k, v in PLAIN_MODEL.items())


class Remembered(dict):
    """Values made at first sight. When full, it starts anew and takes over what is still asked for."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = is_plain(json.loads(self.tokenizer.to_str()))
        #: Strings that the library turns into one id each, wherever a text holds them.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # ours has each piece already
        self.pieces = Remembered(self._piece)

    def _piece(self, piece: str) -> bytes:
        letters = piece.replace(" ", LETTERS[0x20]) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _common(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def raw(self, text: str) -> bytes:
        """Token ids of a whole text, 32 bits each."""
        if not self.plain or any(a in text for a in self.added):
            return self._whole(text)
        if COMMON.fullmatch(text):
            return self._common(text)
        first, *rest = SPLIT.split(text)
        return b"".join([(self._common if COMMON.fullmatch(p) else self._whole)(p) for p in (first, *(" " + p for p in rest))])

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text as unsigned 32-bit integers."""
        return np.frombuffer(self.raw(text), dtype=np.uint32)


_held: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's own encoder of a vocabulary."""
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


@contextmanager
def task_encoder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder for one task, which forgets its pieces at the end, so that other stages have the memory."""
    found = encoder(path)
    try:
        yield found
    finally:
        found.pieces.older = {}
        found.pieces.clear()


def vocabulary_path(path: str | None = None) -> str:
    return path or public_tokenizers.path(VOCABULARY)
