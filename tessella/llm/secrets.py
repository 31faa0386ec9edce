"""Secret scans: three patterns, and a token-efficiency test for random strings.

A random string breaks into many short tokens under a vocabulary learnt from natural text. A run of key characters with
few characters per token is taken for a secret unless it is a known digest (a hex run of a digest's length) or an
identifier (a UUID, a number, a date or a name made of words).
"""

from __future__ import annotations

import base64
import re
from functools import cache, partial

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Maximal hex runs of 32 or more characters: what is left of all maximal runs after dropping shorter ones.
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Words, numbers, and either joined by separators: names, dates, counters, rules of dashes. A run is cut at its separators
#: first, so that no part is tried in more than one way.
SEPARATORS = re.compile(r"[/_=+-]+")
WORD = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+")
#: Characters per token below which a run counts as random. Hex and base-62 runs have 1.3 to 1.7, run-together words over 2.2.
MAX_CHARS_PER_TOKEN = 2.0
PLACEHOLDER = "[SECRET]"


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    first, *rest = SEPARATORS.split(run)
    return bool(rest) and all(not part or WORD.fullmatch(part) for part in (first, *rest))


def is_known(run: str) -> bool:
    return bool(len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run) or UUID.fullmatch(run) or run.isdigit() or is_identifier(run))


def find_secrets(text: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) in code points, sorted. Random runs that overlap a pattern's span are left to the pattern."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = list(CANDIDATE.finditer(text))
    if runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        based, at, reach = sorted(found), 0, -1
        for m in runs:
            a, b = m.span()
            while at < len(based) and based[at][0] < b:  # reach: where the farthest of all spans that start before b ends
                reach, at = max(reach, based[at][2]), at + 1
            if reach > a or is_known(m[0]):
                continue
            if b - a <= most * len(encoding(vocabulary).encode_ordinary(m[0])):
                found.append((a, 3, b))
    return sorted(found)


def redact(text: str, vocabulary: str, most: float = MAX_CHARS_PER_TOKEN) -> str:
    """The text with every found span, or run of overlapping spans, replaced by a placeholder."""
    out, at = [], 0
    for start, _, end in find_secrets(text, vocabulary, most):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*out, text[at:]]) if out else text


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def secret_spans(text: Column | str, vocabulary: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> Column:
    """array<struct<start, kind, end>> of a text's secrets, kind an index into KINDS; empty for a null text."""
    find = partial(find_secrets, vocabulary=vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), most=most)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in find(t.as_py() or "")] for t in texts], type=kind)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, SPANS)(text)


def redacted(text: Column | str, vocabulary: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> Column:
    """The text without its secrets; null stays null."""
    clean = partial(redact, vocabulary=vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), most=most)

    def scrub(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else clean(t) for x in texts], type=pa.string())

    scrub.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scrub, T.StringType())(text)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the secrets of its whole text.

    Null and empty texts have none; very long texts are read whole, in time linear in their length; repeated rows and ids
    each give a row; an empty table stays empty; other columns, whatever their names, are ignored.
    """
    return docs.select("doc_id", secret_spans("text").alias("found"))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    base = _joined(F.filter("found", lambda s: s.kind < 3))
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
