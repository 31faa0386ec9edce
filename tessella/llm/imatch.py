"""I-Match fingerprints: the distinct terms of a text in a band of inverse document frequency, sorted, and hashed once for
each of several random subsets of that lexicon.

A subset of which a text holds few terms keeps its hash under small edits; the subsets come in four sizes, so that short
and long texts both have some. The likeness of two fingerprints is the share of equal hashes among the subsets of which
either text has terms.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.ordering import bucket_bounds, bucket_of
from tessella.llm.termcounts import term_counts
from tessella.runtime import materialize

#: Band of document shares: idf between ln(1 / 0.2) and ln(1 / 0.0005). A lexicon has at most (terms a text) / 0.0005 terms.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: (share of the lexicon in a subset, subsets of that share).
SUBSETS = ((1 / 8, 8), (1 / 32, 12), (1 / 128, 20), (1 / 512, 24))
LIMITS = [int(share * 2**64) for share, n in SUBSETS for _ in range(n)]
DIGITS = 16  # hex digits of a subset's hash
EMPTY = "." * DIGITS
#: Terms of the lexicon at most, which bounds what is broadcast: where the band holds more, those of least hash, which is a
#: random lexicon like the subsets drawn from it.
MOST_TERMS = 1_000_000


def terms_of(text: bytes) -> set[bytes]:
    return set(text.lower().split())


@lru_cache(200_000)
def subsets_of(term: bytes) -> tuple[int, ...]:
    """The subsets that hold a term, by a hash seeded with the subset's number."""
    return tuple(k for k, limit in enumerate(LIMITS) if xxhash.xxh64_intdigest(term, k) < limit)


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> frozenset[bytes]:
    """Terms in the band, over all documents: all of them, or MOST_TERMS drawn by hash."""
    n = docs.count()
    df = term_counts(docs, terms_of)
    band = materialize(df.where((F.col("n") >= math.ceil(least * n)) & (F.col("n") <= most * n)).select("term"), "lexicon")
    if band.count() > MOST_TERMS:
        band = band.orderBy(F.xxhash64("term"), "term").limit(MOST_TERMS)
    return frozenset(bytes(r.term) for r in band.toLocalIterator())


def fingerprint(text: str, words: frozenset[bytes]) -> str:
    """DIGITS hex digits a subset, dots where the text has no term of it. Texts without a term in the band use all their terms."""
    distinct = sorted(terms_of(text.encode()))
    held: dict[int, list[bytes]] = {}
    for term in [t for t in distinct if t in words] or distinct:
        for k in subsets_of(term):
            held.setdefault(k, []).append(term)
    return "".join(xxhash.xxh64_hexdigest(b" ".join(held[k])) if k in held else EMPTY for k in range(len(LIMITS)))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, len(a), DIGITS)]
    either = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(either) / len(either)


def fingerprint_column(text: Column | str, words: frozenset[bytes], spark) -> Column:
    """Fingerprints of a text column under a lexicon; a null text counts as empty."""
    shared = spark.sparkContext.broadcast(words)

    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "", shared.value) for t in texts])

    hashes.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashes, T.StringType())(text)


def edited(text: str, after: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``after``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its edited text and its next document, in descending doc_id order, the last followed by the first.

    Null texts are empty; very long texts are read whole; null ids come last, ties go by text; repeated rows follow each other; an only document is its
    own next; an empty table stays empty; other columns, whatever their names, are ignored. Ids are integers. Documents are dealt by ranges of ids; the first of each range is also sent to
    the range before it, which lacks no neighbour then.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs))
    bounds = bucket_bounds(docs)
    own = bucket_of("doc_id", bounds)
    firsts = {r.b: r.first for r in docs.select(own.alias("b"), "doc_id").groupBy("b").agg(F.max("doc_id").alias("first")).collect()}  # a row a bucket
    falling = sorted(firsts, reverse=True)
    lends = {firsts[lender]: borrower for lender, borrower in zip(falling[1:] + falling[:1], falling, strict=True)}

    def lent(ids: pa.Array) -> pa.Array:
        return pa.array([lends.get(i) for i in ids.to_pylist()], type=pa.int32())

    lent.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    places = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("extra")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("extra")))))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("to", F.arrow_udf(lent, T.IntegerType())("doc_id"))
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.extra")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before, closed = shared.value, None, None
        for batch in batches:
            out = []
            for doc_id, text, bucket, extra in zip(*(batch.column(c) for c in ("doc_id", "text", "bucket", "extra")), strict=True):
                bucket, extra = bucket.as_py(), extra.as_py()
                if bucket == closed:  # a second copy of the lent row
                    continue
                text = text.as_py()
                print_ = fingerprint(text, words)
                if before:
                    i, t, p = before
                    e = edited(t, text)
                    q = fingerprint(e, words)
                    out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, likeness(p, q), likeness(p, print_)))
                before = None if extra else (doc_id.as_py(), text, print_)
                closed = bucket if extra else None
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, (_, kind) in zip(zip(*out, strict=True) if out else [[]] * len(fields), fields, strict=True)], schema=schema)

    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
