"""Phrase collocations by dynamic itemset counting, and their scores by the weakest cut.

Texts are dealt into shards, which are scanned in a cycle. All lengths are counted in the same scan: single words from the
first shard on, a longer phrase from the shard after the one in which both of its subphrases (all but its last and all but
its first word) have been seen ``least`` times. Each phrase is counted over one full cycle, whatever shard it starts with, so its
count is exact when it ends.

Tasks look up when a phrase reached the threshold in a table of SLOTS bytes, a Bloom filter that holds steps in place of
bits. A false answer only starts a phrase's cycle earlier: it is counted over all shards just the same, and the count
alone decides. So no set of phrases is broadcast, and counts are exact at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytewords import BETWEEN_PIECES, BETWEEN_WORDS, IN_WORD, split_bytes
from tessella.operators.relational import top_per_key
from tessella.runtime import materialize, shared_path

SHARDS, LEAST, LONGEST, TOP = 2, 30, 4, 2000
#: Bytes of the table of steps, which is broadcast at each step; more keep it sparse where over a few million phrases are frequent.
SLOTS = 1 << 24
NEVER = 255
#: Bytes of text of one language that a task counts at once.
CHUNK = 2 << 20
#: Copies of the counts that phrases look up their parts in, so that a common first word is not one key.
SALTS = 8

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.full(256, IN_WORD, dtype=np.uint8)
_KIND[list(b" \t")] = BETWEEN_WORDS
_KIND[list(_BREAKS)] = BETWEEN_PIECES
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

COUNTED = pa.schema([("key", pa.string()), ("n", pa.int64())])
CHUNKS = pa.schema([("lang", pa.string()), ("codes", pa.binary()), ("words", pa.binary()), ("shard", pa.int32())])


def split_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words in order, the words by code, and the number of the piece that each is in."""
    raw, codes, words, starts, _ = split_bytes(b"\n".join(texts), _KIND)
    return codes, words, np.cumsum(_KIND[raw] == BETWEEN_PIECES)[starts]


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def longer_hash(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last."""
    return (head ^ (head >> np.uint64(31))) * _FACTOR + last


def slots_of(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    x = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return (x & np.uint64(slots - 1)).astype(np.int64), (x >> np.uint64(35) & np.uint64(slots - 1)).astype(np.int64)


def reached_at(hashes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The step after which phrases were frequent, or one before; NEVER if they are not."""
    a, b = slots_of(hashes, len(steps))
    return np.maximum(steps[a], steps[b])


def distinct_grams(codes: np.ndarray, at: np.ndarray, size: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases that start at ``at``: where one of each kind starts, and how many there are."""
    ids, span = codes[at].astype(np.int64), words
    for i in range(1, size):
        if span * words >= 1 << 62:
            ids, known = pd.factorize(ids)
            span = len(known)
        ids, span = ids * words + codes[at + i], span * words
    kinds, known = pd.factorize(ids)
    first = np.empty(len(known), dtype=np.int64)
    first[kinds[::-1]] = at[::-1]
    return first, np.bincount(kinds, minlength=len(known))


def coded_chunks(docs: DataFrame, cycle: int, chunk: int) -> DataFrame:
    """(lang, codes, words, shard): texts of a language by about ``chunk`` bytes, as the words' codes and the words by code.

    A code is doubled, and odd for the first word of a piece. Texts are dealt to shards in turn.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, turn = {}, {}, 0

        def flush(lang: str, shard: int) -> pa.RecordBatch:
            codes, words, piece = split_words(waiting.pop((lang, shard)))
            doubled = codes.astype(np.int32) * 2 + (np.diff(piece, prepend=-1) != 0)
            return pa.RecordBatch.from_pydict({"lang": [lang], "codes": [doubled.astype("<i4").tobytes()], "words": [b" ".join(words.to_pylist())], "shard": [shard]}, schema=CHUNKS)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw, k = text.as_buffer().to_pybytes(), (lang, turn % cycle)
                turn += 1
                waiting.setdefault(k, []).append(raw)
                held[k] = held.get(k, 0) + len(raw)
                if held[k] >= chunk:
                    yield flush(*k)
                    held[k] = 0
                if len(waiting) > 64:  # many languages: none waits for long
                    for k in list(waiting):
                        yield flush(*k)
                    held.clear()
        for k in list(waiting):
            yield flush(*k)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(code, "lang string, codes binary, words binary, shard int")


def count_chunk(codes: np.ndarray, words: list[bytes], lang: str, step: int, cycle: int, steps: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(key, n) of the phrases of a chunk that are active in this step, and the number of its words as a phrase of size 0.

    A key is the start of the cycle and the size, a character each, the phrase, and the language: see ``read_key``.
    """
    piece, codes = np.cumsum(codes & 1), codes >> 1
    n, table = len(codes), pa.array(words, pa.large_binary())
    space, end = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"\t" + lang.encode(), pa.large_binary())

    def rows(starts: np.ndarray, size: int, parts: list[pa.Array], counts: np.ndarray) -> pa.RecordBatch:
        heads = pa.array([f"{chr(33 + i)}{size}".encode() for i in range(int(starts.max()) + 1)], pa.large_binary())
        keys = pc.binary_join_element_wise(heads.take(pa.array(starts)), *parts, end, space)
        return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(counts, type=pa.int64())], schema=COUNTED)

    if not n:
        return
    if step < cycle:
        yield rows(np.zeros(1, dtype=np.int16), 0, [pa.array([b""], pa.large_binary())], np.array([n]))
        yield rows(np.zeros(len(words), dtype=np.int16), 1, [table], np.bincount(codes, minlength=len(words)))
    own = word_hashes(words, lang)
    last = hashes = own[codes]
    reach = reached_at(own, steps)[codes].astype(np.int16)
    for size in range(2, min(longest, n) + 1):
        start = np.maximum(reach[:-1], reach[1:]) + 1  # reach: of the phrases one shorter
        start[piece[size - 1 :] != piece[: n - size + 1]] = NEVER + 1
        known = start <= NEVER
        at = np.flatnonzero(known & (start <= step) & (step < start + cycle))
        if len(at):
            first, counts = distinct_grams(codes, at, size, len(words))
            yield rows(start[first], size, [table.take(pa.array(codes[first + i])) for i in range(size)], counts)
        if size == longest or not known.any():
            break
        hashes = longer_hash(hashes[:-1], last[size - 1 :])
        reach = np.full(len(start), NEVER, dtype=np.int16)
        reach[known] = np.maximum(reached_at(hashes[known], steps), start[known] - 1)


def read_key(key: str = "key") -> dict[str, Column]:
    """The parts of a key."""
    phrase = F.expr(f"substring({key}, 4, locate(' \t', {key}) - 4)")
    lang = F.expr(f"substring({key}, locate(' \t', {key}) + 2)")
    return {"start": F.ascii(key) - 33, "size": F.ascii(F.substring(key, 2, 1)) - 48, "phrase": phrase, "lang": lang}


def count_shard(shard: DataFrame, step: int, cycle: int, steps, longest: int) -> DataFrame:
    """(key, n) of each chunk of a shard; ``steps`` is the broadcast table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, words in zip(*(batch.column(c) for c in ("lang", "codes", "words")), strict=True):
                known = words.as_py().split(b" ")
                yield from count_chunk(np.frombuffer(codes.as_buffer(), dtype="<i4"), known, lang.as_py(), step, cycle, steps.value, longest)

    return shard.select("lang", "codes", "words").mapInArrow(count, "key string, n long")


def mark_reached(phrases: DataFrame, steps: np.ndarray, step: int) -> bool:
    """Set the slots of newly frequent phrases (lang, phrase); at most all of the table's slots reach the driver, by pages. False if there are none."""
    slots = len(steps)
    page = min(slots, 1 << 16)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                each = word_hashes(phrase.encode().split(b" "), lang)
                whole = each[:1]
                for i in range(1, len(each)):
                    whole = longer_hash(whole, each[i : i + 1])
                found += [int(x[0]) for x in slots_of(whole, slots)]
            found = np.unique(np.array(found, dtype=np.int64))
            yield pa.RecordBatch.from_pydict({"page": pa.array(found // page, pa.int32()), "at": pa.array(found % page, pa.int32())})

    pages = phrases.select("lang", "phrase").mapInArrow(find, "page int, at int").groupBy("page").agg(F.collect_set("at").alias("at"))
    any_ = False
    for r in pages.toLocalIterator():
        at = r.page * page + np.array(r.at, dtype=np.int64)
        steps[at] = np.minimum(steps[at], step)
        any_ = True
    return any_


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cycle: int = SHARDS, slots: int = SLOTS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all phrases of up to ``longest`` words seen ``least`` times in a language, (lang, n) with its number of words).

    Null texts count as empty, null languages as ``und``; very long texts are counted whole, repeated rows each time; an
    empty table gives empty tables; other columns, whatever their names, are ignored.
    """
    if longest * cycle > 90 or longest > 9:
        raise ValueError("too many steps or too long phrases for a key")
    spark = docs.sparkSession
    path = shared_path(spark, "shards")
    coded_chunks(docs, cycle, chunk).write.partitionBy("shard").parquet(path)
    shards = spark.read.schema("lang string, codes binary, words binary, shard int").parquet(path)
    steps = np.full(slots, NEVER, dtype=np.uint8)
    part = read_key()
    ends, frequent = part["start"] + (cycle - 1), F.col("n") >= least
    state, done, sizes, step, last = None, [], None, 0, cycle - 1
    while step <= last:
        shared = spark.sparkContext.broadcast(steps)
        now = count_shard(shards.where(F.col("shard") == step % cycle), step, cycle, shared, longest).withColumn("reached", F.lit(False))
        now = now if state is None else now.unionByName(state)
        counts = now.groupBy("key").agg(F.sum("n").alias("n"), F.max("reached").alias("reached"))
        counts = materialize(counts.where((ends > step) | frequent | (part["size"] == 0)), "counts")
        shared.destroy()
        ended = counts.where(ends == step)
        done.append(ended.where(part["size"] > 0).select(part["lang"].alias("lang"), part["size"].alias("size"), part["phrase"].alias("phrase"), F.col("n").alias("f")))
        if step == cycle - 1:
            sizes = ended.where(part["size"] == 0).select(part["lang"].alias("lang"), "n")
        state = counts.where(ends > step).withColumn("reached", frequent)
        fresh = counts.where(frequent & ~F.col("reached") & part["size"].between(1, longest - 1))
        if mark_reached(fresh.select(part["lang"].alias("lang"), part["phrase"].alias("phrase")), steps, step):
            last = max(last, step + cycle)
        step += 1
    return materialize(reduce(DataFrame.unionByName, done), "phrases"), sizes


def _whole(c: str):
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, covered: int = 80, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases; odd rows as in ``frequent_phrases``.

    A phrase's score is floor(2000000 a / (l + r)) at its weakest cut, in decimals of 38 digits. A phrase goes where a longer
    one that holds it has at least ``covered`` percent of its count.
    """
    phrases, sizes = frequent_phrases(docs, least=least, **how)
    candidates = phrases.where("size > 1").withColumn("w", F.split("phrase", " ", -1))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")
    )
    held = phrases.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    cuts = cuts.join(held.select("lang", "salt", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "salt", "first"])
    cuts = cuts.join(held.select("lang", "salt", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "salt", "rest"])
    cuts = cuts.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))
    longer = candidates.where("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * _whole("held") < covered * _whole("a")))
    best = top_per_key(kept.drop("held"), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, s.s AS size, unnest(list_transform(range(1, len(w) - s.s + 2), lambda i: array_to_string(w[i:i + s.s - 1], ' '))) AS phrase FROM worded, (SELECT unnest([1, 2, 3, 4]) AS s) s),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.phrase, c.size, c.f AS a, c.w, k.k FROM f c, (SELECT unnest([1, 2, 3]) AS k) k WHERE k.k < c.size),
scores AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f), c.k) AS at
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
longer AS (SELECT lang, phrase, max(f) AS held FROM (SELECT lang, f, unnest(list_transform(range(1, size - s.s + 2), lambda i: array_to_string(w[i:i + s.s - 1], ' '))) AS phrase FROM f, (SELECT unnest([2, 3]) AS s) s WHERE s.s < size) GROUP BY lang, phrase),
ranked AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, s.score
    FROM scores s LEFT JOIN longer h ON h.lang = s.lang AND h.phrase = s.phrase WHERE s.at = 1 AND (h.held IS NULL OR 100 * CAST(h.held AS HUGEINT) < 80 * CAST(s.a AS HUGEINT)))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
