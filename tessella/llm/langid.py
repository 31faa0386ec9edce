"""Language of each word and text by a linear-chain conditional random field.

The labels of a text's words are one chain. A word speaks for a label by its affixes, its character n-grams and what the
lexicon says of it; transitions between labels are learned too, from sequences that switch between languages. Forward-
backward gives each word's chance of each label given all words of its run, and a text's language is the one with the most
words by expectation.

The lexicon counts every word of every text to learn from. The field itself is fitted on a bounded sample of runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bytewords import BETWEEN_WORDS, IN_WORD, split_bytes
from tessella.operators.relational import top_per_key
from tessella.runtime import materialize

#: A run of words is one chain; texts of more words have several. Every word is in one.
RUN = 64
#: Runs that the field is fitted on: so many texts of each language, so many runs evenly over each.
FIT_TEXTS, FIT_RUNS = 400, 4
FIT_STEPS, RATE, DECAY = 60, 0.2, 1e-5
#: Switches between languages come after this many words on average in the sequences to learn from.
SPAN = 12
#: Rows of the weight table; affixes and n-grams share them by hash.
WEIGHTS = 1 << 16
#: Words that make up this share of a language's words are in the lexicon, so that it has at most 1 / share of each.
LEXICON_SHARE = 1e-5
CHUNK, BLOCKS = 4 << 20, 8192
UNDETERMINED = "und"

_KIND = np.full(256, BETWEEN_WORDS, dtype=np.uint8)  # ASCII letters and all bytes of other characters are in words
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = IN_WORD


def clean(word: bytes) -> str:
    """A word without other characters than letters, in lower case; empty if it has no letter."""
    text = word.decode(errors="replace")
    return text if text.isascii() else "".join(c for c in text.lower() if c.isalpha())


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each word (affixes of one to three characters, n-grams of two and three, with marks at the ends), and where each word's begin."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size)
    starts = ends - size
    of = np.repeat(np.arange(len(words)), size)

    def row(kind: int, *characters: np.ndarray) -> np.ndarray:
        x = np.full(len(characters[0]), kind, dtype=np.uint64)
        for y in characters:
            x = (x ^ y) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(WEIGHTS)).astype(np.int64)

    rows, owners = [], []
    for n in (2, 3):
        at = np.arange(max(len(c) - n + 1, 0))
        at = at[of[at] == of[at + n - 1]]
        rows.append(row(n, *(c[at + i] for i in range(n))))
        owners.append(of[at])
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n + 2)
        for kind, first in ((10 + n, starts[long] + 1), (20 + n, ends[long] - 1 - n)):
            rows.append(row(kind, *(c[first + i] for i in range(n))))
            owners.append(long)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(rows)[order], np.searchsorted(owners[order], np.arange(len(words)))


@dataclass
class Field:
    """What a fitted field consists of; ``lexicon`` holds a row of log odds for each known word."""

    labels: list[str]
    lexicon: dict[str, int]
    odds: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the labels for each word."""
        if not words:
            return np.zeros((0, len(self.labels)))
        rows, starts = word_features(words)
        return np.add.reduceat(self.weights[rows], starts) + self.bias + self.trust * self.lexicon_odds(words)

    def lexicon_odds(self, words: list[str]) -> np.ndarray:
        get = self.lexicon.get
        return self.odds[np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))]  # row 0: unknown


def forward_backward(scores: np.ndarray, transitions: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of the labels of each word (runs, words, labels), expected transitions, and log likelihoods' normalisers.

    ``filled`` marks the words; a run's words come first in its row.
    """
    runs, n, labels = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e = np.where(filled[:, :, None], np.exp(scores - top), 1.0)
    a = np.exp(transitions)
    alpha, scale = np.empty_like(e), np.ones((runs, n))
    now = e[:, 0]
    for t in range(n):
        if t:
            now = np.where(filled[:, t, None], (alpha[:, t - 1] @ a) * e[:, t], alpha[:, t - 1])
        scale[:, t] = now.sum(axis=1)
        alpha[:, t] = now / scale[:, t, None]
    beta = np.ones((runs, labels))
    expected = np.zeros((labels, labels))
    chances = np.empty_like(e)
    chances[:, n - 1] = alpha[:, n - 1]
    for t in range(n - 1, 0, -1):
        on = filled[:, t, None]
        after = e[:, t] * beta / scale[:, t, None]
        expected += (alpha[:, t - 1] * on).T @ (after * on) * a
        beta = np.where(on, after @ a.T, beta)
        chances[:, t - 1] = alpha[:, t - 1] * beta
    return chances, expected, (np.log(scale) + np.where(filled, top[:, :, 0], 0.0)).sum(axis=1)


def mixed_runs(runs: list[tuple[int, list[str]]], seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Sequences with a label for each word: each run by itself, and pairs of runs cut into spans that take turns."""
    rng = np.random.default_rng(seed)
    made = [(words[:RUN], [label] * min(len(words), RUN)) for label, words in runs if words]
    order = rng.permutation(len(runs))
    for i, j in zip(order[::2], order[1::2], strict=False):
        words, labels, at, turn = [], [], [0, 0], 0
        pair = runs[i], runs[j]
        while len(words) < RUN and any(at[k] < len(pair[k][1]) for k in (0, 1)):
            n = 1 + rng.geometric(1 / SPAN)
            label, own = pair[turn]
            part = own[at[turn] : at[turn] + n]
            words += part
            labels += [label] * len(part)
            at[turn] += n
            turn = 1 - turn
        made.append((words[:RUN], labels[:RUN]))
    return [m for m in made if m[0]]


def fit_field(labels: list[str], lexicon: dict[str, int], odds: np.ndarray, runs: list[tuple[int, list[str]]]) -> Field:
    """Maximum likelihood, by adaptive gradient steps over all sequences at once."""
    k = len(labels)
    field = Field(labels, lexicon, odds, np.zeros((WEIGHTS, k)), np.full(k, 0.5), np.zeros(k), np.eye(k) * 2.0)
    made = mixed_runs(runs)
    if k < 2 or not made:
        return field
    types = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in made for w in words))}
    codes, truth = (np.zeros((len(made), RUN), dtype=np.int64) for _ in range(2))
    filled = np.zeros((len(made), RUN), dtype=bool)
    for i, (words, own) in enumerate(made):
        codes[i, : len(words)] = [types[w] for w in words]
        truth[i, : len(words)] = own
        filled[i, : len(words)] = True
    known = list(types)
    rows, starts = word_features(known)
    per_type = np.diff(np.append(starts, len(rows)))
    given = field.lexicon_odds(known)
    flat, total = codes[filled], filled.sum()
    gold = np.zeros((len(known), k))
    np.add.at(gold, (flat, truth[filled]), 1.0)
    both = filled[:, 1:]
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (truth[:, :-1][both], truth[:, 1:][both]), 1.0)
    moments = [np.zeros_like(p) for p in (field.weights, field.trust, field.bias, field.transitions)]
    for _ in range(FIT_STEPS):
        chances, steps, _ = forward_backward(field.emissions(known)[codes], field.transitions, filled)
        got = np.stack([np.bincount(flat, weights=chances[:, :, i][filled], minlength=len(known)) for i in range(k)], axis=1)
        each = (gold - got) / total
        spread = np.repeat(each, per_type, axis=0)
        slopes = [
            np.stack([np.bincount(rows, weights=spread[:, i], minlength=WEIGHTS) for i in range(k)], axis=1) - DECAY * field.weights,
            (each * given).sum(axis=0), each.sum(axis=0), (gold_steps - steps) / total - DECAY * field.transitions,
        ]
        for value, slope, moment in zip((field.weights, field.trust, field.bias, field.transitions), slopes, moments, strict=True):
            moment += slope * slope
            value += RATE * slope / (np.sqrt(moment) + 1e-9)
    return field


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = {}, 0

        def flush():
            for lang, parts in waiting.items():
                _, codes, words, _, _ = split_bytes(b"\n".join(parts), _KIND)
                n = np.bincount(codes, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words)), pa.array([clean(w) for w in words.to_pylist()], pa.string()), pa.array(n, pa.int64())], schema=schema)
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes()
                waiting.setdefault(lang, []).append(raw)
                held += len(raw)
                if held >= CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    return texts.select("lang", "text").mapInArrow(count, "lang string, word string, n long").where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Labels, rows of words and log odds of each label against the mean of all; only words of the share that LEXICON_SHARE asks reach the driver."""
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    labels = sorted(totals)
    at = {x: i for i, x in enumerate(labels)}
    common = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").where(F.col("n") >= LEXICON_SHARE * F.col("total"))
    held: dict[str, np.ndarray] = {}
    for r in common.select("lang", "word", "n").toLocalIterator():
        held.setdefault(r.word, np.zeros(len(labels)))[at[r.lang]] = r.n / totals[r.lang]
    words = sorted(held)
    shares = np.array([held[w] for w in words]).reshape(len(words), len(labels))
    log = np.log(shares + LEXICON_SHARE) if labels else np.zeros((0, 1))
    odds = np.vstack([np.zeros((1, log.shape[1])), log - log.mean(axis=1, keepdims=True)])
    return labels, {w: i + 1 for i, w in enumerate(words)}, odds


def sampled_runs(texts: DataFrame, labels: list[str]) -> list[tuple[int, list[str]]]:
    """(label, words) of at most FIT_TEXTS texts a language, drawn by a hash of the text, FIT_RUNS runs of each."""
    schema = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("runs", pa.list_(pa.string()))])
    sizes = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, (2 * FIT_TEXTS + 100) / n))))) if sizes else None
    if not sizes:
        return []
    drawn = texts.withColumn("hash", F.xxhash64("text")).where((F.pmod("hash", F.lit(1 << 20)) / (1 << 20)) < rate[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw, _, _, starts, ends = split_bytes(text.as_buffer().to_pybytes(), _KIND)
                blocks = -(-len(starts) // RUN)
                chosen = sorted({i * blocks // FIT_RUNS for i in range(FIT_RUNS)}) if blocks else []
                out.append([" ".join(filter(None, (clean(raw[a:b].tobytes()) for a, b in zip(starts[i * RUN : i * RUN + RUN], ends[i * RUN : i * RUN + RUN], strict=True)))) for i in chosen])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(out, type=pa.list_(pa.string()))], schema=schema)

    runs = drawn.select("lang", "hash", "text").mapInArrow(cut, "lang string, hash long, runs array<string>").dropDuplicates(["lang", "hash"])
    best = top_per_key(runs, ["lang"], [F.col("hash")], FIT_TEXTS).select("lang", "hash", "runs").collect()
    at = {x: i for i, x in enumerate(labels)}
    return [(at[r.lang], run.split()) for r in sorted(best) for run in r.runs if r.lang in at]


def learn(texts: DataFrame) -> Field:
    """A field from (lang, text); rows with a null in either are left out."""
    given = texts.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    labels, lexicon, odds = lexicon_of(materialize(word_counts(given), "lexicon"))
    return fit_field(labels, lexicon, odds, sampled_runs(given, labels))


def label_chunk(texts: list[bytes], field: Field) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the words of many texts: text number, start and end in the joined bytes (a byte between texts), label and chances of each word."""
    joined = b"\n".join(texts)
    _, codes, words, starts, ends = split_bytes(joined, _KIND)
    plain = [clean(w) for w in words.to_pylist()]
    scores = field.emissions([w or "?" for w in plain])
    lettered = np.array([bool(w) for w in plain], dtype=bool)[codes] if len(codes) else np.zeros(0, dtype=bool)
    codes, starts, ends = codes[lettered], starts[lettered], ends[lettered]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, dtype=np.int64)
    text_of = np.searchsorted(begins, starts, side="right") - 1
    first = np.searchsorted(text_of, np.arange(len(texts)))
    place = np.arange(len(codes)) - first[text_of]
    per_text = -(-np.bincount(text_of, minlength=len(texts)) // RUN)
    run = (np.cumsum(per_text) - per_text)[text_of] + place // RUN
    step = max(1, BLOCKS * 4 // max(4, len(field.labels)))
    for low in range(0, int(per_text.sum()), step):
        a, b = np.searchsorted(run, [low, low + step])
        grid = np.full((run[b - 1] - low + 1, RUN), -1, dtype=np.int64)
        grid[run[a:b] - low, place[a:b] % RUN] = codes[a:b]
        filled = grid >= 0
        chances, _, _ = forward_backward(scores[grid], field.transitions, filled)
        yield text_of[a:b], starts[a:b], ends[a:b], chances[run[a:b] - low, place[a:b] % RUN]


def _batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``size`` bytes of text each."""
    for batch in batches:
        texts, at, held = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            texts.append(raw)
            held += len(raw)
            if held >= size or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), texts
                texts, at, held = [], i + 1, 0


def predict(docs: DataFrame, field: Field, carried: list[Column]) -> DataFrame:
    """The carried columns, lang_pred, score (the winner's share of the expected words) and n_words of each row's text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)
    rows = docs.select(*carried, F.col("text").alias("text"))
    kept = rows.drop("text").schema
    kind = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = pa.array([*f.labels, UNDETERMINED])
        for part, texts in _batched(batches, CHUNK):
            sums, n = np.zeros((len(texts), max(1, len(f.labels)))), np.zeros(len(texts), dtype=np.int64)
            if f.labels:
                for text_of, _, _, chances in label_chunk(texts, f):
                    n += np.bincount(text_of, minlength=len(texts))
                    for i in range(len(f.labels)):
                        sums[:, i] += np.bincount(text_of, weights=chances[:, i], minlength=len(texts))
            best = np.where(n > 0, sums.argmax(axis=1), len(f.labels))
            score = np.where(n > 0, np.clip(sums.max(axis=1) / np.maximum(n, 1), 0.0, 1.0), 0.0)
            own = [part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, names.take(pa.array(best)), pa.array(score), pa.array(n)], names=[*part.schema.names[:-1], *kind.names])

    return rows.mapInArrow(mark, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in kept), "lang_pred string, score double, n_words long"]))


def language_spans(docs: DataFrame, field: Field, row_id: str = "doc_id") -> DataFrame:
    """(row_id, start, end, lang): longest runs of words of one label in each text, in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[row_id].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = pa.array(f.labels, pa.string())
        for part, texts in _batched(batches, CHUNK):
            parts = [(t, a, b, c.argmax(axis=1)) for t, a, b, c in label_chunk(texts, f)] if f.labels else []
            if not parts:
                continue
            text_of, starts, ends, best = (np.concatenate(x) for x in zip(*parts, strict=True))
            heads = np.flatnonzero((np.diff(text_of, prepend=-1) != 0) | (np.diff(best, prepend=-1) != 0))
            tails = np.append(heads[1:], len(best)) - 1
            points = np.append(0, np.cumsum((np.frombuffer(b"\n".join(texts), dtype=np.uint8) & 0xC0) != 0x80))
            base = points[np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])][text_of[heads]]
            columns = [part.column(0).take(pa.array(text_of[heads])), pa.array(points[starts[heads]] - base), pa.array(points[ends[tails]] - base), names.take(pa.array(best[heads]))]
            yield pa.RecordBatch.from_arrays(columns, names=[row_id, "start", "end", "lang"])

    return docs.select(F.col(row_id), F.col("text").alias("text")).mapInArrow(mark, f"`{row_id}` {kind}, start long, end long, lang string")


def op11_langid(spark, sf_dir: str) -> DataFrame:
    """Null ids are neither learned from nor held out; a null text or one without letters is ``und`` with score 0, and so is
    any where there is nothing to learn from; very long texts are read whole; repeated rows each give a row; other columns
    are ignored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    field = learn(docs.where(~held_out))
    return predict(docs, field, [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")])
