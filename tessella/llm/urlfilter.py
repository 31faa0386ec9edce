"""URL filters: allow and block rules by host and path, and for the rest a naive Bayes score of segmented names.

Names run words together; a unigram Viterbi search splits them into the words of the pages themselves. The multinomial
naive Bayes model is trained on all pages, by host, and what makes a host an example to block is what it says, in its pages'
texts as well as in its URLs: at least HOST_SHARE of its URLs hold a seed word, or at least TEXT_SHARE of its pages' texts do
and seed words are TEXT_TIMES as frequent in them as in the texts of all pages. Then all its pages are examples, whatever their
URLs; those of all other hosts are examples to allow. So hosts whose names tell nothing are found by their texts, the words
that such hosts use count against URLs without a seed, and a seed that mostly stands on good hosts blocks nothing.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.termcounts import term_counts
from tessella.runtime import materialize

#: (verdict, host, path). A rule fits its host and all subdomains where the path starts with its own; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of the usual blocklist categories: adult, gambling, advertising and tracking, spam and fraud, piracy.
SEEDS = ("adult", "porn", "sex", "xxx", "bets", "betting", "casino", "gambling", "jackpot", "ads", "tracker", "spam", "pills", "viagra", "payday", "replica", "phishing", "warez")
HOST_SHARE = 0.1
TEXT_SHARE, TEXT_TIMES = 0.5, 2
#: Words under this share of all are left out of the word model; tokens under it are not broadcast but joined. Either bounds
#: what a worker holds at 1 / share entries.
LEAST_SHARE = 1e-6
LONGEST_WORD = 20
SEED_SHARE = 1e-5  # of all words: what a seed counts in the word model at least, so that it costs the same at any size
WORD = re.compile(rb"[a-z]+")
TAG = re.compile(rb"<[^>]*>")
PART = re.compile(r"[a-z]+|[0-9]+")


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null one or one without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(u, pattern, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = rule.when(fits, F.lit(rule_host + rule_path)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def words_of(html: bytes) -> list[bytes]:
    return WORD.findall(TAG.sub(b" ", html).lower())


def word_costs(pages: DataFrame) -> tuple[dict[str, float], float]:
    """Minus log probabilities of the words of all pages, and the log of the number of words."""
    counts = materialize(term_counts(pages, words_of, "html").where(F.octet_length("term") <= LONGEST_WORD), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = {bytes(r.term).decode(): r.n for r in counts.where(F.col("n") >= max(2, LEAST_SHARE * total)).toLocalIterator()}
    for seed in SEEDS:
        kept[seed] = max(kept.get(seed, 0), SEED_SHARE * max(total, 1))
    log_total = math.log(max(total, 1) * (1 + SEED_SHARE * len(SEEDS)))
    return {w: log_total - math.log(n) for w, n in kept.items()}, log_total


def viterbi_words(name: str, costs: dict[str, float], log_total: float) -> list[str]:
    """The likeliest split of a name into words; an unknown word's chance falls tenfold with each letter."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        chosen = (math.inf, end - 1)
        for start in range(max(0, end - LONGEST_WORD), end):
            cost = costs.get(name[start:end])
            if cost is None:
                cost = log_total + math.log(10) * (end - start)
            chosen = min(chosen, (best[start] + cost, start))
        best.append(chosen[0])
        back.append(chosen[1])
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def url_tokens(host: str, path: str, split: Callable[[str], tuple[str, ...]]) -> list[str]:
    """Segmented words of the host, without its last label, and of the path, each marked with its place; numbers are one token."""
    out = []
    for mark, text in (("h:", host.rpartition(".")[0]), ("p:", path.lower())):
        for part in PART.findall(text):
            out += [mark + "0"] if part[0].isdigit() else [mark + w for w in split(part)]
    return out


def token_column(host: Column, path: Column, costs: dict[str, float], log_total: float, spark) -> Column:
    shared = spark.sparkContext.broadcast(costs)

    def segment(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        split = lru_cache(100_000)(lambda name: tuple(viterbi_words(name, shared.value, log_total)))
        return pa.array([url_tokens(h, p, split) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)], type=pa.list_(pa.string()))

    segment.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    return F.arrow_udf(segment, T.ArrayType(T.StringType()))(host, path)


SEED_TOKENS = [mark + s for s in SEEDS for mark in ("h:", "p:")]


def bayes_weights(tokens: DataFrame) -> tuple[dict[str, float], DataFrame, float]:
    """Log odds of block against allow for the common tokens and the seeds, a table (token, odds) of the rare rest, and the log odds of the classes; from a table of tokens and flags ``listed`` of examples to block."""
    each = tokens.select("listed", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("listed").cast("long")).alias("bad"))
    each = materialize(each, "tokens")
    n, bad, size = each.agg(F.sum("n"), F.sum("bad"), F.count("*")).first()
    n, bad = n or 0, bad or 0
    urls, bad_urls = tokens.agg(F.count("*"), F.sum(F.col("listed").cast("long"))).first()
    bad_urls = bad_urls or 0
    odds = (F.log((F.col("bad") + 1) / (bad + size)) - F.log((F.col("n") - F.col("bad") + 1) / (n - bad + size))).alias("odds")
    common = (F.col("n") >= LEAST_SHARE * n) | F.col("token").isin(SEED_TOKENS)
    weights = {r.token: r.odds for r in each.where(common).select("token", odds).toLocalIterator()}
    return weights, each.where(~common).select("token", odds), math.log((bad_urls + 1) / (urls - bad_urls + 1))


def seed_counts(html: Column | str) -> Column:
    """struct<seeds, words>: how many words of a page's text there are, and how many are seeds."""
    seeds = {x.encode() for x in SEEDS}
    kind = pa.struct([("seeds", pa.int64()), ("words", pa.int64())])

    def count(pages: pa.Array) -> pa.Array:
        found = [words_of(p.as_buffer().to_pybytes() if p.is_valid else b"") for p in pages]
        return pa.array([{"seeds": sum(w in seeds for w in x), "words": len(x)} for x in found], type=kind)

    count.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "struct<seeds: bigint, words: bigint>")(html)


def bad_hosts(tokens: DataFrame) -> DataFrame:
    """(host, listed) of the hosts that are examples to block; from (host, seeded, text)."""
    hosts = tokens.groupBy("host").agg(
        F.avg(F.col("seeded").cast("int")).alias("urls"), F.avg((F.col("text.seeds") > 0).cast("int")).alias("pages"), F.sum("text.seeds").alias("seeds"), F.sum("text.words").alias("words")
    )
    hosts = materialize(hosts, "hosts")
    seeds, words = hosts.agg(F.sum("seeds"), F.sum("words")).first()
    said = (F.col("pages") >= TEXT_SHARE) & (F.col("seeds") * float(words or 1) >= TEXT_TIMES * F.col("words") * float(seeds or 1))
    return materialize(hosts.where((F.col("urls") >= HOST_SHARE) | said).select("host", F.lit(True).alias("listed")), "bad-hosts")


def rare_sums(tokens: DataFrame, rare: DataFrame) -> DataFrame:
    """(row_id, rare): the summed odds of the rare tokens of each row that has any."""
    each = tokens.select("row_id", F.explode("tokens").alias("token"))
    return each.join(rare, "token").groupBy("row_id").agg(F.sum("odds").alias("rare"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds to block) of every url.

    Null urls and those without ``://`` have empty parts and no token but the classes' odds; a null html has no words;
    very long urls and pages are read whole; repeated rows are judged alike; an empty table stays empty; other columns are ignored.
    """
    spark = pages.sparkSession
    costs, log_total = word_costs(pages.select("html"))
    host, path = url_parts("url")
    parts = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"), seed_counts("html").alias("text"))
    tokens = parts.withColumn("tokens", token_column(F.col("host"), F.col("path"), costs, log_total, spark))
    seeds = F.array(*map(F.lit, SEED_TOKENS))
    tokens = tokens.withColumn("seeded", F.arrays_overlap("tokens", seeds)).withColumn("row_id", F.monotonically_increasing_id())
    tokens = materialize(tokens, "urls")  # which also fixes the numbers of the rows
    tokens = tokens.join(bad_hosts(tokens), "host", "left").withColumn("listed", F.col("listed").isNotNull())
    weights, rare, prior = bayes_weights(tokens)
    shared = spark.sparkContext.broadcast(weights)

    def add(lists: pa.Array) -> pa.Array:
        get = shared.value.get
        return pa.array(np.array([prior + sum(get(t, 0.0) for t in x) for x in lists.to_pylist()], dtype=np.float64))

    add.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    scored = tokens.withColumn("score", F.arrow_udf(add, T.DoubleType())("tokens"))
    if not rare.isEmpty():
        scored = scored.join(rare_sums(tokens, rare), "row_id", "left").withColumn("score", F.col("score") + F.coalesce("rare", F.lit(0.0)))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "tokens")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
