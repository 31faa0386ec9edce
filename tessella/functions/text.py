"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[a-z0-9]{2,}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms(text: Column | str) -> Column:
    """Lower-case alphanumeric terms of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-case words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def ngrams(tokens: Column | str, n: int) -> Column:
    """Contiguous n-grams, joined by a space; empty if there are fewer than n tokens."""
    t = col(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def strip(text: Column | str) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def estimated_tokens(text: Column | str) -> Column:
    return F.floor(F.length(col(text)) / 4)


def document_stem(path: Column | str) -> Column:
    """Upper-case file name without folder and extension."""
    return F.upper(F.regexp_extract(col(path), r"([^/]+)\.[^./]+$", 1))


def without_math(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\$.*\$", "")


def without_fence(text: Column | str) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(strip(text), r"^```(json)?\s*|\s*```$", "")


def filled_lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n"), strip), lambda x: x != "")


def keywords(text: Column | str, stop: list[str]) -> Column:
    """Words of three or more characters outside the stop list; all words if none is left."""
    all_words = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")
    kept = F.filter(all_words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(stop))
    return F.when(F.size(kept) > 0, kept).otherwise(all_words)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def characters(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(col(text), ""), lambda c: c != ""))


def missing_keys(template: Column | str, given: Column) -> Column:
    """Names in braces in a template that are not among the given keys."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(col(template), F.lit(r"\{(\w+)\}"), F.lit(1))), given))


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    out = col(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return out
