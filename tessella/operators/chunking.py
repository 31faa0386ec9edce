"""Documents to chunks: by length, and by headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import strip, without_math

SEPARATOR = " > "


def length_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each starting ``overlap`` before the end of the last; blank ones are dropped.

    One row each: the document, chunk_no from 0, reference and corpus. Nothing is shuffled.
    """
    if size <= overlap:
        raise ValueError("size must be larger than overlap")
    step = size - overlap
    windows = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    rows = docs.select(doc, text, F.explode(F.sequence(F.lit(0), windows)).alias("chunk_no"))
    cut = rows.select(doc, "chunk_no", strip(F.substring(F.col(text), F.col("chunk_no") * step + 1, F.lit(size))).alias("corpus"))
    return cut.where("corpus <> ''").withColumn("reference", F.concat(F.col(doc).cast("string"), F.lit(" Para "), F.col("chunk_no") + 1, F.lit(".")))


def chunk_metadata(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Chunks, sections and characters of each document."""
    return chunks.groupBy(doc).agg(F.count("*").alias("n_chunk"), F.countDistinct("hierarchy").alias("n_section"), F.sum(F.length("corpus")).alias("n_characters"))


def level(hierarchy: Column | str) -> Column:
    return F.size(F.split(hierarchy, SEPARATOR))


def heading_sections(lines: DataFrame) -> DataFrame:
    """(doc, section, heading, level, hierarchy, corpus) from lines (doc, pos, line) of text with Markdown headings.

    Lines before the first heading are left out. A heading's path holds the last heading of each smaller level before it,
    as far as no heading of that level or above has come between; each level is one window over the headings alone.
    """
    h = F.regexp_extract("line", r"^(#{1,6}) +(.*)$", 1)
    marked = lines.select("doc", "pos", "line", F.length(h).alias("depth"), strip(without_math(F.regexp_extract("line", r"^(#{1,6}) +(.*)$", 2))).alias("title"))
    along = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    numbered = marked.withColumn("section", F.sum((F.col("depth") > 0).cast("int")).over(along)).where("section > 0")
    heads = numbered.where("depth > 0")
    last = {d: F.last(F.when(F.col("depth") == d, F.struct("section", "title")), ignorenulls=True).over(along) for d in range(1, 7)}
    above = {d: F.max(F.when(F.col("depth") <= d, F.col("section"))).over(along) for d in range(1, 7)}
    paths = heads.select("doc", "section", "title", "depth", *(last[d].alias(f"l{d}") for d in last), *(above[d].alias(f"a{d}") for d in above))
    steps = F.array(*(F.when((F.col("depth") >= d) & (F.col(f"l{d}.section") == F.col(f"a{d}")), F.col(f"l{d}.title")) for d in range(1, 7)))
    paths = paths.select("doc", "section", F.col("title").alias("heading"), F.col("depth").alias("level"), F.array_join(F.filter(steps, lambda s: s.isNotNull()), SEPARATOR).alias("hierarchy"))
    body = numbered.where("depth = 0").groupBy("doc", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("corpus"))
    return paths.join(body, ["doc", "section"], "left").withColumn("corpus", F.coalesce(strip("corpus"), F.lit("")))


def split_section(corpus: Column | str) -> Column:
    """Parts of a section: a table whole, numbered paragraphs each, else lines if it is long, else whole."""
    c = F.col(corpus) if isinstance(corpus, str) else corpus
    parts = (
        F.when(c.rlike(r"(?m)^Table \d+"), F.array(c))
        .when(c.rlike(r"(?m)^\d+\."), F.split(c, r"\n(?=\d+\.)"))
        .when(F.length(c) > 8000, F.split(c, "\n"))
        .otherwise(F.array(c))
    )
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def part_label(part: Column, number: Column) -> Column:
    """Reference of a part: its table or paragraph number, else its place."""
    table, para = F.regexp_extract(part, r"^Table (\d+)", 1), F.regexp_extract(part, r"^(\d+)\.", 1)
    return F.when(table != "", F.concat(F.lit("Table "), table)).when(para != "", F.concat(F.lit("Para "), para)).otherwise(F.concat(F.lit("auto"), number))
