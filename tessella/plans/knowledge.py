"""Queries of chunking, metadata, references, prompts and text conversion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as fx
from tessella.operators import building, chunking, graph, sections, statistics
from tessella.runtime import read_table as t
from tessella.runtime import shared_path


def chunk_length(spark, d):
    return chunking.length_chunks(t(spark, d, "documents"), 1000, 50)


def chunk_meta(spark, d):
    chunks = chunk_length(spark, d).withColumn("hierarchy", F.concat_ws(" > ", F.col("doc_id").cast("string"), F.floor(F.col("chunk_no") / 4).cast("string")))
    return chunking.chunk_metadata(chunks)


def chunk_level_groups(spark, d):
    docs = t(spark, d, "documents").select(F.concat_ws(" > ", "lang", F.when(F.col("n_chars") > 1000, F.col("source")), F.when(F.col("n_chars") > 5000, F.lit("long"))).alias("hierarchy"), "n_chars")
    return docs.groupBy(chunking.level("hierarchy").alias("level")).agg(F.count("*").alias("n"), F.countDistinct("hierarchy").alias("paths"), F.sum("n_chars").alias("chars"))


def heading_sections(spark, d):
    """Paragraph lines of every document, every fifth a heading of depth 1 to 3, cut into sections."""
    lines = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marks = F.when(F.col("pos") % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.col("pos") / 5).cast("int") % 3 + 1), F.lit(" "), F.substring(F.regexp_replace("line", r"[^A-Za-z ]", ""), 1, 20), F.col("pos").cast("string"))).otherwise(F.col("line"))
    s = chunking.heading_sections(lines.select("doc", "pos", marks.alias("line")))
    return s.select("doc", "section", "level", "hierarchy", F.length("corpus").alias("size"))


def _page_lines(spark, d):
    """Pages as lines of Markdown: titles and links as headings, paragraphs as text, of some pages numbered, of some as a table."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)^.*?<body>", ""), r"\s+", " ")
    marked = F.regexp_replace(F.regexp_replace(body, r"<(h1|li)[^>]*>", "\n## "), r"<(p|article|div|footer)[^>]*>|</li>|</h1>|<br>", "\n")
    text = F.regexp_replace(F.regexp_replace(marked, "<[^>]*>", ""), r"[$]", "")
    rows = t(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 4 == 0, "CRE").otherwise("PAGE"), F.col("page_id").cast("string"), F.lit("x")).alias("doc"), "page_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    number = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("B.1."), F.col("pos").cast("string"), F.lit(" "))).when(F.col("page_id") % 4 == 1, F.concat(F.col("pos").cast("string"), F.lit(". "))).when(F.col("page_id") % 4 == 2, F.lit("Table 7 ")).otherwise("")
    plain = (F.col("pos") % 3 > 0) & (F.col("line") != "") & ~F.col("line").startswith("##")
    return rows.select("doc", "page_id", "pos", F.when(plain, F.concat(number, "line")).otherwise(F.col("line")).alias("line"))


def hierarchy_chunks(spark, d):
    """Pages cut along a list of their own headings: the first of level 1, others of level 2 or 3 by their place."""
    lines = _page_lines(spark, d)
    heads = lines.where("startswith(line, '## ')").select(F.concat(F.lit("list of "), F.lower("doc")).alias("file"), F.col("pos").alias("idx"), F.expr("trim(substr(line, 4))").alias("heading"), "page_id")
    first = F.min("idx").over(W.partitionBy("file"))
    listed = heads.withColumn("level", F.when(F.col("idx") == first, 1).otherwise(2 + F.col("idx") % 2)).where("heading <> ''")
    found = sections.hierarchy_chunks(lines.select("doc", "pos", "line"), listed)
    return found.select("doc", "section", "level", "part", "reference", F.sha2(F.concat_ws("|", "hierarchy", "heading", "corpus"), 256).alias("digest"), "content_type")


def references_resolve(spark, d):
    """Benchmark passages as references into documents."""
    refs = t(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("reference"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document_name"), F.col("lang").alias("hierarchy"))
    return graph.resolve_references(refs, docs)


def prompt_assembly(spark, d):
    """A prompt for each conversation: role, task, and the texts of its first three user turns."""
    c = t(spark, d, "conversations")
    first = F.slice(F.sort_array(F.collect_list(F.struct("turn", "text"))), 1, 3)
    asked = c.where("role = 'user'").groupBy("conv_id").agg(first.alias("x"))
    context = F.array_join(F.transform("x", lambda x: F.concat(F.lit("- "), F.substring(x.text, 1, 500))), "\n")
    filled = fx.fill_template(F.lit("You are {role}.\n{task}\nContext:\n{context}"), {"role": F.lit("an analyst"), "task": F.lit("Answer the user."), "context": context})
    return asked.select("conv_id", F.length(filled).alias("size"), F.sha2(filled, 256).alias("digest"))


def template_missing_keys(spark, d):
    e = t(spark, d, "events").select("event_id", F.concat(F.lit("{user} did {"), "event_type", F.lit("} at {time} with {k}")).alias("template"))
    return e.select("event_id", F.array_join(fx.missing_keys("template", F.array(F.lit("user"), F.lit("time"), F.lit("click"))), ",").alias("missing"))


def affix_prompts(spark, d):
    """A replacement where there is one, else prefix and postfix around the text."""
    c = t(spark, d, "conversations")
    replaced = F.when(F.col("role") == "system", F.lit("Be brief."))
    affixed = F.coalesce(replaced, F.concat(F.upper("role"), F.lit(": "), "text", F.lit(" [end]")))
    return c.select("conv_id", "turn", F.sha2(affixed, 256).alias("digest"))


def dotted_path_condition(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").select("event_id", k.alias("k"), (k == 3).alias("equals"), F.contains("props", F.lit('"k"')).alias("contains"))


def criteria_eval(spark, d):
    """Each document against three output criteria; success is all of them."""
    a, b, c = F.contains(F.lower("text"), F.lit(" the ")), F.col("text").rlike(r"[0-9]{3}"), F.col("n_chars") >= 500
    return t(spark, d, "documents").select("doc_id", a.alias("has_word"), b.alias("matches"), c.alias("long_enough"), (a & b & c).alias("success"))


def response_metrics(spark, d):
    """Length and words of each turn, and the change against the turn before."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = t(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), F.size(fx.terms("text")).alias("terms"))
    return c.withColumn("delta", F.col("chars") - F.lag("chars").over(w))


def token_estimates(spark, d):
    docs = t(spark, d, "documents").groupBy("lang", "source").agg(F.sum(fx.estimated_tokens("text")).alias("tokens"), F.count("*").alias("n"))
    return docs.withColumn("batch", F.greatest(F.lit(1), F.floor(7200 / (F.col("tokens") / F.col("n")))).cast("int"))


def build_base(spark, d):
    """A base of two thirds of the documents, brought up to all of them: chunks and characters of each, and the run that built it."""
    docs = t(spark, d, "documents").select(F.format_string("doc-%012d", "doc_id").alias("path"), "doc_id", "text")
    found = docs.select("path", F.col("path").alias("document_name"), F.octet_length("text").cast("long").alias("size"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"))
    base = shared_path(spark, "base")
    options = building.Options(size=1000, overlap=50, embedding="hash-64")
    read = lambda todo: docs.join(todo.select("path"), "path", "left_semi").select("path", "text")
    for part in (found.where("CAST(substring(path, 5) AS BIGINT) % 3 > 0"), found):
        building.build(spark, part, read, base, options)
    chunks = building.read_base(spark, base, "chunks").groupBy("document_name").agg(F.count("*").alias("n_chunk"), F.sum(F.length("corpus")).alias("n_characters"))
    return chunks.join(building.manifest(spark, base).select("document_name", "run"), "document_name").select(F.substring("document_name", 5, 12).cast("long").alias("doc_id"), "n_chunk", "n_characters", "run")


def statistics_of_runs(spark, d):
    """Statistics of three runs over parts of the documents, merged from their written rows; the sketches are shown to be within their error."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    path = shared_path(spark, "statistics")
    for run in range(3):
        statistics.run_statistics(docs.where(F.col("doc_id") % 3 == run), run).write.mode("append").parquet(path)
    found = statistics.merged_statistics(spark.read.parquet(path))
    exact = docs.select(F.explode(fx.terms("text")).alias("term")).agg(F.countDistinct("term").alias("n"))
    q = F.col("length_quantiles")
    ranks = docs.crossJoin(F.broadcast(found.select("length_quantiles"))).agg(*(F.avg((F.length("text") <= q[i]).cast("int")).alias(f"r{i}") for i in range(3)))  # one row to all
    close = [F.abs(F.col(f"r{i}") - (i + 1) / 4) <= statistics.KLL_ERROR for i in range(3)]
    both = found.drop("length_quantiles").crossJoin(exact).crossJoin(ranks)  # three rows
    return both.select("runs", "documents", "bytes", "occurrences", (F.abs(F.col("distinct_terms") - F.col("n")) <= statistics.HLL_ERROR * F.col("n")).alias("terms_close"), (close[0] & close[1] & close[2]).alias("lengths_close"))


_CHUNKS = "SELECT doc_id, i AS chunk_no, regexp_replace(substr(text, i * 950 + 1, 1000), '^\\s+|\\s+$', '', 'g') AS corpus FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 950.0))::INT + 1))::INT AS i FROM documents) WHERE corpus <> ''"

_PAGE_LINES = r"""
WITH b AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'CRE' ELSE 'PAGE' END || page_id || 'x' AS doc, regexp_replace(regexp_replace(html, '^(?s:.*?)<body>', ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS h FROM pages),
m AS (SELECT page_id, doc, replace(regexp_replace(regexp_replace(regexp_replace(h, '<(h1|li)[^>]*>', chr(10) || '## ', 'g'), '<(p|article|div|footer)[^>]*>|</li>|</h1>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g'), '$', '') AS x FROM b),
s AS (SELECT page_id, doc, string_split(x, chr(10)) AS v FROM m), r AS (SELECT page_id, doc, unnest(v) AS line, unnest(range(0, len(v)))::INT AS pos FROM s),
l AS (SELECT page_id, doc, pos, CASE WHEN pos % 3 > 0 AND line <> '' AND NOT starts_with(line, '##') THEN CASE page_id % 4 WHEN 0 THEN 'B.1.' || pos || ' ' WHEN 1 THEN pos || '. ' WHEN 2 THEN 'Table 7 ' ELSE '' END || line ELSE line END AS line FROM r)"""
_STRIP = "regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_HIERARCHY = f"""{_PAGE_LINES},
g AS (SELECT doc, pos, trim(substr(line, 4)) AS heading, CASE WHEN pos = min(pos) OVER (PARTITION BY doc) THEN 1 ELSE 2 + pos % 2 END AS level FROM l WHERE starts_with(line, '## ')),
n AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos, heading) - 1 AS n, heading, level FROM g WHERE heading <> ''),
f AS (SELECT doc, heading AS first FROM n WHERE n = 0), begun AS (SELECT doc, min(pos) AS begin FROM l JOIN f USING (doc) WHERE contains(line, '## ' || first) GROUP BY 1),
c AS (SELECT doc, pos, line, starts_with(line, '## ') AS is_head, sum(starts_with(line, '## ')::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS k FROM l JOIN begun USING (doc) WHERE pos >= begin),
h AS (SELECT doc, k, {_STRIP.format("substr(line, 4)")} AS heading FROM c WHERE is_head),
v AS (SELECT h.doc, h.k, h.heading, arg_min(n.level, n.n) AS level FROM h LEFT JOIN n ON n.doc = h.doc AND n.heading = h.heading AND n.n >= h.k GROUP BY 1, 2, 3),
w AS (SELECT doc, k, level, CASE WHEN level = 1 AND NOT contains(heading, 'Attachment') THEN doc || ' - ' || heading ELSE heading END AS heading FROM v),
folded AS (SELECT doc, list({{'k': k, 'l': coalesce(level, 8), 'h': heading, 'p': []::VARCHAR[]}} ORDER BY k) AS a FROM w GROUP BY 1),
prefixes AS (SELECT doc, a, unnest(range(1, len(a) + 1)) AS i FROM folded),
paths AS (SELECT doc, a[i].k AS k, list_reduce(list_prepend({{'k': -1::HUGEINT, 'l': 0, 'h': '', 'p': []::VARCHAR[]}}, a[1:i]), lambda s, x: {{'k': x.k, 'l': x.l, 'h': x.h, 'p': list_append(CASE WHEN x.l = 1 THEN [] WHEN len(s.p) >= x.l THEN s.p[1:x.l - 1] ELSE s.p END, x.h)}}).p AS path FROM prefixes),
t AS (SELECT doc, k, {_STRIP.format("line")} AS line, pos FROM c WHERE NOT is_head AND {_STRIP.format("line")} <> ''),
x AS (SELECT doc, k, line, pos, starts_with(doc, 'CRE') AS cre, first_value(line) OVER o AS head, bool_or(regexp_matches(line, '^[0-9]+\\.')) OVER (PARTITION BY doc, k) AS numbered, row_number() OVER o AS line_no,
  sum(length(line) + 1) OVER (PARTITION BY doc, k) - 1 AS size FROM t WINDOW o AS (PARTITION BY doc, k ORDER BY pos)),
y AS (SELECT *, regexp_matches(head, '^(?i:table) [0-9]+') AS is_table FROM x),
z AS (SELECT *, sum(CASE WHEN line_no = 1 THEN 0 WHEN cre THEN regexp_matches(line, '^([A-Z]+\\.)?[0-9]+\\.[0-9]+')::INT WHEN is_table THEN 0 WHEN numbered THEN regexp_matches(line, '^[0-9]+\\.')::INT WHEN size > 8000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM y),
q AS (SELECT doc, k, part, any_value(cre) AS cre, any_value(is_table) AS is_table, string_agg(line, chr(10) ORDER BY pos) AS corpus FROM z GROUP BY 1, 2, 3)
SELECT q.doc, q.k::BIGINT AS section, w.level::INT AS level, q.part::INT AS part,
  concat_ws(', ', q.doc, nullif(regexp_extract(path[-1], '(?i)(attachment [a-z]|chapter [0-9]+)', 1), '')) || ' ' ||
  CASE WHEN cre THEN 'Para ' || coalesce(nullif(regexp_extract(corpus, '^([A-Z]+\\.)?([0-9]+\\.[0-9]+)', 2), ''), 'auto' || (part + 1)) || coalesce(', ' || nullif(regexp_extract(corpus, '^([A-Z]+)\\.[0-9]+\\.[0-9]+', 1), ''), '')
    WHEN regexp_matches(corpus, '^(?i:table) [0-9]+') THEN 'Table ' || regexp_extract(corpus, '^(?i:table) ([0-9]+)', 1) WHEN regexp_matches(corpus, '^[0-9]+\\.') THEN 'Para ' || regexp_extract(corpus, '^([0-9]+\\.)', 1)
    WHEN is_table THEN 'Table Content ' || (part + 1) ELSE 'Orphan ' || (part + 1) END AS reference,
  sha256(concat_ws('|', q.doc || ' > ' || array_to_string(path, ' > '), w.heading, corpus)) AS digest, CASE WHEN NOT cre AND is_table THEN 'table' ELSE 'paragraph' END AS content_type
FROM q JOIN w ON w.doc = q.doc AND w.k = q.k JOIN paths p ON p.doc = q.doc AND p.k = q.k"""

#: For each depth, the last heading of that depth or above; it is in a path if it is of that depth itself.
_LAST_HEADS = ", ".join(f"last_value(CASE WHEN level <= {i} THEN {{'level': level, 'title': title}} END IGNORE NULLS) OVER w AS h{i}" for i in range(1, 7))
_OWN_HEADS = ", ".join(f"CASE WHEN level >= {i} AND h{i}.level = {i} THEN h{i}.title END" for i in range(1, 7))

QUERIES = {
    "hierarchy_chunks": (hierarchy_chunks, _HIERARCHY),
    "chunk_length": (chunk_length, f"SELECT *, doc_id || ' Para ' || (chunk_no + 1) || '.' AS reference FROM ({_CHUNKS})"),
    "build_base": (build_base, f"SELECT doc_id, count(*) AS n_chunk, sum(length(corpus))::BIGINT AS n_characters, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 2 END::BIGINT AS run FROM ({_CHUNKS}) GROUP BY 1"),
    "run_statistics": (statistics_of_runs, "SELECT 3::BIGINT AS runs, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, sum(len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')))::BIGINT AS occurrences, true AS terms_close, true AS lengths_close FROM documents"),
    "chunk_meta": (chunk_meta, f"SELECT doc_id, count(*) AS n_chunk, count(DISTINCT chunk_no // 4) AS n_section, sum(length(corpus))::BIGINT AS n_characters FROM ({_CHUNKS}) GROUP BY 1"),
    "chunk_level_groups": (chunk_level_groups, """
WITH h AS (SELECT concat_ws(' > ', lang, CASE WHEN n_chars > 1000 THEN source END, CASE WHEN n_chars > 5000 THEN 'long' END) AS hierarchy, n_chars FROM documents)
SELECT len(string_split(hierarchy, ' > '))::INT AS level, count(*) AS n, count(DISTINCT hierarchy) AS paths, sum(n_chars)::BIGINT AS chars FROM h GROUP BY 1"""),
    "heading_sections": (heading_sections, f"""
WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
m AS (SELECT doc, pos, CASE WHEN pos % 5 = 0 THEN repeat('#', (pos // 5 % 3 + 1)::INT) || ' ' || substr(regexp_replace(line, '[^A-Za-z ]', '', 'g'), 1, 20) || pos ELSE line END AS line FROM l),
x AS (SELECT doc, pos, line, length(regexp_extract(line, '^(#{{1,6}}) +(.*)$', 1))::INT AS level, trim(regexp_extract(line, '^(#{{1,6}}) +(.*)$', 2)) AS title FROM m),
n AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS section FROM x),
h AS (SELECT doc, section, level, {_LAST_HEADS} FROM n WHERE level > 0 WINDOW w AS (PARTITION BY doc ORDER BY section)),
b AS (SELECT doc, section, length(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')) AS size FROM n WHERE level = 0 GROUP BY 1, 2)
SELECT doc, section, level, concat_ws(' > ', {_OWN_HEADS}) AS hierarchy, coalesce(size, 0) AS size FROM h LEFT JOIN b USING (doc, section)"""),
    "references_resolve": (references_resolve, """
WITH s AS (SELECT item_id AS ref_id, doc_id AS chunk_id,
  CASE WHEN contains(lower(d.text), lower(b.text)) THEN 10 ELSE 0 END + CASE WHEN contains(lower(source), lower(b.text)) THEN 5 ELSE 0 END + CASE WHEN contains(lower(lang), lower(b.text)) THEN 3 ELSE 0 END AS score
  FROM benchmark b, documents d)
SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 3"""),
    "prompt_assembly": (prompt_assembly, """
WITH x AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 3),
p AS (SELECT conv_id, 'You are an analyst.' || chr(10) || 'Answer the user.' || chr(10) || 'Context:' || chr(10) || string_agg('- ' || substr(text, 1, 500), chr(10) ORDER BY turn, text) AS p FROM x GROUP BY 1)
SELECT conv_id, length(p) AS size, sha256(p) AS digest FROM p"""),
    "template_missing_keys": (template_missing_keys, "SELECT event_id, array_to_string(list_sort(list_filter([event_type, 'k'], lambda x: x NOT IN ('user', 'time', 'click'))), ',') AS missing FROM events"),
    "affix_prompts": (affix_prompts, "SELECT conv_id, turn, sha256(CASE WHEN role = 'system' THEN 'Be brief.' ELSE upper(role) || ': ' || text || ' [end]' END) AS digest FROM conversations"),
    "dotted_path_condition": (dotted_path_condition, """SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k')::INT = 3 AS equals, contains(props, '"k"') AS contains FROM events"""),
    "criteria_eval": (criteria_eval, """
WITH c AS (SELECT doc_id, contains(lower(text), ' the ') AS has_word, regexp_matches(text, '[0-9]{3}') AS matches, n_chars >= 500 AS long_enough FROM documents)
SELECT *, has_word AND matches AND long_enough AS success FROM c"""),
    "response_metrics": (response_metrics, """
WITH c AS (SELECT conv_id, turn, length(text) AS chars, len(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS terms FROM conversations)
SELECT *, chars - lag(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM c"""),
    "token_batches": (token_estimates, "SELECT lang, source, sum(length(text) // 4)::BIGINT AS tokens, count(*) AS n, greatest(1, floor(7200 / (sum(length(text) // 4) / count(*)::DOUBLE)))::INT AS batch FROM documents GROUP BY ALL"),
}
