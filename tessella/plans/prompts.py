"""Queries of prompts, answers, formats and configurations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import prompts as p
from tessella.runtime import read_table as t


def _turns(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def list_format(spark, d):
    """The texts of each conversation as a numbered list, and how many come back from it."""
    c = _turns(spark, d).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.regexp_replace(x.text, r"\s+", " ")).alias("x"))
    made = c.select("conv_id", "x", p.numbered_list(F.col("x")).alias("list"))
    return made.select("conv_id", F.sha2("list", 256).alias("digest"), (p.listed_texts(F.col("list")) == F.col("x")).alias("same"))


def affix_components(spark, d):
    c = _turns(spark, d)
    prefix, postfix = F.when(F.col("role") == "user", F.lit("Q: ")), F.when(F.col("turn") % 2 == 1, F.lit(" (end)"))
    return c.select("conv_id", "turn", F.sha2(p.affixed(F.col("text"), prefix, postfix, F.when(F.col("role") == "system", F.lit("Be brief."))), 256).alias("digest"))


def iteration_prompts(spark, d):
    """Each event's task: the template of its type, with the value of its iteration, a personality and a topology."""
    e = t(spark, d, "events").select("event_id", "event_type", "user_id", F.get_json_object("props", "$.k").alias("k"))
    template = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Do "), "event_type", F.lit(" with {{iteration_value}}."))).otherwise(F.concat(F.lit("Do "), "event_type"))
    filled = p.with_iteration(template, F.when(F.col("user_id") % 3 > 0, F.col("k")))
    voiced = p.with_personality(filled, {"style": F.when(F.col("user_id") % 5 == 0, F.lit("terse")), "type": F.when(F.col("user_id") % 7 == 0, F.lit("INTJ"))})
    shaped = p.with_topology(voiced, F.when(F.col("user_id") % 2 == 0, F.lit("chain")).otherwise(F.col("event_type")), {"chain": "Think in steps.\n{prompt}", "click": "[{prompt}]"})
    return e.select("event_id", shaped.alias("prompt"))


def parse_answers(spark, d):
    """Event properties as answers of a model, fenced, broken or plain by their id."""
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat("props", F.lit(","))).otherwise(F.concat("event_type", F.lit("\n\n  "), F.col("user_id").cast("string"), F.lit("\n")))
    kind = F.when(F.col("event_id") % 4 < 2, F.lit("json")).when(F.col("event_id") % 4 == 2, F.lit("list")).otherwise(F.lit("text"))
    x = t(spark, d, "events").select("event_id", p.parsed_answer(raw, kind).alias("x"))
    return x.select("event_id", "x.value", F.array_join("x.lines", "|").alias("lines"), "x.error")


def context_prompts(spark, d):
    """A prompt for each customer with its latest orders and the clerks that it met."""
    o = t(spark, d, "orders")
    last = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    recent = o.withColumn("n", last).where("n <= 3").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x.o_orderkey.cast("string")).alias("orders"))
    c = t(spark, d, "customer").join(recent, "c_custkey", "left")
    text = p.context_sections(F.concat(F.lit("Customer "), "c_name"), {"Orders": F.coalesce("orders", F.array().cast("array<string>")), "Segment": F.array("c_mktsegment")})
    return c.select("c_custkey", text.alias("prompt"))


def response_formats(spark, d):
    """Event types with a response format of their own, by nation's comments as a library; the rest are told apart."""
    types = t(spark, d, "events").groupBy(F.col("event_type").alias("prompt_id")).agg(F.count("*").alias("uses"))
    formats = t(spark, d, "events").where("event_type < 'm'").select(F.col("event_type").alias("prompt_id"), F.concat(F.lit("json:"), "event_type").alias("response_format")).distinct()
    found, missing = p.attach_formats(types, formats)
    return found.unionByName(missing.withColumn("response_format", F.lit(None).cast("string")))


def config_choice(spark, d):
    """Parts as tasks: a config by brand and container, else by brand, else the general one."""
    tasks = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("task_type"), F.when(F.col("p_size") > 25, "high").otherwise("low").alias("complexity"))
    some = t(spark, d, "part").select(F.col("p_brand").alias("task_type")).distinct()
    configs = some.where("task_type <= 'Brand#2'").select("task_type", F.lit("high").alias("complexity"), F.concat(F.lit("own "), "task_type").alias("config"))
    configs = configs.unionAll(some.where("task_type <= 'Brand#4'").select("task_type", F.lit("medium"), F.concat(F.lit("brand "), "task_type"))).unionAll(spark.sql("SELECT 'general', 'medium', 'general'"))
    return p.choose_config(tasks, configs).select("p_partkey", "config", "rank")


def math_markup(spark, d):
    """Documents with their doubled words as formulas, in a wiki's markup and as HTML."""
    docs = t(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("# "), "source", F.lit("\n- **"), "lang", F.lit("** item\n\n$$x^"), F.col("n_chars").cast("string"), F.lit("$$ and $y$ & *more* <b>\n"), F.regexp_replace("text", r"[*$#<>&-]", " ")).alias("md"))
    return docs.select("doc_id", F.sha2(p.math_macros(F.col("md")), 256).alias("macros"), F.substring_index(p.markdown_html(p.math_macros(F.col("md"))), "</p>", 1).alias("head"))


def sentence_counts(spark, d):
    s = p.sentences(F.col("text"))
    docs = t(spark, d, "documents").select("doc_id", s.alias("s"))
    return docs.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def markdown_table_parse(spark, d):
    """Whole documents written as Markdown table rows, bars escaped, and parsed back into cells."""
    rows = t(spark, d, "documents").select("doc_id", p.table_row([F.col("lang"), F.col("source"), F.col("text")]).alias("row"))
    cells = rows.select("doc_id", p.table_cells(F.col("row")).alias("c")).where(F.size("c") == 3)
    return cells.select("doc_id", F.col("c")[0].alias("lang"), F.col("c")[1].alias("source"), F.sha2(F.col("c")[2], 256).alias("digest"))


_FLAT = "regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')"

QUERIES = {
    "prompt_list_format": (list_format, """
WITH x AS (SELECT conv_id, turn, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)
SELECT conv_id, sha256(string_agg('Prompt ' || i || ': ' || text, chr(10) || chr(10) ORDER BY i)) AS digest, true AS same FROM x GROUP BY 1"""),
    "prompt_affix_components": (affix_components, """
SELECT conv_id, turn, sha256(CASE WHEN role = 'system' THEN 'Be brief.' ELSE CASE WHEN role = 'user' THEN 'Q: ' ELSE '' END || text || CASE WHEN turn % 2 = 1 THEN ' (end)' ELSE '' END END) AS digest FROM conversations"""),
    "prompt_iterations": (iteration_prompts, """
WITH e AS (SELECT event_id, event_type, user_id AS u, props->>'$.k' AS k FROM events),
f AS (SELECT *, CASE WHEN u % 3 > 0 AND k IS NOT NULL THEN CASE WHEN u % 2 = 0 THEN 'Do ' || event_type || ' with ' || k || '.' ELSE 'Do ' || event_type || chr(10) || 'Iteration value: ' || k END
  WHEN u % 2 = 0 THEN 'Do ' || event_type || ' with {{iteration_value}}.' ELSE 'Do ' || event_type END AS p FROM e),
g AS (SELECT *, p || CASE WHEN u % 5 = 0 OR u % 7 = 0 THEN chr(10) || chr(10) || 'Personality: ' || concat_ws(', ', CASE WHEN u % 5 = 0 THEN 'style: terse' END, CASE WHEN u % 7 = 0 THEN 'type: INTJ' END) ELSE '' END AS q FROM f)
SELECT event_id, CASE WHEN u % 2 = 0 THEN 'Think in steps.' || chr(10) || q WHEN event_type = 'click' THEN '[' || q || ']' ELSE q END AS prompt FROM g"""),
    "answer_parse": (parse_answers, """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props || ',' ELSE event_type || chr(10) || chr(10) || '  ' || user_id || chr(10) END AS value,
  CASE WHEN event_id % 4 = 2 THEN event_type || '|' || user_id END AS lines, CASE WHEN event_id % 4 = 1 THEN 'not valid JSON' END AS error FROM events"""),
    "prompt_context_sections": (context_prompts, """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders),
x AS (SELECT o_custkey, string_agg('- ' || o_orderkey, chr(10) ORDER BY n) AS o FROM r WHERE n <= 3 GROUP BY 1)
SELECT c_custkey, 'Customer ' || c_name || coalesce(chr(10) || chr(10) || '## Orders' || chr(10) || o, '') || chr(10) || chr(10) || '## Segment' || chr(10) || '- ' || c_mktsegment AS prompt FROM customer LEFT JOIN x ON c_custkey = o_custkey"""),
    "prompt_response_formats": (response_formats, "SELECT event_type AS prompt_id, count(*) AS uses, CASE WHEN event_type < 'm' THEN 'json:' || event_type END AS response_format FROM events GROUP BY 1"),
    "config_fallback": (config_choice, """
SELECT p_partkey, CASE WHEN p_brand <= 'Brand#2' AND p_size > 25 THEN 'own ' || p_brand WHEN p_brand <= 'Brand#4' THEN 'brand ' || p_brand ELSE 'general' END AS config,
  CASE WHEN p_brand <= 'Brand#2' AND p_size > 25 THEN 1 WHEN p_brand <= 'Brand#4' THEN 2 ELSE 3 END AS rank FROM part"""),
    "math_markup": (math_markup, """
SELECT doc_id, sha256('# ' || source || chr(10) || '- **' || lang || '** item' || chr(10) || chr(10) || '{mathblock}x^' || n_chars || '{mathblock} and {mathinline}y{mathinline} & *more* <b>' || chr(10) || regexp_replace(text, '[*$#<>&-]', ' ', 'g')) AS macros,
  '<h1>' || source || '</h1><li><b>' || lang || '</b> item</li><p>{mathblock}x^' || n_chars || '{mathblock} and {mathinline}y{mathinline} &amp; <i>more</i> &lt;b&gt;' AS head FROM documents"""),
    "sentence_counts": (sentence_counts, """
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM s"""),
    "markdown_table_parse": (markdown_table_parse, f"SELECT doc_id, lang, source, sha256({_FLAT}) AS digest FROM documents"),
}
