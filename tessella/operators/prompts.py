"""Prompts as columns: lists, affixes, placeholders, personalities, formats of answers, and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import filled_lines, strip, without_fence


def numbered_list(texts: Column, kind: str = "Prompt") -> Column:
    """An array of texts as one text: ``Prompt 1: ...`` and so on, a blank line between."""
    items = F.transform(texts, lambda x, i: F.concat(F.lit(f"{kind} "), (i + 1).cast("string"), F.lit(": "), x))
    return F.array_join(items, "\n\n")


def listed_texts(text: Column, kind: str = "Prompt") -> Column:
    """The inverse of numbered_list, for texts that hold no such mark themselves."""
    return F.transform(F.filter(F.split(text, rf"(^|\n\n){kind} \d+: "), lambda x: x != ""), lambda x: x)


def affixed(text: Column, prefix: Column, postfix: Column, replacement: Column) -> Column:
    """The replacement where there is one; else the text with its prefix and postfix, either of which may be null."""
    none = F.lit("")
    return F.coalesce(replacement, F.concat(F.coalesce(prefix, none), text, F.coalesce(postfix, none)))


def with_iteration(prompt: Column, value: Column, mark: str = "{{iteration_value}}") -> Column:
    """The value in place of the mark, or on a line of its own where the prompt has none; a null value changes nothing."""
    placed = F.when(F.contains(prompt, F.lit(mark)), F.replace(prompt, F.lit(mark), value)).otherwise(F.concat(prompt, F.lit("\nIteration value: "), value))
    return F.when(value.isNull(), prompt).otherwise(placed)


def with_personality(prompt: Column, traits: dict[str, Column]) -> Column:
    """A line of the traits that are not null behind a system prompt; none if all are null."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f"{name}: "), value) for name, value in traits.items())))
    return F.when(F.size(parts) > 0, F.concat(prompt, F.lit("\n\nPersonality: "), F.array_join(parts, ", "))).otherwise(prompt)


def with_topology(prompt: Column, topology: Column, templates: dict[str, str]) -> Column:
    """The prompt inside its topology's template, or alone where the topology is not known."""
    known = F.create_map(*(x for k, v in templates.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.replace(F.try_element_at(known, topology), F.lit("{prompt}"), prompt), prompt)


def parsed_answer(answer: Column, kind: Column) -> Column:
    """struct<value, lines, error>: an answer read as json, as a list of lines or as text; a json failure keeps the raw text."""
    bare = without_fence(answer)
    # the parser lets text follow a value; inside a list and an object it can't
    valid = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v": '), bare, F.lit("}"))).isNotNull()
    error = F.when((kind == "json") & ~valid, F.lit("not valid JSON"))
    lines = F.when(kind == "list", filled_lines(answer))
    return F.struct(F.when((kind == "json") & valid, bare).otherwise(answer).alias("value"), lines.alias("lines"), error.alias("error"))


def context_sections(prompt: Column, sections: dict[str, Column]) -> Column:
    """The prompt with a headed list for each section (an array of texts) that is not empty."""
    parts = [F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {name}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))) for name, items in sections.items()]
    return F.concat(prompt, *(F.coalesce(p, F.lit("")) for p in parts))


def attach_formats(prompts: DataFrame, formats: DataFrame, key: str = "prompt_id") -> tuple[DataFrame, DataFrame]:
    """Prompts with the response format of their id, and those without one."""
    return prompts.join(formats.select(key, "response_format"), key), prompts.join(formats, key, "left_anti")


def choose_config(tasks: DataFrame, configs: DataFrame) -> DataFrame:
    """Each task (task_type, complexity) with the config of both, else of its type and ``medium``, else of ``general`` and ``medium``.

    Configs are (task_type, complexity, config), a small table; the rank says which of the three it was.
    """
    exact = configs.select("task_type", "complexity", F.col("config").alias("c1"))
    typed = configs.where("complexity = 'medium'").select("task_type", F.col("config").alias("c2"))
    general = configs.where("task_type = 'general' AND complexity = 'medium'").select(F.col("config").alias("c3"), F.lit(1).alias("one"))
    joined = tasks.join(exact, ["task_type", "complexity"], "left").join(typed, "task_type", "left").withColumn("one", F.lit(1)).join(general, "one", "left").drop("one")
    rank = F.when(F.col("c1").isNotNull(), 1).when(F.col("c2").isNotNull(), 2).when(F.col("c3").isNotNull(), 3)
    return joined.withColumn("config", F.coalesce("c1", "c2", "c3")).withColumn("rank", rank).drop("c1", "c2", "c3")


def math_macros(text: Column) -> Column:
    """LaTeX between dollar signs as a wiki's math macros: ``$$...$$`` as blocks, ``$...$`` in the line."""
    blocks = F.regexp_replace(text, r"\$\$([^$]+)\$\$", "{mathblock}$1{mathblock}")
    return F.regexp_replace(blocks, r"\$([^$\n]+)\$", "{mathinline}$1{mathinline}")


def markdown_html(text: Column) -> Column:
    """Headings, bold and italic words, list items and paragraphs of Markdown as HTML, a line each."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def line(x: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(x, r"\*\*([^*]+)\*\*", "<b>$1</b>"), r"\*([^*]+)\*", "<i>$1</i>")
        depth = F.length(F.regexp_extract(marked, r"^(#{1,6}) ", 1))
        tag = F.concat(F.lit("h"), depth.cast("string"))
        heading = F.concat(F.lit("<"), tag, F.lit(">"), F.regexp_replace(marked, r"^#{1,6} ", ""), F.lit("</"), tag, F.lit(">"))
        item = F.concat(F.lit("<li>"), F.regexp_replace(marked, r"^- ", ""), F.lit("</li>"))
        return F.when(depth > 0, heading).when(marked.startswith("- "), item).otherwise(F.concat(F.lit("<p>"), marked, F.lit("</p>")))

    return F.array_join(F.transform(F.filter(F.transform(F.split(escaped, "\n"), strip), lambda x: x != ""), line), "")


def sentences(text: Column) -> Column:
    """Sentences with their end marks, white space between them dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), strip), lambda s: s != "")


def table_cells(row: Column) -> Column:
    r"""Cells of a Markdown table row; an escaped bar ``\|`` stays in its cell."""
    inner = F.regexp_replace(strip(row), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def table_row(cells: list[Column]) -> Column:
    """A Markdown table row of cells: white space as one space, bars escaped."""
    clean = [F.replace(strip(F.regexp_replace(c, r"\s+", " ")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
