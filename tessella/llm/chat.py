"""Chat formatting in DataFrame operations alone: a role automaton, a declarative template, and segments with loss flags.

A template names the control strings around a turn. Texts may hold the same strings; they are escaped by a backslash
after their first character, and backslashes are doubled, so every control string left in the output is a mark and the
texts can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, the roles whose texts are trained on, and the automaton's moves from one role to the next."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Control strings of other templates and tokenizers that texts must not bring in either.
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    start: str = "(start)"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"(start)": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> tuple[str, ...]:
        return (self.turn_start, self.turn_end.rstrip("\n"), *self.reserved)


CHAT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = CHAT) -> Column:
    """Backslashes doubled, and one put after the first character of each control string."""
    inside = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), inside, r"\\")


def escape_role(role: Column, template: ChatTemplate = CHAT) -> Column:
    """As a text, with the end of the role's line escaped too."""
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def segments(conversations: DataFrame, template: ChatTemplate = CHAT) -> DataFrame:
    """conv_id, position, part, turn_role, segment, loss, start, move_ok: three segments a turn, and where each starts.

    Turns are ordered by turn, then role and text, so ties and repeated rows have a defined order. Null roles and texts
    are empty; very long texts are formatted whole; rows with a null conv_id form one conversation; other columns,
    whatever their names, are ignored; an empty table stays empty.
    move_ok says whether the automaton allows the turn after the one before it, and for the last turn, an end there.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    moves = F.create_map(*(x for a, bs in template.moves.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    last = F.lead(F.lit(1)).over(order).isNull()
    turns = c.select(
        "conv_id", "role", "text",
        F.row_number().over(order).alias("position"),
        F.lag("role", 1, template.start).over(order).alias("before"),
        last.alias("last"),
    )
    allowed = F.coalesce(F.array_contains(F.try_element_at(moves, F.col("before")), F.col("role")), F.lit(False))
    ok = allowed & (~F.col("last") | F.col("role").isin(*template.accepting))
    head = F.concat(F.lit(template.turn_start), escape_role(F.col("role"), template), F.lit(template.role_end))
    piece = lambda text, loss: F.struct(text.alias("segment"), loss.alias("loss"))
    pieces = F.array(piece(head, F.lit(False)), piece(escape(F.col("text"), template), F.col("role").isin(*template.loss_roles)), piece(F.lit(template.turn_end), F.lit(False)))
    split = turns.select("conv_id", "position", F.col("role").alias("turn_role"), ok.alias("move_ok"), F.posexplode(pieces).alias("part", "p")).select("conv_id", "position", "part", "turn_role", "p.segment", "p.loss", "move_ok")
    upto = W.partitionBy("conv_id").orderBy("position", "part").rowsBetween(W.unboundedPreceding, -1)
    return split.withColumn("start", F.coalesce(F.sum(F.char_length("segment")).over(upto), F.lit(0)))


def format_chats(conversations: DataFrame, template: ChatTemplate = CHAT) -> DataFrame:
    """A row for each conversation: conv_id, formatted (its whole text), pieces (segment and loss flag, in order) and valid.

    One output text needs its conversation in one row; conversations are spread by id.
    """
    rows = segments(conversations, template)
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "part", "segment", "loss"))).alias("s"), F.min("move_ok").alias("valid"))
    return gathered.select("conv_id", F.array_join(F.col("s.segment"), "").alias("formatted"), F.transform("s", lambda x: F.struct(x.segment.alias("segment"), x.loss.alias("loss"))).alias("pieces"), "valid")


def read_turns(formatted: Column, template: ChatTemplate = CHAT) -> Column:
    """array<struct<role, text>> of a formatted conversation: the inverse of the template."""
    blocks = F.filter(F.split(formatted, re.escape(template.turn_end)), lambda b: b != "")
    body = F.transform(blocks, lambda b: F.substr(b, F.lit(len(template.turn_start) + 1)))
    # the role ends at the first line end without a backslash before it: roles have every backslash paired or escaping
    role = lambda b: F.regexp_extract(b, r"^((?:[^\\\n]|\\[\s\S])*+)\n", 1)
    return F.transform(body, lambda b: F.struct(unescape(role(b)).alias("role"), unescape(F.substr(b, F.char_length(role(b)) + len(template.role_end) + 1)).alias("text")))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p.loss), lambda p: unescape(p.segment)), "")


def probe_conversation(spark) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chats = format_chats(given.unionByName(probe_conversation(spark)))
    back = chats.select("conv_id", "valid", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("pieces")).alias("lost"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


OP2_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marks AS (SELECT unnest(['<|im_start|>', '<|im_end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|endoftext|>', '\']) AS mark),
moves AS (SELECT unnest(['(start)', '(start)', 'system', 'user', 'assistant']) AS a, unnest(['system', 'user', 'user', 'assistant', 'user']) AS b),
turns AS (
  SELECT *, row_number() OVER w AS pos, lag(role, 1, '(start)') OVER w AS before, lead(1) OVER w IS NULL AS is_last
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
  SELECT t.*,
    (SELECT sum((length(t.text) - length(replace(t.text, mark, ''))) // length(mark)) FROM marks)
      + (SELECT sum((length(t.role) - length(replace(t.role, mark, ''))) // length(mark)) FROM marks)
      + (length(t.role) - length(replace(t.role, chr(10), ''))) AS added,
    EXISTS (SELECT 1 FROM moves WHERE a = t.before AND b = t.role) AND (NOT is_last OR role = 'assistant') AS ok
  FROM turns t),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS lines,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS lost,
    sum(length(role) + length(text) + added + 24) AS formatted_chars, bool_and(ok) AS valid
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(lost) AS loss_chars, sha256(lost) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, valid FROM joined
"""
