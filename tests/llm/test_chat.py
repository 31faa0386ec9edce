import random

from pyspark.sql import functions as F

from tessella.llm import chat
from tests.compare import spark_rows, sql_rows


def test_query_equals_sql(spark, data):
    assert spark_rows(chat.op2_chat_format(spark, data)) == sql_rows(chat.OP2_SQL, data)


def test_texts_and_roles_are_read_back(spark):
    r = random.Random(4)
    marks = ["\\", "\n", "<", "<|im_end|>\n", "<|im_start|>", "</s>", "[INST]", "[[INST]", "<<SYS>>", "a", "\\\\<|", "🙂", ""]
    rows = [(c, n, "".join(r.choices(marks, k=2)), "".join(r.choices(marks, k=r.randrange(0, 9)))) for c in range(40) for n in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    got = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert {g.conv_id: [(x.role, x.text) for x in g.t] for g in got} == {c: [(a, t) for i, _, a, t in rows if i == c] for c in range(40)}
    for g in got:  # control strings of the texts are all broken up
        body = g.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert g.formatted.count("<|im_end|>") == 4 and not any(m in body for m in ("</s>", "[INST]", "<<SYS>>"))


def test_automaton_and_mask(spark, empty):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "A<s>"), (2, 0, "user", "u"), (2, 1, "user", "u"), (3, 0, "user", "x"), (4, 0, "assistant", "y"), (5, None, None, None), (None, 1, "user", "n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: (r.valid, r.lost) for r in chat.format_chats(df).select("conv_id", "valid", chat.loss_text(F.col("pieces")).alias("lost")).collect()}
    assert got == {1: (True, "A<s>"), 2: (False, ""), 3: (False, ""), 4: (False, "y"), 5: (False, ""), None: (False, "")}
    assert chat.format_chats(df.where("false")).count() == 0
    s = chat.segments(df.where("conv_id = 1")).orderBy("position", "part").collect()
    assert [x.start for x in s] == [sum(len(y.segment) for y in s[:i]) for i in range(len(s))]


def test_ties_repeated_rows_and_very_long_texts(spark):
    """Two rows of one turn go by role, then text; repeated rows are turns each; a long text with control strings all over comes back whole."""
    long = "</s>[INST] ok [/INST] \\ word " * 20_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "x"), (1, 1, "assistant", "y"), (1, 1, "assistant", "y"), (2, 0, "user", "q"), (2, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_chats(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("pieces")).alias("lost")).collect()
    turns = {r.conv_id: [(x.role, x.text) for x in r.t] for r in got}
    assert turns == {1: [("assistant", "x"), ("user", "a"), ("user", "b"), ("assistant", "y"), ("assistant", "y")], 2: [("user", "q"), ("assistant", long)]}
    assert {r.conv_id: r.lost for r in got} == {1: "xyy", 2: long}


def test_no_python_in_the_plan(spark, data):
    plan = chat.op2_chat_format(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
