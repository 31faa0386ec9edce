"""Merkle manifest of a dataset: a tree of digests over each group's rows, one over the groups, and a proof for every row.

Digests are sha256. A level is a table of nodes (key, idx, n, d). Nodes whose idx is a multiple of the arity are slot zero
of a run; they meet their siblings by equi-joins on the computed index (own index plus the slot), and then emit the
parent. Proofs go the other way: each run hands its path to the root down to its nodes. No level, group or run of equal
keys is ever gathered in one task; a level has 1 / arity of the rows of the one below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.rows import named
from tessella.operators.ordering import ordinals
from tessella.runtime import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: binary, after: binary>>"


def field(value: Column) -> Column:
    """A value so that a sequence of them reads in one way only: ``-`` for null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The runs of every level above ``nodes`` (key, idx, n, d): (key, idx, n, d) of the parent and the digests d0, d1, ... of its nodes."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    found = []
    while most > 1:
        open_ = nodes.where("n > 1")
        runs = open_.where(F.col("idx") % arity == 0).withColumnRenamed("d", "d0")
        for slot in range(1, arity):
            sibling = open_.where(F.col("idx") % arity == slot).select("key", (F.col("idx") - slot).alias("idx"), F.col("d").alias(f"d{slot}"))
            runs = runs.join(sibling, ["key", "idx"], "left")
        slots = [f"d{i}" for i in range(arity)]
        up = F.unhex(F.sha2(F.concat_ws("", *(hex_of(F.col(c)) for c in slots)), 256))
        runs = runs.select("key", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), up.alias("d"), *slots)
        found.append(materialize(runs, "runs"))
        nodes, most = found[-1].select("key", "idx", "n", "d"), -(-most // arity)
    return found


def roots(leaves: DataFrame, found: list[DataFrame], level: int) -> DataFrame:
    """(key, idx, d) of the trees that end at a level: 0 is that of the leaves."""
    return (found[level - 1] if level else leaves).where("n = 1").select("key", "idx", "d")


def _step(slot: Column, arity: int) -> Column:
    """The path entry of the node at a slot: the digests of its run before and after it."""
    digest = lambda i: F.coalesce(F.col(f"d{i}"), F.lit(b""))
    nothing = F.lit(b"")
    before = F.concat(nothing, *(F.when(slot > i, digest(i)).otherwise(nothing) for i in range(arity)))
    after = F.concat(nothing, *(F.when(slot < i, digest(i)).otherwise(nothing) for i in range(arity)))
    return F.struct(before.alias("before"), after.alias("after"))


def paths(leaves: DataFrame, found: list[DataFrame], tails: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` with path, the siblings from the leaf to beyond its tree's root, and the columns of ``tails``.

    ``tails`` has a row (key, path, ...) for each tree, with the path that leads on from its root.
    """
    kept = [c for c in tails.columns if c not in ("key", "path")]
    joined = None  # (key, idx, path, ...) of the nodes of a level
    for level in range(len(found), 0, -1):
        ends = roots(leaves, found, level).select("key", "idx").join(tails, "key")
        joined = ends if joined is None else joined.unionByName(ends)
        runs = found[level - 1].drop("n", "d").join(joined, ["key", "idx"])
        if level > 1:
            slot, own = F.col("slot"), F.element_at(F.array(*(f"d{i}" for i in range(arity))), F.col("slot") + 1)
            each = runs.withColumn("slot", F.explode(F.array(*map(F.lit, range(arity))))).where(own.isNotNull())
            below = each.select("key", (F.col("idx") * arity + slot).alias("idx"), F.concat(F.array(_step(slot, arity)), "path").alias("path"), *kept)
            joined = materialize(below, "paths")
    alone = leaves.where("n = 1").join(tails, "key")
    if joined is None:
        return alone
    slot = (F.col("at") % arity).cast("int")
    many = leaves.where("n > 1").withColumn("at", F.col("idx")).withColumn("idx", F.floor(F.col("at") / arity)).join(runs, ["key", "idx"])
    many = many.withColumn("path", F.concat(F.array(_step(slot, arity)), "path")).withColumn("idx", F.col("at")).drop("at", *(f"d{i}" for i in range(arity)))
    return many.unionByName(alone)


def fold(digest: Column, path: Column) -> Column:
    """The root, in hex, that a row's digest and its path of siblings lead to."""
    return F.aggregate(path, hex_of(digest), lambda x, s: F.sha2(F.concat(hex_of(s.before), x, hex_of(s.after)), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.aggregate(path, F.lit(""), lambda x, s: F.concat(x, hex_of(s.before), hex_of(s.after))), 256)


def manifest(docs: DataFrame, order: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, more: dict[str, Column] | None = None) -> DataFrame:
    """order, group, leaf, subroot, root (binary), path of every row, and ``more`` columns computed from the row.

    Leaves of a group ascend by ``order``, nulls first, ties by their digest; groups ascend bytewise, null first. Nulls and
    empty texts have digests of their own, texts are hashed whole where they are read and not shuffled, repeated rows are
    leaves of their own, an empty table has an empty manifest, and columns beside ``fields`` do not count.
    """
    key = F.coalesce(F.concat(F.lit("1"), named(group).cast("string")), F.lit("0"))
    own = docs.select(named(order).alias("order"), named(group).alias("group"), key.alias("key"), row_digest([named(c) for c in fields]).alias("d"), *(c.alias(n) for n, c in (more or {}).items()))
    leaves = materialize(ordinals(materialize(own, "leaves"), "key", ["order", "d"]), "leaves")
    found = levels(leaves, arity)
    tops = reduce(DataFrame.unionByName, (roots(leaves, found, i) for i in range(len(found) + 1))).select(F.lit("").alias("all"), F.col("key").alias("own"), F.col("d"))
    tops = materialize(ordinals(tops, "all", ["own"]).withColumnRenamed("all", "key"), "subroots")
    above = levels(tops, arity)
    top = roots(tops, above, len(above)).first()
    ends = tops.sparkSession.createDataFrame([("", [])], f"key string, path {PATH}")
    tails = paths(tops, above, ends, arity).select(F.col("own").alias("key"), F.col("d").alias("subroot"), "path")
    tails = materialize(tails, "tails")
    proven = paths(leaves, found, tails, arity)
    root = F.lit(bytes(top.d)) if top else F.lit(None).cast("binary")
    return proven.select(F.col("order").alias(order), F.col("group").alias(group), F.col("d").alias("leaf"), "subroot", root.alias("root"), "path", *(more or {}))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """A row with a null doc_id is never tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = row_digest([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS])
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut)
    found = manifest(docs, more={"altered": altered})
    folded = found.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    digests = [hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return folded.select("doc_id", *digests, proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == hex_of(F.col("root"))).alias("verified"))


#: One step of CRC-32 a bit, over the digits of the id.
_CRC = "list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
_FIELDS = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
_CUT = _FIELDS.replace("CAST(text AS VARCHAR)", "replace(text, chr(10), '')")


def _tree(name: str, leaves: str) -> str:
    """Recursive SQL of the nodes (k, lvl, idx, d, n) above a table of leaves (k, idx, d, n), and of the siblings of each."""
    return f"""{name} AS (SELECT k, 0 AS lvl, idx, d, n FROM {leaves}
      UNION ALL SELECT k, lvl + 1, idx // {ARITY}, sha256(string_agg(d, '' ORDER BY idx)), any_value((n + {ARITY - 1}) // {ARITY}) FROM {name} WHERE n > 1 GROUP BY k, lvl, idx // {ARITY}),
    {name}_sides AS (SELECT a.k, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
      FROM {name} a JOIN {name} b ON a.k = b.k AND a.lvl = b.lvl AND a.idx // {ARITY} = b.idx // {ARITY} WHERE a.n > 1 GROUP BY a.k, a.lvl, a.idx)"""


OP13_SQL = f"""
WITH RECURSIVE rows AS (SELECT doc_id, source, coalesce('1' || source, '0') AS k, sha256({_FIELDS}) AS d,
    CASE WHEN doc_id IS NOT NULL AND ({_CRC} & 1) = 1 THEN sha256({_CUT}) END AS cut FROM documents),
leaves AS (SELECT doc_id, k, d, cut, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM rows),
{_tree("low", "leaves")},
sub AS (SELECT '' AS k, k AS own, d, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "sub")},
path AS (SELECT own AS k, s.lvl + 1000 AS lvl, s.before, s.after, NULL AS idx FROM sub JOIN high_sides s ON s.idx = sub.idx // CAST(pow({ARITY}, s.lvl) AS BIGINT)),
steps AS (SELECT l.doc_id, l.k, l.idx, list(struct_pack(b := before, a := after) ORDER BY lvl) AS p FROM leaves l JOIN
    (SELECT k, lvl, idx, before, after FROM low_sides UNION ALL SELECT k, lvl, idx, before, after FROM path) s
    ON l.k = s.k AND (s.idx IS NULL OR s.idx = l.idx // CAST(pow({ARITY}, s.lvl) AS BIGINT)) GROUP BY ALL),
done AS (SELECT l.doc_id, l.d AS leaf, sub.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root, coalesce(p, []) AS p, coalesce(cut, l.d) AS given
    FROM leaves l JOIN sub ON sub.own = l.k LEFT JOIN steps s ON s.k = l.k AND s.idx = l.idx),
folded AS (SELECT *, list_reduce([struct_pack(b := '', a := given)] || p, lambda x, s: struct_pack(b := '', a := sha256(s.b || x.a || s.a))).a AS folded_root FROM done)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce([''] || list_transform(p, lambda s: s.b || s.a), lambda x, y: x || y)) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
