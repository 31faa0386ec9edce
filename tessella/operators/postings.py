"""An inverted index in blocks, and BM25 over it that skips the blocks which cannot reach the best.

The index is a folder. Documents are numbered and cut into parts of PART; ``blocks`` has a row for each term and part with the
term's postings there (ids, counts, sizes), the largest count and the smallest size among them, under a partition by the
term's hash. So no row grows with the number of documents, however common its term is, and a query reads only the
partitions of its own terms. Documents are added by more parts.

A part's best possible score for a query is the sum over its terms of what the largest count in the smallest document
would give. The parts with the best possible scores are scored first; then every part whose best possible score is under the
k-th score found so far is left unread. As each of the k first parts has a document near its best possible score, that is a
high threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.ordering import numbered
from tessella.operators.relational import top_per_key
from tessella.operators.retrieval import term_table
from tessella.runtime import materialize

PART, BUCKETS = 256, 64
#: Copies of the queries' terms that meet a term's blocks, so that a common term is not one key.
SALTS = 16


@dataclass
class Index:
    """The tables of an index at a path."""

    spark: SparkSession
    path: str

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def add_documents(spark: SparkSession, path: str, docs: DataFrame, part: int = PART) -> Index:
    """Index (doc_id, text) rows, number or text ids; the first call makes the index. Documents must be new."""
    index = Index(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/documents")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    first = (index.documents.agg(F.max("part")).first()[0] or 0) + 1 if there else 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.concat_ws(":", F.col("number").cast("string"), F.col("doc_id").cast("string")).alias("doc_id")  # so that terms need no join to get their part
    given = numbered(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "number").select(key, "text")
    number = F.substring_index("id", ":", 1)
    own = [F.expr("substring(id, locate(':', id) + 1)").cast(kind).alias("id"), (first + F.floor(number.cast("long") / part)).alias("part")]
    rows = materialize(term_table(given).select(*own, "term", "tf", "size"), "terms")
    blocks = rows.groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "size"))).alias("x"), F.max("tf").alias("most_tf"), F.min("size").alias("least_size"))
    columns = ["term", "part", F.size("x").alias("n"), "most_tf", "least_size", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), F.col("x.size").alias("sizes")]
    blocks.select(*columns, bucket(F.col("term")).alias("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "part").write.mode("append").partitionBy("bucket").parquet(f"{path}/blocks")
    sizes = given.select(F.col("doc_id").alias("id")).select(*own).join(rows.groupBy("id", "part").agg(F.max("size").alias("size")), ["id", "part"], "left")
    sizes.select("id", "part", F.coalesce("size", F.lit(0)).alias("size")).write.mode("append").parquet(f"{path}/documents")
    return index


def bm25_over_index(queries: DataFrame, index: Index, top_k: int = 5, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, skip: bool = True) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (query_id, part, bound, read)): the same rows as ``bm25_search``, and which parts were read for them.

    Queries are (id, text). ``skip`` off reads all parts that hold a term of the query.
    """
    blocks = index.blocks
    n, total = index.documents.agg(F.count("*"), F.sum("size")).first()
    mean_size = (total or 0) / max(n, 1) or 1.0
    raw = materialize(blocks.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")), "idf")
    mean_idf = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") < 0, F.lit(floor * mean_idf)).otherwise(F.col("raw"))
    q = term_table(queries, "id", "text").select(F.col("id").alias("query_id"), "term", F.col("tf").alias("times")).join(raw.select("term", idf.alias("idf")), "term")
    q = materialize(q.withColumn("bucket", bucket(F.col("term"))), "asked")
    buckets = [r.bucket for r in q.select("bucket").distinct().collect()]  # at most BUCKETS
    gives = lambda tf, size: F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_size))
    held = blocks.where(F.col("bucket").isin(buckets)).join(q.select("term").distinct(), "term", "left_semi").withColumn("salt", F.pmod("part", F.lit(SALTS)).cast("int"))
    asked = q.drop("bucket").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    bound = F.greatest(gives(F.col("most_tf"), F.col("least_size")), F.lit(0.0))
    bounds = held.select("term", "salt", "part", "most_tf", "least_size").join(asked, ["term", "salt"]).groupBy("query_id", "part").agg(F.sum(bound).alias("bound"))
    bounds = materialize(bounds, "bounds")

    def scored(chosen: DataFrame) -> DataFrame:
        """(query_id, id, raw_score) of all documents of the chosen (query_id, part) that hold a term."""
        wanted = chosen.select("query_id", "part").join(q.drop("bucket"), "query_id")
        met = held.join(wanted, ["term", "part"]).select("query_id", "times", "idf", F.explode(F.arrays_zip("ids", "tfs", "sizes")).alias("x"))
        return met.groupBy("query_id", F.col("x.ids").alias("id")).agg(F.sum(gives(F.col("x.tfs"), F.col("x.sizes"))).alias("raw_score"))

    if skip:
        first = top_per_key(bounds, ["query_id"], [F.desc("bound"), F.col("part")], top_k).drop("rank")
        known = top_per_key(scored(first), ["query_id"], [F.desc("raw_score"), F.col("id")], top_k)
        least = known.groupBy("query_id").agg(F.min("raw_score").alias("kth"), F.max("raw_score").alias("best"), F.count("*").alias("found"))
        # scores are rounded to a millionth of the best one, so parts that could tie by that are read too
        close = F.when(F.col("found") >= top_k, F.col("kth") - 2e-6 * F.abs("best")).otherwise(F.lit(float("-inf")))
        bounds = materialize(bounds.join(least.select("query_id", close.alias("least")), "query_id", "left").select("query_id", "part", "bound", (F.col("bound") >= F.coalesce("least", F.lit(float("-inf")))).alias("read")), "bounds")
    else:
        bounds = bounds.withColumn("read", F.lit(True))
    summed = materialize(scored(bounds.where("read")), "scores")
    best = summed.groupBy("query_id").agg(F.max("raw_score").alias("best"))
    share = F.round(F.when(F.col("best") > 0, F.col("raw_score") / F.col("best")).otherwise(F.col("raw_score")), 6)
    found = summed.join(best, "query_id").select("query_id", "id", share.alias("score"))
    return top_per_key(found, ["query_id"], [F.desc("score"), F.col("id")], top_k), bounds
