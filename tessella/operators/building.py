"""From documents to the tables of a knowledge base, building only what is new or changed.

A base is a folder. Each run writes its chunks, nodes, edges and memories under its own number, and at last a manifest: for every
document its size, time, digest and the run that built it. The manifest is what counts: readers take a document's
rows from the run that it names, so a run that breaks leaves the last whole base, and its leftovers are written over by the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.embedding import DEFAULT, dimension, embedded
from tessella.operators.chunking import SEPARATOR, heading_sections, length_chunks, level
from tessella.operators.statistics import merged_statistics, run_statistics
from tessella.runtime import materialize

MANIFEST = "path string, document_name string, size long, modified timestamp, digest string, run long"
TABLES = ("chunks", "nodes", "edges", "memories")
#: Chunks of a document that become memories.
MEMORIES = 5


@dataclass(frozen=True)
class Options:
    size: int = 1000
    overlap: int = 100
    embedding: str = DEFAULT
    memories: int = MEMORIES


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def last_run(spark: SparkSession, base: str) -> int:
    """Number of the last run that ended; 0 if none did."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return max((int(n.split("=")[1]) for n in names if n.startswith("run=") and _exists(spark, f"{base}/manifest/{n}/_SUCCESS")), default=0)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    run = last_run(spark, base)
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest/run={run}") if run else spark.createDataFrame([], MANIFEST)


def read_base(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table of the base as its manifest has it; only the folders of runs that still hold a document are read."""
    known = manifest(spark, base)
    runs = [r.run for r in known.select("run").distinct().collect()]  # a number a run
    rows = spark.read.option("basePath", f"{base}/{table}").parquet(*(f"{base}/{table}/run={r}" for r in sorted(runs)))
    kept = known.select("document_name", F.col("run").cast("long").alias("run"))
    return rows.withColumn("run", F.col("run").cast("long")).join(kept, ["document_name", "run"], "left_semi").drop("run")


def statistics(spark: SparkSession, base: str) -> DataFrame:
    """Merged statistics of the runs that ended. A document that was built twice counts twice: sketches cannot forget."""
    runs = [r for r in range(1, last_run(spark, base) + 1) if _exists(spark, f"{base}/manifest/run={r}/_SUCCESS")]
    return merged_statistics(spark.read.parquet(*(f"{base}/statistics/run={r}" for r in runs)))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (path, size, modified) that the manifest lacks or has with another size or time."""
    old = known.select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    return found.join(old, "path", "left").where(~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("modified").eqNullSafe(F.col("old_modified"))).drop("old_size", "old_modified")


def chunk_documents(texts: DataFrame, options: Options = Options()) -> DataFrame:
    """Chunks of (document_name, text): by headings where a text has some, then by length within each section; with vectors of text and path."""
    lines = texts.select(F.col("document_name").alias("doc"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    sections = heading_sections(lines).select(F.col("doc").alias("document_name"), "section", "heading", "hierarchy", "corpus")
    whole = texts.join(sections.select("document_name").distinct(), "document_name", "left_anti")
    name = F.col("document_name")
    plain = whole.select(name, F.lit(0).alias("section"), name.alias("heading"), name.alias("hierarchy"), F.col("text").alias("corpus"))
    all_ = sections.withColumn("section", F.col("section").cast("int")).unionByName(plain).withColumn("part", F.struct("document_name", "section", "heading", "hierarchy"))
    cut = length_chunks(all_, options.size, options.overlap, "part", "corpus").select("part.*", "chunk_no", "corpus")
    reference = F.concat_ws(" ", "document_name", F.concat(F.col("section").cast("string"), F.lit("."), (F.col("chunk_no") + 1).cast("string")))
    rows = cut.withColumn("reference", reference).withColumn("chunk_id", F.substring(F.sha2("reference", 256), 1, 16)).withColumn("level", level("hierarchy"))
    vectors = rows.withColumn("corpus_vector", embedded("corpus", options.embedding)).withColumn("hierarchy_vector", embedded("hierarchy", options.embedding))
    return vectors.withColumn("embedding_model", F.lit(options.embedding))


def graph_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (document_name, node, node_type, label) and CONTAINS edges (document_name, src, dst, edge_type) of documents, the sections on each path, and chunks."""
    section = lambda doc, path: F.concat(F.lit("section_"), F.substring(F.sha2(F.concat_ws("\n", doc, path), 256), 1, 16))
    steps = F.split("hierarchy", SEPARATOR)
    paths = chunks.select("document_name", "hierarchy").distinct().withColumn("steps", steps)
    prefix = lambda n: F.array_join(F.slice("steps", 1, n), SEPARATOR)
    each = paths.select("document_name", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth"))
    each = each.select("document_name", "depth", prefix(F.col("depth")).alias("path"), F.element_at("steps", F.col("depth")).alias("label"), F.when(F.col("depth") > 1, prefix(F.col("depth") - 1)).alias("above")).distinct()
    doc = F.concat(F.lit("document_"), F.col("document_name"))
    sections = each.select("document_name", section(F.col("document_name"), F.col("path")).alias("node"), F.lit("Section").alias("node_type"), "label")
    docs = chunks.select("document_name").distinct().select("document_name", doc.alias("node"), F.lit("Document").alias("node_type"), F.col("document_name").alias("label"))
    leaves = chunks.select("document_name", F.concat(F.lit("chunk_"), "chunk_id").alias("node"), F.lit("Chunk").alias("node_type"), F.col("reference").alias("label"))
    above = F.coalesce(section(F.col("document_name"), F.col("above")), doc)
    edges = each.select("document_name", F.when(F.col("above").isNull(), doc).otherwise(above).alias("src"), section(F.col("document_name"), F.col("path")).alias("dst"))
    edges = edges.unionAll(chunks.select("document_name", section(F.col("document_name"), F.col("hierarchy")), F.concat(F.lit("chunk_"), "chunk_id")))
    return docs.unionAll(sections).unionAll(leaves), edges.withColumn("edge_type", F.lit("CONTAINS"))


def episodes(chunks: DataFrame, most: int = MEMORIES) -> DataFrame:
    """Memories (document_name, memory_id, query, entity, context) from the first ``most`` chunks of each document."""
    order = W.partitionBy("document_name").orderBy("section", "chunk_no")
    first = chunks.select("document_name", "section", "chunk_no", "chunk_id", "hierarchy", "reference", "corpus").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    context = F.to_json(F.struct("reference", "corpus"))
    return first.select("document_name", F.concat(F.lit("mem_"), "chunk_id").alias("memory_id"), F.concat(F.lit("What does "), "hierarchy", F.lit(" say?")).alias("query"), F.col("document_name").alias("entity"), context.alias("context"))


def build(spark: SparkSession, found: DataFrame, read: Callable[[DataFrame], DataFrame], base: str, options: Options = Options()) -> dict[str, int]:
    """Bring a base up to documents ``found`` (path, document_name, size, modified); counts of what was done.

    ``read`` gives (path, text) of the documents that it is given, and is given the new and changed ones only. A changed document
    replaces its rows, one that was touched but has the same digest keeps them, one that is gone goes. Of paths with one
    name the first is built.
    """
    dimension(options.embedding)  # an unknown name is an error before anything is written
    known, run = manifest(spark, base), last_run(spark, base) + 1
    found = found.groupBy("document_name").agg(F.min_by(F.struct("path", "size", "modified"), F.col("path")).alias("f")).select("document_name", "f.*")
    found = materialize(found, "found")
    todo = materialize(changed(found, known), "changed")
    texts = read(todo).select("path", F.coalesce("text", F.lit("")).alias("text")).join(todo, "path")
    texts = materialize(texts.withColumn("digest", F.sha2("text", 256)), "texts")
    same = known.select("document_name", "digest", F.col("run").alias("built"))
    state = texts.drop("text").join(same, ["document_name", "digest"], "left")
    fresh = texts.join(state.where("built IS NULL").select("document_name"), "document_name", "left_semi")
    chunks = materialize(chunk_documents(fresh.select("document_name", "text"), options), "chunks")
    nodes, edges = graph_of(chunks)
    for name, table in zip(TABLES, (chunks, nodes, edges, episodes(chunks, options.memories)), strict=True):
        table.write.mode("overwrite").parquet(f"{base}/{name}/run={run}")
    run_statistics(fresh.select("text"), run).write.mode("overwrite").parquet(f"{base}/statistics/run={run}")
    columns = [F.col(c.split()[0]) for c in MANIFEST.split(", ")]
    kept = known.join(found.select("path"), "path", "left_semi").join(todo.select("path"), "path", "left_anti").select(*columns)
    new = state.withColumn("run", F.coalesce("built", F.lit(run)).cast("long")).select(*columns)
    after = materialize(kept.unionByName(new), "manifest")
    after.write.mode("overwrite").parquet(f"{base}/manifest/run={run}")
    counts = state.agg(F.count("*").alias("read"), F.count(F.when(F.col("built").isNull(), 1)).alias("built")).first()
    return {"run": run, "read": counts["read"], "built": counts["built"], "kept": kept.count(), "gone": known.join(found.select("path"), "path", "left_anti").count(), "chunks": chunks.count()}


def build_folder(spark: SparkSession, folder: str, base: str, options: Options = Options()) -> dict[str, int]:
    """Build from the Markdown and text files below a folder; unchanged files are listed, not read; empty files are not listed."""
    from tessella.sources.files import discover_documents

    def read(todo: DataFrame) -> DataFrame:
        paths = [r.path for r in todo.select("path").toLocalIterator()]  # no more than Spark's own listing of the folder
        if not paths:
            return spark.createDataFrame([], "path string, text string")
        return spark.read.format("binaryFile").load(paths).select("path", F.decode("content", "UTF-8").alias("text"))

    return build(spark, discover_documents(spark, folder).where("lower(extension) IN ('md', 'txt')").select("path", "document_name", "size", "modified"), read, base, options)
