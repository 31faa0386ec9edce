"""Readers and writers of document folders, tables and graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.text import document_stem

HEADINGS = T.StructType([T.StructField("Level", T.StringType()), T.StructField("Heading", T.StringType()), T.StructField("File", T.StringType()), T.StructField("Index", T.IntegerType())])


def discover_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, extension, size and time of each pdf, md and txt file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,md,txt}").load(folder)
    return files.select("path", document_stem("path").alias("document_name"), F.regexp_extract("path", r"\.([^.]+)$", 1).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def not_built(found: DataFrame, built: DataFrame) -> DataFrame:
    """Documents that no built table has yet."""
    return found.join(built.select("document_name").distinct(), "document_name", "left_anti")


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file as one string."""
    return spark.read.option("wholetext", True).text(paths).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc, pos, line) of text files, for heading_sections."""
    texts = read_texts(spark, paths)
    return texts.select(document_stem("path").alias("doc"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))


def capital_headings(line: str = "line"):
    """Short upper-case lines of converted documents as Markdown headings."""
    short = (F.length(line) < 100) & (F.upper(line) == F.col(line)) & F.col(line).rlike("[A-Z]")
    return F.when(short, F.concat(F.lit("## "), F.trim(line))).otherwise(F.col(line))


def read_headings(spark: SparkSession, path: str) -> DataFrame:
    """The heading list; levels that are no number and blank headings are dropped."""
    rows = spark.read.csv(path, header=True, schema=HEADINGS)
    return rows.select(F.expr("try_cast(Level AS int)").alias("level"), F.trim("Heading").alias("heading"), F.col("File").alias("file"), F.col("Index").alias("idx")).where("level IS NOT NULL AND heading <> ''")


def read_checked(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A Parquet table that has the required columns."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def newest(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The newest file of each key, from discover_documents or a table like it."""
    w = W.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("modified"), "path")
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, arrays as strings."""
    text = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*text).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with values coerced to the schema; what does not fit becomes null."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True)


def delete_table(spark: SparkSession, path: str) -> bool:
    """Delete a table's folder or file; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def routed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files by extension: (accepted with a route, rejected with a reason). Markdown and text pass, PDF is to be converted."""
    route = F.when(F.lower("extension").isin("md", "txt"), "read").when(F.lower("extension") == "pdf", "convert")
    marked = files.withColumn("route", route)
    return marked.where("route IS NOT NULL"), marked.where("route IS NULL").drop("route").withColumn("reason", F.concat(F.lit("unsupported: "), F.coalesce(F.nullif("extension", F.lit("")), F.lit("no extension"))))


def resolve_graph(spark: SparkSession, graph: str | tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables from a path or as they are."""
    return read_graph(spark, graph) if isinstance(graph, str) else graph


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of the schema where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


PLAN = "struct<nodes: map<string, struct<prompt_id: string, task_summary: string>>, edges: array<struct<source: string, target: string>>>"


def plan_tables(plans: DataFrame, key: str = "plan_id", text: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of plans given as JSON; a plan without nodes or edges, or that is no JSON, is a reject with its reason."""
    read = plans.select(key, F.from_json(text, PLAN).alias("p"))
    reason = F.when(F.col("p.nodes").isNull() & F.col("p.edges").isNull(), "not a plan").when(F.col("p.nodes").isNull(), "no nodes").when(F.col("p.edges").isNull(), "no edges")
    good = read.where(reason.isNull())
    nodes = good.select(key, F.explode("p.nodes").alias("node", "n")).select(key, "node", "n.prompt_id", "n.task_summary")
    edges = good.select(key, F.explode("p.edges").alias("e")).select(key, F.col("e.source").alias("src"), F.col("e.target").alias("dst"))
    return nodes, edges, read.select(key, reason.alias("reason")).where("reason IS NOT NULL")


LIBRARY = "map<string, map<string, map<string, struct<description: string, template: string>>>>"


def library_rows(libraries: DataFrame, text: str = "json") -> DataFrame:
    """(application, category, action, description, template) of a prompt library given as nested JSON."""
    a = libraries.select(F.explode(F.from_json(text, LIBRARY)).alias("application", "c"))
    b = a.select("application", F.explode("c").alias("category", "x"))
    return b.select("application", "category", F.explode("x").alias("action", "t")).select("application", "category", "action", "t.description", "t.template")
