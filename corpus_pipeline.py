"""A corpus pipeline: five of the training-data operators, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of its input; the last returns packed
pieces. run() writes every stage as Parquet in the shared folder and reads it again.

Every stage takes empty tables and columns of any other name, dots included, which all but the last hand on. Repeated
rows count each on their own; what nulls, blank and very long texts come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import mixing, packing, quality, secrets, simhash
from tessella.runtime import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the outlier test go, null and blank texts among them; null sources are a source of their own; very long texts are judged whole."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id, null last; unlike texts under one doc_id all stay; very long texts are fingerprinted whole."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; n_chars, where there is one, follows the text; a null text stays null, and a very long one is scanned whole."""
    clean = docs.withColumn("text", secrets.redacted("text"))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it, at most twice; a null source is one of its own; a very long text counts with all its words."""
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the sequence and place of each; null texts are packed as empty ones, very long ones as pieces over several sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]
#: Fingerprints, outlier estimates and token ids can't be had in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
