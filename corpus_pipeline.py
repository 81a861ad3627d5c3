"""Documents to packed training sequences, stage by stage.

Each stage takes what the one before it kept, read again from Parquet, and all but the last return the columns of documents. Stages that change a text
set n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import line_dedup, minhash_dedup, packing, quality, secret_scan
from gaugeworks.llm.common import Scratch
from gaugeworks.tables import load


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are."""
    return quality.accepted(spark, docs, load(spark, sf_dir, "labels")).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines found earlier; one of which nothing but white space is left goes."""
    done = line_dedup.dedup(spark, docs)
    return _sized(done.where(~((F.size("_gone") > 0) & (F.trim(F.translate("text", "\n\r\t", "   ")) == ""))), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash_dedup.kept(spark, docs, shingle=5, percent=80).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return _sized(secret_scan.redact(secret_scan.scan(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place there."""
    return packing.pack(spark, docs)


def _sized(done: DataFrame, docs: DataFrame) -> DataFrame:
    changed = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)


STAGES = [
    ("quality classifier", by_quality),
    ("line dedup", without_repeated_lines),
    ("near duplicates", without_near_duplicates),
    ("secret scan", without_secrets),
    ("packing", packed),
]

#: A trained classifier and the packing rule aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.keep(f"stage{k}")
    return docs
