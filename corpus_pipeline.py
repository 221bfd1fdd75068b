"""From documents to training pieces: quality, near-duplicates, benchmark decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, the
last one doc_id with its ids. Stages are written as Parquet in the shared folder and reread, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import decontaminate, neardup, pieces, quality, secrets
from tagmill.llm.common import bounded, saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    bounded(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    bounded(spark)
    return neardup.kept(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    bounded(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    bounded(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and whether the ids decode to the text."""
    bounded(spark)
    return pieces.round_trip(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("pieces", encode_stage),
]

#: Trained classifiers and keyed hashes have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
