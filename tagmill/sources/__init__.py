"""Readers and writers: rule and specification folders, label files and records, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators import records
from tagmill.operators.fields import file_hash, sniffed
from tagmill.operators.passes import kind, upload

RULE_FILE = (
    "label_type_id string, label_type_name string, required_fields array<string>, optional_fields array<string>, itf_barcode string, ean13_barcode string, datamatrix string, "
    "datamatrix_variants string, validation_rules array<struct<rule_id:string,field:string,check:string,severity:string,pattern:string,value:string,values:array<string>,ai:string,min:string,max:string>>, _bad string"
)


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A row per rule file in the order of names; the index is left out and files that don't parse are dropped."""
    rows = spark.read.schema(RULE_FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = rows.withColumn("stem", name).where("_bad is null and stem <> 'index'").drop("_bad")
    return rows.withColumn("label_type_id", F.coalesce("label_type_id", "stem"))


def read_specs(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """kind, name, json, error: a row per file of a specification folder; those that don't parse have an error and no json."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"))
    return specs(rows.select(F.lit(kind).alias("kind"), F.regexp_extract("file", r"^(.*)\.json$", 1).alias("name"), "value"))


def specs(files: DataFrame) -> DataFrame:
    """kind, name, json, error of files (kind, name, value): whether each is a JSON object."""
    good = F.coalesce(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.lit(False))
    return files.select("kind", "name", F.when(good, F.col("value")).alias("json"), F.when(~good, "PARSE_ERROR").alias("error"))


def write_specs(documents: DataFrame, folder: str) -> None:
    """Documents (name, json) as JSON lines in a new folder; the files read are not touched."""
    documents.select(F.col("json").alias("value")).write.mode("errorifexists").text(folder)


def read_files(spark: SparkSession, path: str, dpi: int = 600) -> DataFrame:
    """Label files with how they load, suffix and hash, and what an upload of them would become; decoding needs libraries that are not part of this repository."""
    files = spark.read.format("binaryFile").load(path)
    named = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    head = sniffed(F.substring("content", 1, 8))
    return files.select("path", "length", head.alias("suffix"), file_hash(F.col("content"), F.lit(dpi)).alias("file_hash"), kind(named).alias("kind"), upload(F.col("content"), head).alias("upload"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records (JSON lines): label_id by file and line, json, label."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("label_id"), F.col("value").alias("json"))
    return records.parsed(rows)


def write_labels(labels: DataFrame, folder: str) -> None:
    """Label records (label_id, json) as JSON lines."""
    labels.select(F.col("json").alias("value")).write.mode("append").text(folder)


def append_rows(rows: DataFrame, folder: str) -> None:
    """Training rows as JSON lines, appended."""
    rows.write.mode("append").json(folder)
