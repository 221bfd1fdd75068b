"""An extension: labels arriving as records, deduplicated by hash within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def distinct_files(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first record of each file_hash; state older than the watermark is dropped."""
    return records.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["file_hash"])
