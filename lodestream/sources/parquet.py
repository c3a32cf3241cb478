from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; columns and filters that later steps need are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
