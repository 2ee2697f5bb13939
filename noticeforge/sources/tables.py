"""Parquet tables by name. Columns that a plan doesn't use are pruned by the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def micros(column: str):
    """A timestamp column, with or without zone, as UTC microseconds."""
    return F.unix_micros(F.col(column).cast("timestamp"))
