"""Queries of the general pipeline problems: history of attributes (2) and instants of timestamps (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.operators.history import notice_history
from noticeforge.operators.timestamps import normalise_timestamps
from noticeforge.sources.tables import table

TIMES = ["published_at", "deadline_at"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    periods = notice_history(table(spark, sf, "notice_version_item"))
    return periods.filter(F.col("notice_external_id").isNotNull()).select("source_code", "notice_external_id", "period_no", "first_snap_id")


def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    """All periods with begin and end, also those of notices known by hash only."""
    return notice_history(table(spark, sf, "notice_version_item")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    read = normalise_timestamps(table(spark, sf, "notice_item"), table(spark, sf, "source_zone"), TIMES)
    return read.select(F.col("id").alias("item_id"), "field_name", "utc_second")


def p6_formats(spark: SparkSession, sf: str) -> DataFrame:
    """By format: values, those of several readings, and the span of instants."""
    read = normalise_timestamps(table(spark, sf, "notice_item"), table(spark, sf, "source_zone"), TIMES)
    return read.groupBy("field_name", "fmt").agg(F.count("*").alias("n_values"), F.count_if(F.col("n_readings") > 1).alias("n_open"), F.min("utc_second").alias("first_second"), F.max("utc_second").alias("last_second"))


QUERIES = {"p2_found": p2_found, "p2_history": p2_history, "p6_found": p6_found, "p6_formats": p6_formats}
