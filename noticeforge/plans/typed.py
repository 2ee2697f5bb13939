"""The reports of notices whose times and amounts are read in every notation.

The book's own relation keeps values of one plain form, which both SQL engines read, and its texts are what the
queries are checked against; so it stays, and this relation stands beside it. A time without a zone is UTC, as in
the book and in the surveyed parser; a zone, its abbreviation or a stated Beijing time counts; the order of all-digit
dates is the source's. Times are whole seconds. No DuckDB text can follow, so these queries have none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.functions import text
from noticeforge.operators.timestamps import readings
from noticeforge.plans.domain import _time
from noticeforge.plans.reportbook import NOTICES
from noticeforge.plans.reports import Tables
from noticeforge.plans.writes import similar
from noticeforge.sources.tables import table


def instant(value: str | None, zone: str | None, order: str | None) -> int | None:
    """The value's second; without a named zone in UTC."""
    best = min(readings(value, zone, order), key=lambda r: r[2], default=None)
    if best and not best[1].endswith("z"):
        best = min(readings(value, "UTC", order), key=lambda r: r[2], default=None)
    return best and best[0]


@F.pandas_udf(T.LongType())
def _instant_udf(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([instant(*x) for x in zip(value, zone, order)], dtype="Int64")


def _moment(c: str) -> Column:
    plain = F.expr(_time(c))
    return F.coalesce(plain, F.timestamp_seconds(_instant_udf(F.when(plain.isNull(), F.col(c)), "tz_name", "date_order"))).alias(c)


def tender_notice(spark: SparkSession, sf: str) -> DataFrame:
    """The book's relation of that name with all times and amounts."""
    sites = table(spark, sf, "source_site").select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"))
    zones = table(spark, sf, "source_zone").groupBy("source_code").agg(F.min(F.struct("tz_name", "date_order")).alias("z")).select("source_code", "z.*")
    n = table(spark, sf, "notice_item").join(sites, "source_code").join(zones, "source_code", "left")
    return n.select(
        F.col("item_id").alias("id"), "source_site_id", "external_id", "project_code", "dedup_hash", "dedup_key", "source_duplicate_key", "title",
        F.when(F.col("notice_type").isin("announcement", "change", "result"), F.col("notice_type")).otherwise("announcement").alias("notice_type"), "issuer", "region",
        _moment("published_at"), _moment("deadline_at"), text.typed_amount("budget_amount").alias("budget_amount"),
        "budget_currency", "summary", F.col("crawled_at").cast("timestamp").alias("created_at"), "detail_page_url", "crawl_job_id", "raw_content_hash",
    )


def _report(report):
    return lambda spark, sf: report(Tables(spark, sf, {"tender_notice": tender_notice(spark, sf)}))


#: Reports of notices that show, sort or filter by times and amounts.
_REPORTS = {name: f for name, f in NOTICES.items() if name not in ("notice_wildcard_keyword", "notice_dual_totals", "notice_related")}
QUERIES = {"similarity_match_typed": lambda spark, sf: similar(tender_notice(spark, sf))} | {f"{name}_typed": _report(f) for name, f in _REPORTS.items()}
