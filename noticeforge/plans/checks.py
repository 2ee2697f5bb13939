"""What the surveyed tables enforce and Spark doesn't: keys that are unique, values of a domain, thresholds in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions.identity import ATTACHMENT_TYPES, STAGES
from noticeforge.plans.reports import ACTIVE, JOB_STATES, JOB_TYPES, RULES, Tables

#: relation: (rule, columns that are unique together where none is null).
UNIQUE = [
    ("source", "code", ["code"]), ("crawl_job", "retried once", ["retry_of_job_id"]), ("raw_document", "url of a source", ["source_site_id", "url_hash"]), ("tender_notice", "external id of a source", ["source_site_id", "external_id"]), ("tender_notice", "hash of a source", ["source_site_id", "dedup_hash"]),
    ("notice_version", "number of a notice", ["notice_id", "version_no"]), ("notice_version", "content of a notice", ["notice_id", "content_hash"]), ("tender_attachment", "url of a source", ["source_site_id", "url_hash"]),
]
#: relation: (column, values it may have).
DOMAINS = [("crawl_job", "status", tuple(JOB_STATES)), ("crawl_job", "job_type", tuple(JOB_TYPES)), ("raw_document", "document_type", ("html", "pdf", "json", "other")), ("tender_attachment", "attachment_type", ATTACHMENT_TYPES), ("crawl_error", "stage", STAGES)]


def violations(t: Tables) -> DataFrame:
    """(relation, rule, n): groups of rows that share a unique key, and values outside their domain."""
    named = lambda df, relation, rule: df.select(F.lit(relation).alias("relation"), F.lit(rule).alias("rule"), "n")
    parts = [named(t[r].dropna(subset=keys).groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n")), r, rule) for r, rule, keys in UNIQUE]
    parts += [named(t[r].agg(F.count_if(~F.col(c).isin(*values)).alias("n")), r, c) for r, c, values in DOMAINS]
    parts.append(named(t["crawl_job"].filter(F.col("status").isin(*ACTIVE)).groupBy("source_site_id").count().agg(F.count_if(F.col("count") > 1).alias("n")), "crawl_job", "one active a source"))
    return reduce(DataFrame.unionByName, parts)


def checked_rules(rules: dict) -> dict:
    """Rules of health with what isn't given; thresholds that are negative or out of order are an error."""
    r = RULES | rules
    if unknown := set(r) - set(RULES):
        raise ValueError(f"unknown rules {sorted(unknown)}")
    for kind in ("errors", "streak"):
        low, high = r[f"{kind}_warning"], r[f"{kind}_critical"]
        if low < 0 or high < 0 or low > high:
            raise ValueError(f"{kind}: {low} and {high} are no thresholds")
    return r
