"""Queries of runs over pages, jobs' texts, archives and files, and SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import identity
from noticeforge.operators import crawl
from noticeforge.plans import identitybook as _i
from noticeforge.plans import reportbook as _r
from noticeforge.plans import sqlbook
from noticeforge.plans.reports import Tables, list_dates, outcomes
from noticeforge.sources import archives
from noticeforge.sources.tables import table


def _lists(spark, sf: str) -> DataFrame:
    d = table(spark, sf, "raw_document_item").withColumn("role", F.get_json_object("extra_meta", "$.role"))
    n = F.trim(F.get_json_object("extra_meta", "$.page_item_count")).try_cast("int")
    return d.filter("role = 'list'").select("source_code", "raw_id", F.when(F.col("raw_id") % 3 == 0, n).otherwise(0).alias("new_items"))


def pages_until_stale(spark, sf: str) -> DataFrame:
    """List pages of each source up to the second in a row without anything new."""
    return crawl.until_stale(_lists(spark, sf), 2, ("source_code",)).select("source_code", "raw_id", "stale_pages")


def pages_once(spark, sf: str) -> DataFrame:
    """Pages of each source, the first of each URL."""
    return crawl.once(table(spark, sf, "raw_document_item").filter(F.col("normalized_url").isNotNull()), ("source_code",)).select("source_code", "raw_id")


def items_in_window(spark, sf: str) -> DataFrame:
    """Items that a run from 2024 on keeps, by their plain day."""
    items = table(spark, sf, "notice_item").withColumn("day", F.to_date(identity.day(F.trim("published_at"))))
    return items.filter(crawl.in_window(F.col("day"), 2024)).select("item_id")


def batches_all_older(spark, sf: str) -> DataFrame:
    """Batches all of whose items are of before February 2024's year start, batch by batch."""
    items = table(spark, sf, "notice_item").withColumn("day", F.to_date(identity.day(F.trim("published_at"))))
    return crawl.all_older(items.filter(F.col("day").isNotNull()), 2024, ("source_code", "batch_no")).select("source_code", "batch_no", F.col("all_older").cast("int").alias("all_older"))


def job_summaries(spark, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    seen = list_dates(t).select(F.col("crawl_job_id").alias("id"), F.col("list_pages").alias("pages_scraped"), "first_seen", "last_seen")
    rows = t["crawl_job"].drop("failure_reason", "status").join(outcomes(t).withColumnRenamed("final_status", "status"), "id").join(seen, "id", "left")
    return crawl.job_summary(rows)


def job_backfilled(spark, sf: str) -> DataFrame:
    """Jobs as a migration fills them: times of the queue, and one active job a source."""
    j = crawl.demoted(crawl.backfilled(Tables(spark, sf)["crawl_job"]))
    return j.select("id", "status", F.unix_micros("queued_at").alias("queued_us"), F.unix_micros("picked_at").alias("picked_us"))


def archive_names(spark, sf: str) -> DataFrame:
    return archives.raw_archive(table(spark, sf, "raw_document_item"), "archive")


def file_inference(spark, sf: str) -> DataFrame:
    """Name, suffix and media type of files, as given or inferred."""
    f = table(spark, sf, "tender_attachment_item")
    name = F.coalesce(identity.said("file_name"), archives.file_name(F.col("file_url")))
    end = F.coalesce(identity.said("file_ext"), archives.suffix(name, F.col("file_url")))
    return f.select("att_id", name.alias("file_name"), F.lower(end).alias("file_ext"), F.coalesce(identity.said("mime_type"), archives.media_type(archives.suffix(name, F.col("file_url")))).alias("mime_type"))


QUERIES = {"pages_until_stale": pages_until_stale, "pages_once": pages_once, "items_in_window": items_in_window, "batches_all_older": batches_all_older, "job_summaries": job_summaries, "job_backfilled": job_backfilled, "archive_names": archive_names, "file_inference": file_inference}

_DAYS = f"(SELECT item_id, source_code, batch_no, {_i._DAY} AS day FROM (SELECT *, trim(published_at) AS d FROM notice_item) u)"
_TAIL = "regexp_extract(file_url, '^[^?#]*/([^/?#]*)', 1)"
_NAME = f"coalesce(nullif(trim(file_name), ''), nullif(trim(url_decode({_TAIL})), ''))"
_END = f"lower(coalesce(nullif(trim(regexp_extract({_NAME}, '[.]([^.]*)$', 1)), ''), nullif(trim(regexp_extract(url_decode({_TAIL}), '[.]([^.]*)$', 1)), '')))"
_MEDIA = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in archives.MEDIA.items())
_OUTCOME = _r.SQL["job_final_status"].replace("WITH m AS", "m AS").rpartition("SELECT id, failure_reason, CASE")
_SEEN = _r.SQL["list_meta_dates"]
SQL = {
    "pages_until_stale": """WITH p AS (SELECT source_code, raw_id, CASE WHEN raw_id % 3 = 0 THEN coalesce(try_cast(trim(json_extract_string(extra_meta, '$.page_item_count')) AS INTEGER), 0) ELSE 0 END AS n FROM raw_document_item WHERE json_extract_string(extra_meta, '$.role') = 'list'),
        q AS (SELECT a.source_code, a.raw_id, (SELECT count(*) FROM p b WHERE b.source_code = a.source_code AND b.raw_id <= a.raw_id AND b.n <= 0 AND b.raw_id > coalesce((SELECT max(c.raw_id) FROM p c WHERE c.source_code = a.source_code AND c.raw_id <= a.raw_id AND c.n > 0), -1)) AS stale_pages FROM p a)
        SELECT source_code, raw_id, stale_pages FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.source_code = q.source_code AND o.raw_id < q.raw_id AND o.stale_pages >= 2)""",
    "pages_once": "SELECT source_code, min(raw_id) AS raw_id FROM raw_document_item WHERE normalized_url IS NOT NULL GROUP BY source_code, normalized_url",
    "items_in_window": f"SELECT item_id FROM {_DAYS} x WHERE day IS NULL OR day >= '2024-01-01'",
    "batches_all_older": f"SELECT source_code, batch_no, CASE WHEN max(day) < '2024-01-01' THEN 1 ELSE 0 END AS all_older FROM {_DAYS} x WHERE day IS NOT NULL GROUP BY source_code, batch_no",
    "job_summaries": f"""WITH {_OUTCOME[0].rstrip()}, t AS (SELECT id, failure_reason AS why, CASE{_OUTCOME[2].replace(" AS final_status", " AS state")}), seen AS ({_SEEN})
        SELECT j.id, j.job_type || ' 任务已结束，状态 ' || t.state || '，列表页 ' || CASE WHEN seen.list_pages > 0 THEN seen.list_pages ELSE j.pages_fetched END || '，列表项 ' || j.list_items_unique || '/' || j.list_items_seen || '，详情请求 ' || j.detail_pages_fetched || '，公告 ' || j.notices_upserted || '，归档 ' || j.documents_saved
        || '，去重跳过 ' || (j.list_items_source_duplicates_skipped + coalesce(j.source_duplicates_suppressed, 0)) || coalesce('，最早发布日期 ' || seen.first_seen, '') || coalesce('，最晚发布日期 ' || seen.last_seen, '') || CASE WHEN trim(t.why) NOT IN ('', '-') THEN '，异常 ' || trim(t.why) ELSE '' END || CASE WHEN j.return_code <> 0 THEN '，退出码 ' || j.return_code ELSE '' END AS summary
        FROM crawl_job j JOIN t ON t.id = j.id LEFT JOIN seen ON seen.crawl_job_id = j.id""",
    "job_backfilled": "SELECT id, CASE WHEN status IN ('pending', 'running') AND EXISTS (SELECT 1 FROM crawl_job o WHERE o.source_site_id = j.source_site_id AND o.status IN ('pending', 'running') AND o.id > j.id) THEN 'failed' ELSE status END AS status, epoch_us(coalesce(queued_at, created_at)) AS queued_us, epoch_us(coalesce(picked_at, started_at)) AS picked_us FROM crawl_job j",
    "archive_names": "SELECT raw_id, 'archive/' || coalesce(source_code, 'unknown_source') || '/' || strftime(fetched_at, '%Y%m%dT%H%M%SZ') || '_' || substr(sha256(url), 1, 12) || CASE WHEN document_type = 'json' OR mime_type LIKE '%json%' THEN '.json' ELSE '.html' END AS storage_uri, strlen(raw_body) AS content_length FROM raw_document_item WHERE raw_body IS NOT NULL",
    "file_inference": f"SELECT att_id, {_NAME} AS file_name, lower(coalesce(nullif(trim(file_ext), ''), {_END})) AS file_ext, coalesce(nullif(trim(mime_type), ''), CASE {_END} {_MEDIA} END) AS mime_type FROM tender_attachment_item",
}
ORACLES = {name: sqlbook.duckdb(text) for name, text in SQL.items()}
