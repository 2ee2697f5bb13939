"""The reports' queries with the parameters they are registered with, and SQL written apart from them.

The plans are DataFrames (`reports.py`), the SQL texts say the same by other means: windows instead of aggregates,
scalar subqueries instead of joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticeforge.functions import html
from noticeforge.plans import reports as r
from noticeforge.plans import sqlbook
from noticeforge.plans.domain import AS_OF, ERRORS_AS_OF, JOBS_AS_OF

LIST = ["id", "source_code", "title", "notice_type", "issuer", "region", "unix_micros(published_at) AS published_us", "unix_micros(deadline_at) AS deadline_us", "budget_amount", "budget_currency", "is_recent_new", "duplicate_count"]
JOB = ["id", "source_code", "status", "job_type", "retry_of_status", "retry_of_message", "retried_by_id", "retried_by_status", "retried_by_message", "unix_micros(retried_by_finished_at) AS retried_by_finished_us", "unix_micros(finished_at) AS finished_us", *r.COUNTERS]


def _page(t: r.Tables, limit: int, offset: int, **kw) -> DataFrame:
    rows = r.notices(t, limit=limit, offset=offset, **kw)
    falling = kw.get("sort_order") != "asc"
    field = kw.get("sort_by") or "published_at"
    order = ([F.desc("is_recent_new")] if falling and field == "published_at" else []) + [F.col(field).desc_nulls_last() if falling else F.col(field).asc_nulls_last(), F.desc("id")]
    return r.numbered(rows, *order).selectExpr(*LIST, "place")


NOTICES: dict[str, Callable[[r.Tables], DataFrame]] = {
    "notice_list_dedup": lambda t: r.notices(t, keyword="采购").selectExpr(*LIST),
    "notice_list_all": lambda t: r.notices(t, dedup=False).selectExpr(*LIST),
    "notice_page": lambda t: _page(t, 50, 20),
    "notice_filter": lambda t: r.notices(t, source_code="zb_01", notice_type="change").selectExpr(*LIST),
    "notice_region": lambda t: r.notices(t, region="云岫省").selectExpr(*LIST),
    "notice_date_range": lambda t: r.notices(t, date_from="2024-03-01", date_to="2024-03-31").selectExpr(*LIST),
    "notice_recent": lambda t: r.notices(t, recent_hours=72).selectExpr(*LIST),
    "notice_wildcard_keyword": lambda t: r.notices(t, dedup=False, keyword="2024%采购_目").select("id", "title"),
    "notice_dual_totals": lambda t: r.totals(t, keyword="采购"),
    "notice_related": lambda t: r.related(t, F.col("id") % 100 == 0),
    "export_rows": lambda t: r.export_rows(t),
}
for _field in r.SORTS:
    for _way in ("asc", "desc"):
        NOTICES[f"notice_sort_{_field}_{_way}"] = lambda t, f=_field, w=_way: _page(t, 200, 0, sort_by=f, sort_order=w)

OTHERS: dict[str, Callable[[r.Tables], DataFrame]] = {
    "notice_detail": lambda t: r.detail(t).select(
        F.col("notice_id").alias("id"), "title", "source_code", F.col("version_no").alias("current_version_no"), F.col("content_hash").alias("current_hash"),
        F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version_no"].cast("string"), v["content_hash"])), ",").alias("versions"),
        F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["id"].cast("string"), a["file_name"])), ",").alias("attachments")),
    "notice_selected_version": lambda t: r.current_versions(t, version_no=2).select("notice_id", "version_no", "content_hash"),
    "notice_by_id": lambda t: t["tender_notice"].filter(F.col("id") == 42).select("id", "title"),
    "classify_title": lambda t: t["tender_notice"].select("id", html.kind_column(F.coalesce("title", F.lit("")), "lists").alias("kind_lists"), html.kind_column(F.coalesce("title", F.lit("")), "pages").alias("kind_pages")),
    "stats_kpis": r.overview,
    "stats_daily_notices": lambda t: r.trend(t, "tender_notice", 30),
    "stats_trend_full_outer": lambda t: r.trend(t, "tender_notice", 7).withColumnRenamed("n", "notices").join(r.trend(t, "raw_document", 7, column="fetched_at").withColumnRenamed("n", "documents"), "day", "full").join(r.trend(t, "notice_version", 7).withColumnRenamed("n", "versions"), "day", "full").fillna(0),
    "ops_summary": lambda t: r.operations(t, recent_hours=24 * 30).withColumn("last_job_finished_us", F.unix_micros("last_job_finished_at")).drop("last_job_finished_at"),
    "health_status": lambda t: r.health(t).withColumn("latest_job_started_us", F.unix_micros("latest_job_started_at")).drop("latest_job_started_at"),
    "health_rules": lambda t: r.health(t, {"errors_warning": 2, "errors_critical": 50, "streak_warning": 2, "streak_critical": 4, "partial_warns": False}).select("source_code", "health_status"),
    "source_sites_page": lambda t: r.source_page(t).select("source_code", "official_url", "schedule_days", "new_notice_count", "health_status", "recent_7d_error_count", "active_job_id", "stage_label"),
    "error_page": lambda t: r.error_page(t).select("source_code", "error_count", "last_id", "last_message", "last_job_status", "last_retry_job_id"),
    "job_list": lambda t: r.jobs(t, preset="abnormal", started_from=f"{JOBS_AS_OF} - INTERVAL '365' DAY").selectExpr(*JOB),
    "job_page": lambda t: r.numbered(r.jobs(t, limit=20, offset=20).withColumn("at", F.coalesce("picked_at", "queued_at", "started_at", "created_at")), F.col("at").desc_nulls_last(), F.desc("id")).select("id", "status", "place"),
    "job_page_by_id": lambda t: r.numbered(r.jobs(t, order_by="id", limit=20), F.desc("id")).select("id", "status", "place"),
    "job_stage": lambda t: r.progress(r.swept(t)).select("id", "stage_label", "summary_text", F.col("is_active").cast("int").alias("is_active"), F.col("is_stale").cast("int").alias("is_stale")),
    "job_final_status": r.outcomes,
    "job_retry_candidate": r.retry_candidates,
    "job_due_sources": lambda t: r.due(t).select("source_site_id", F.unix_micros("next_run_at").alias("next_run_us"), "action"),
    "list_meta_dates": r.list_dates,
    "error_list": lambda t: r.numbered(r.errors(t, stage="parse", limit=200), F.desc("created_at"), F.desc("id")).select("id", "source_code", "stage", "error_type", "place"),
    "raw_doc_list": lambda t: r.numbered(r.documents(t, document_type="html", limit=200), F.col("fetched_at").desc_nulls_last(), F.desc("id")).select("id", "source_code", "title", "place"),
    "error_source_summary": lambda t: r.error_sources(t),
}
_WEEK = "INTERVAL '7' DAY"


def _sourced(t: r.Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t["source"].select(F.col("id").alias("source_site_id"), "code"), "source_site_id")


def _assigned(t: r.Tables) -> DataFrame:
    """The versions of each notice by their first look; current is the content looked at last."""
    each = t["notice_version"].filter(F.col("content_hash").isNotNull()).groupBy("notice_id", "content_hash").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    newest = each.groupBy("notice_id").agg(F.max("last_id").alias("newest"))
    number = F.row_number().over(Window.partitionBy("notice_id").orderBy("first_id"))
    return each.withColumn("version_no", number).join(newest, "notice_id").select("notice_id", "content_hash", "first_id", "version_no", (F.col("last_id") == F.col("newest")).cast("int").alias("is_current"))


PLAIN: dict[str, Callable[[r.Tables], DataFrame]] = {
    "notice_versions": lambda t: t["notice_version"].selectExpr("notice_id", "id AS version_id", "version_no", "content_hash", "unix_micros(created_at) AS created_us"),
    "notice_version_owner": lambda t: _sourced(t, t["notice_version"].select(F.col("id").alias("version_id"), "notice_id").join(t["tender_notice"].select(F.col("id").alias("notice_id"), "source_site_id"), "notice_id")).select("version_id", "notice_id", F.col("code").alias("source_code")),
    "notice_group_sizes": lambda t: r.base_rows(t).groupBy("group_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1"),
    "title_hash": lambda t: t["tender_notice"].select("id", F.sha2(F.lower(F.trim("title")), 256).alias("title_hash")),
    "file_extension": lambda t: t["tender_attachment"].select("id", F.lower(F.coalesce(F.nullif(F.element_at(F.split("file_name", r"\."), -1), "file_name"), F.when(F.col("file_name").isNotNull(), ""))).alias("ext"), F.lower("file_ext").alias("said_ext")),
    "blank_to_default": lambda t: t["source"].select("id", F.coalesce(r._blank("official_url"), "base_url").alias("effective_url")),
    "stats_recent_failures": lambda t: _sourced(t, r.swept(t).filter(F.col("status").isin("failed", "partial"))).orderBy(F.desc("created_at"), F.desc("id")).limit(10).selectExpr("id", "code", "status AS now_status", "unix_micros(created_at) AS created_us"),
    "stats_recent_errors": lambda t: _sourced(t, t["crawl_error"]).orderBy(F.desc("created_at"), F.desc("id")).limit(10).selectExpr("id", "code", "stage", "unix_micros(created_at) AS created_us"),
    "new_notice_union": lambda t: r.new_notices(t, F.expr(f"{AS_OF} - {_WEEK}")).agg(F.count("*").alias("n")),
    "new_notice_by_source": lambda t: r.new_notices(t, F.expr(f"{AS_OF} - {_WEEK}")).groupBy("source_site_id").agg(F.count("*").alias("n")),
    "latest_job_per_source": lambda t: r.swept(t).groupBy("source_site_id").agg(F.max_by(F.struct(F.col("id").alias("job_id"), "status", "message"), "id").alias("x")).select("source_site_id", "x.*"),
    "failure_streak": lambda t: r.streaks(r.newest_jobs(t)),
    "source_error_latest": lambda t: t["crawl_error"].groupBy("source_site_id").agg(F.max_by(F.struct(F.col("id").alias("error_id"), "message"), F.struct("created_at", "id")).alias("x")).select("source_site_id", "x.*"),
    "errors_7d_by_source": lambda t: t["crawl_error"].filter(F.col("occurred_at") >= F.expr(f"{ERRORS_AS_OF} - {_WEEK}")).groupBy("source_site_id").agg(F.count("*").alias("n")),
    "job_queue": lambda t: r.numbered(r.queue(t), F.col("queued_at").asc_nulls_first(), F.asc("id")).selectExpr("id", "unix_micros(queued_at) AS queued_us", "place"),
    "job_expired": lambda t: r.swept(t).join(t["crawl_job"].filter("status = 'running'").select("id"), "id", "left_semi").filter("status = 'failed'").select("id", "source_site_id"),
    "job_mutex_violations": lambda t: t["crawl_job"].filter(F.col("status").isin(*r.ACTIVE)).groupBy("source_site_id").agg(F.count("*").alias("n_active"), F.max("id").alias("kept")).filter("n_active > 1"),
    "raw_doc_owner": lambda t: t["raw_document"].select(F.col("id").alias("raw_id"), F.col("normalized_url").alias("u")).join(t["tender_notice"].groupBy(F.col("detail_page_url").alias("u")).agg(F.min("id").alias("notice_id")), "u").select("raw_id", "notice_id"),
    "error_by_stage": lambda t: t["crawl_error"].groupBy("stage", "error_type").count().withColumnRenamed("count", "n"),
    "version_assign": _assigned,
    "attachment_upsert": lambda t: t["tender_attachment"].filter(F.col("url_hash").isNotNull()).groupBy("source_site_id", "url_hash").agg(F.max("id").alias("attachment_id"), F.max_by("file_name", "id").alias("file_name"), F.max(F.col("downloaded_at").isNotNull()).alias("is_downloaded"), F.count("*").alias("n")),
    "attachment_list": lambda t: t["tender_attachment"].filter(F.col("notice_id").isNotNull()).select("id", "notice_id", "file_name", "attachment_type", "file_size_bytes"),
}
REPORTS = NOTICES | OTHERS | PLAIN

# ---- SQL

_L = sqlbook._LIST
_S = sqlbook._SWEPT
_REASON = "coalesce(nullif(trim(%s), ''), '')"


def _placed(order: str, limit: str, where: str = "") -> str:
    return f"{sqlbook._ranked(where)} SELECT {_L}, row_number() OVER ({order}) AS place FROM (SELECT * FROM ranked WHERE row_rank = 1 {order} {limit}) q"


_JOB0 = "j0 AS (SELECT j.*, CASE WHEN j.status = 'running' AND coalesce(j.timeout_at, j.lease_expires_at) <= " + JOBS_AS_OF + " THEN 1 ELSE 0 END AS gone FROM crawl_job j)"
_JOB = f"{_JOB0}, job AS (SELECT j0.*, CASE WHEN gone = 1 THEN 'failed' ELSE status END AS now_status, CASE WHEN gone = 1 THEN {JOBS_AS_OF} ELSE finished_at END AS now_finished FROM j0)"
_NEW = "fresh AS (SELECT source_site_id, id AS notice_id FROM tender_notice WHERE created_at >= {since} UNION SELECT n.source_site_id, v.notice_id FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id WHERE v.created_at >= {since})"
_DAYS = "SELECT CAST(CAST(CAST({as_of} AS DATE) - CAST(i AS INTEGER) AS DATE) AS VARCHAR(10)) AS day FROM range({n}) t(i)"


def _health(case: str) -> str:
    return f"""WITH {_JOB}, k AS (SELECT job.*, row_number() OVER (PARTITION BY source_site_id ORDER BY id DESC) AS k FROM job),
        st AS (SELECT source_site_id, coalesce((min(CASE WHEN now_status <> 'failed' THEN k END)), max(k) + 1) - 1 AS streak FROM k WHERE k <= 10 GROUP BY source_site_id),
        e7 AS (SELECT source_site_id, count(*) AS n FROM crawl_error WHERE created_at >= {ERRORS_AS_OF} - INTERVAL '7' DAY GROUP BY source_site_id),
        x AS (SELECT s.id, s.code, coalesce(e7.n, 0) AS e, coalesce(st.streak, 0) AS f, l.now_status AS latest FROM source s LEFT JOIN e7 ON e7.source_site_id = s.id LEFT JOIN st ON st.source_site_id = s.id LEFT JOIN k l ON l.source_site_id = s.id AND l.k = 1) {case}"""


_RETRIED = "(SELECT q.{c} FROM job q WHERE q.retry_of_job_id = j.id ORDER BY q.id DESC LIMIT 1)"
_STALE = f"coalesce(timeout_at, lease_expires_at) <= {JOBS_AS_OF} AND now_status IN ('pending', 'running')"
_DONE = "'列表页 ' || pages_fetched || ' / 列表项 ' || list_items_seen || ' / 唯一项 ' || list_items_unique || ' / 详情页 ' || detail_pages_fetched || ' / 公告 ' || notices_upserted || ' / 归档 ' || documents_saved || ' / 去重跳过 ' || skipped || ' / 错误 ' || error_count"
_SOME = " || ".join(f"CASE WHEN {c} > 0 THEN ' / {n} ' || {c} ELSE '' END" for n, c in (("列表页", "pages_fetched"), ("列表项", "list_items_seen"), ("唯一项", "list_items_unique"), ("详情页", "detail_pages_fetched"), ("公告", "notices_upserted"), ("归档", "documents_saved"), ("去重跳过", "skipped"), ("错误", "error_count")))
_TYPE = "CASE job_type WHEN 'manual' THEN '手动抓取' WHEN 'scheduled' THEN '自动抓取' WHEN 'manual_retry' THEN '重试抓取' ELSE job_type END"
_STATE = "CASE now_status WHEN 'succeeded' THEN '已完成' WHEN 'failed' THEN '失败' ELSE '部分成功' END"
_FIRST = "(SELECT e.message FROM crawl_error e WHERE e.crawl_job_id = j.id AND trim(e.message) <> '' {more} ORDER BY e.id LIMIT 1)"


def _with_prefix(prefix: str, c: str) -> str:
    return f"CASE WHEN {c} = '{prefix}' OR {c} LIKE '{prefix}:%' THEN trim({c}) ELSE '{prefix}: ' || trim({c}) END"


SQL: dict[str, str] = {
    "notice_list_dedup": sqlbook.BOOK["notice_list_dedup"], "notice_list_all": sqlbook.BOOK["notice_list_all"], "notice_filter": sqlbook.BOOK["notice_filter"], "notice_region": sqlbook.BOOK["notice_region"],
    "notice_date_range": sqlbook.BOOK["notice_date_range"], "notice_dual_totals": sqlbook.BOOK["notice_dual_totals"], "notice_related": sqlbook.BOOK["notice_related"], "notice_wildcard_keyword": sqlbook.BOOK["notice_wildcard_keyword"],
    "notice_page": _placed("ORDER BY is_recent_new DESC, published_at DESC NULLS LAST, id DESC", "LIMIT 50 OFFSET 20"),
    "notice_recent": sqlbook._ranked(f"WHERE (b.created_at >= {AS_OF} - INTERVAL '72' HOUR OR EXISTS (SELECT 1 FROM notice_version v WHERE v.notice_id = b.id AND v.created_at >= {AS_OF} - INTERVAL '72' HOUR))") + f" SELECT {_L} FROM ranked WHERE row_rank = 1",
    "export_rows": f"""{sqlbook._ranked()} SELECT id, source_code, coalesce(title, '') AS title, coalesce(notice_type, '') AS notice_type, coalesce(issuer, '') AS issuer, coalesce(region, '') AS region,
        coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%SZ'), '') AS published_at, coalesce(strftime(deadline_at, '%Y-%m-%dT%H:%M:%SZ'), '') AS deadline_at, coalesce(CAST(budget_amount AS VARCHAR(30)), '') AS budget_amount, coalesce(budget_currency, '') AS budget_currency FROM ranked WHERE row_rank = 1""",
    "notice_detail": """SELECT n.id, n.title, s.code AS source_code, v.version_no AS current_version_no, v.content_hash AS current_hash,
        (SELECT string_agg(CASE WHEN w.content_hash IS NULL THEN CAST(w.version_no AS VARCHAR(20)) ELSE w.version_no || ':' || w.content_hash END, ',' ORDER BY w.version_no DESC) FROM notice_version w WHERE w.notice_id = n.id) AS versions,
        (SELECT string_agg(CASE WHEN a.file_name IS NULL THEN CAST(a.id AS VARCHAR(20)) ELSE a.id || ':' || a.file_name END, ',' ORDER BY a.id) FROM tender_attachment a WHERE a.notice_id = n.id) AS attachments
        FROM tender_notice n JOIN source_site s ON s.id = n.source_site_id LEFT JOIN (SELECT notice_version.*, row_number() OVER (PARTITION BY notice_id ORDER BY is_current DESC, version_no DESC, id DESC) AS k FROM notice_version) v ON v.notice_id = n.id AND v.k = 1""",
    "notice_selected_version": "SELECT notice_id, version_no, content_hash FROM (SELECT v.*, row_number() OVER (PARTITION BY notice_id ORDER BY CASE WHEN version_no = 2 THEN 0 ELSE 1 END, is_current DESC, version_no DESC, id DESC) AS k FROM notice_version v) WHERE k = 1",
    "notice_by_id": "SELECT id, title FROM tender_notice WHERE id = 42",
    "classify_title": """SELECT id, CASE WHEN regexp_matches(title, '更正|变更|澄清|延期|终止|废标|流标') THEN 'change' WHEN regexp_matches(title, '中标|成交|结果|合同') THEN 'result' ELSE 'announcement' END AS kind_lists,
        CASE WHEN contains(title, '更正') OR contains(title, '变更') OR contains(title, '澄清') OR contains(title, '延期') THEN 'change' WHEN contains(title, '中标') OR contains(title, '成交') OR contains(title, '结果') OR contains(title, '中选') THEN 'result' ELSE 'announcement' END AS kind_pages FROM tender_notice""",
    "stats_kpis": f"""WITH {_JOB} SELECT (SELECT count(*) FROM source_site) AS n_sources, (SELECT count(*) FROM source_site WHERE is_active) AS n_active, (SELECT count(*) FROM job) AS n_jobs, (SELECT count(*) FROM job WHERE now_status = 'running') AS n_running,
        (SELECT count(*) FROM tender_notice) AS n_notices, (SELECT count(*) FROM (SELECT id FROM tender_notice WHERE created_at >= date_trunc('day', {AS_OF}) UNION SELECT v.notice_id FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id WHERE v.created_at >= date_trunc('day', {AS_OF}))) AS new_today,
        (SELECT count(*) FROM (SELECT id FROM tender_notice WHERE created_at >= {AS_OF} - INTERVAL '24' HOUR UNION SELECT v.notice_id FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id WHERE v.created_at >= {AS_OF} - INTERVAL '24' HOUR)) AS new_24h,
        (SELECT count(*) FROM raw_document) AS n_documents, (SELECT count(*) FROM crawl_error) AS n_errors""",
    "stats_daily_notices": f"SELECT d.day, (SELECT count(*) FROM tender_notice WHERE CAST(CAST(created_at AS DATE) AS VARCHAR(10)) = d.day) AS n FROM ({_DAYS.format(as_of=AS_OF, n=30)}) d",
    "stats_trend_full_outer": f"""SELECT d.day, (SELECT count(*) FROM tender_notice WHERE CAST(CAST(created_at AS DATE) AS VARCHAR(10)) = d.day) AS notices, (SELECT count(*) FROM raw_document WHERE CAST(CAST(fetched_at AS DATE) AS VARCHAR(10)) = d.day) AS documents,
        (SELECT count(*) FROM notice_version WHERE CAST(CAST(created_at AS DATE) AS VARCHAR(10)) = d.day) AS versions FROM ({_DAYS.format(as_of=AS_OF, n=7)}) d""",
    "ops_summary": f"""WITH {_JOB}, {_NEW.format(since=f"{AS_OF} - INTERVAL '30' DAY")}, w AS (SELECT * FROM job WHERE created_at >= {JOBS_AS_OF} - INTERVAL '30' DAY)
        SELECT s.id AS source_site_id, s.code AS source_code, s.name AS source_name, CASE WHEN s.official_url IS NULL OR s.official_url = '' THEN s.base_url ELSE s.official_url END AS official_url, s.is_active, s.schedule_enabled, s.schedule_days,
        (SELECT count(*) FROM w WHERE w.source_site_id = s.id) AS job_count, (SELECT count(*) FROM w WHERE w.source_site_id = s.id AND now_status = 'succeeded') AS success_count, (SELECT count(*) FROM w WHERE w.source_site_id = s.id AND now_status = 'failed') AS failed_count,
        (SELECT count(*) FROM w WHERE w.source_site_id = s.id AND now_status = 'partial') AS partial_count, (SELECT count(*) FROM fresh WHERE fresh.source_site_id = s.id) AS new_notice_count,
        l.now_status AS last_job_status, epoch_us(l.now_finished) AS last_job_finished_us, CASE WHEN trim(e.message) <> '' THEN e.message END AS last_error_message, q.now_status AS last_retry_status, q.id AS last_retry_job_id
        FROM source s LEFT JOIN job l ON l.id = (SELECT max(id) FROM job WHERE job.source_site_id = s.id) LEFT JOIN job q ON q.id = (SELECT max(id) FROM job WHERE job.source_site_id = s.id AND retry_of_job_id IS NOT NULL) LEFT JOIN crawl_error e ON e.id = (SELECT max(id) FROM crawl_error WHERE crawl_error.source_site_id = s.id)""",
    "health_status": _health(f"""SELECT x.id AS source_site_id, x.code AS source_code, x.e AS recent_7d_error_count, x.f >= 2 AS consecutive_failed, l.id AS latest_job_id, l.now_status AS latest_job_status, epoch_us(coalesce(l.picked_at, l.started_at, l.queued_at)) AS latest_job_started_us,
        coalesce(l.notices_upserted, 0) AS latest_notices_upserted, coalesce(l.error_count, 0) AS latest_error_count, coalesce(l.list_items_seen, 0) AS latest_list_items_seen, coalesce(l.list_items_unique, 0) AS latest_list_items_unique, coalesce(l.list_items_source_duplicates_skipped, 0) AS latest_list_items_source_duplicates_skipped,
        coalesce(l.detail_pages_fetched, 0) AS latest_detail_pages_fetched, coalesce(l.source_duplicates_suppressed, 0) AS latest_source_duplicates_suppressed,
        (SELECT count(*) FROM job WHERE job.source_site_id = x.id AND created_at >= {JOBS_AS_OF} - INTERVAL '7' DAY) AS recent_7d_job_count, (SELECT count(*) FROM job WHERE job.source_site_id = x.id AND now_status = 'failed' AND created_at >= {JOBS_AS_OF} - INTERVAL '7' DAY) AS recent_7d_failed_count,
        CASE WHEN e >= 6 OR f >= 1 THEN 'critical' WHEN e >= 3 OR latest = 'partial' THEN 'warning' WHEN latest = 'succeeded' THEN 'normal' ELSE 'warning' END AS health_status,
        CASE WHEN e >= 6 OR f >= 1 THEN '异常' WHEN e >= 3 OR latest = 'partial' OR latest IS NULL OR latest <> 'succeeded' THEN '警告' ELSE '正常' END AS health_status_label,
        CASE l.now_status WHEN 'pending' THEN '等待中' WHEN 'running' THEN '进行中' WHEN 'succeeded' THEN '成功' WHEN 'failed' THEN '失败' WHEN 'partial' THEN '部分成功' ELSE '-' END AS latest_job_status_label,
        coalesce(nullif(trim((SELECT message FROM crawl_error c WHERE c.source_site_id = x.id ORDER BY created_at DESC, id DESC LIMIT 1)), ''), nullif(trim((SELECT failure_reason FROM job b WHERE b.source_site_id = x.id AND now_status IN ('failed', 'partial') ORDER BY coalesce(picked_at, queued_at, started_at, created_at) DESC, id DESC LIMIT 1)), ''),
        nullif(trim(l.failure_reason), ''), nullif(trim(l.message), ''), '-') AS latest_failure_reason FROM x LEFT JOIN k l ON l.source_site_id = x.id AND l.k = 1"""),
    "health_rules": _health("SELECT code AS source_code, CASE WHEN e >= 50 THEN 'critical' WHEN f >= 4 THEN 'critical' WHEN latest = 'failed' AND f >= 1 THEN 'warning' WHEN e >= 2 THEN 'warning' WHEN f >= 2 THEN 'warning' WHEN latest IN ('partial', 'succeeded') THEN 'normal' ELSE 'warning' END AS health_status FROM x"),
    "source_sites_page": _health(f"""SELECT x.code AS source_code, coalesce(nullif(s.official_url, ''), s.base_url) AS official_url, s.schedule_days, (SELECT count(*) FROM (SELECT id FROM tender_notice WHERE source_site_id = x.id AND created_at >= {AS_OF} - INTERVAL '24' HOUR UNION SELECT n.id FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id WHERE n.source_site_id = x.id AND v.created_at >= {AS_OF} - INTERVAL '24' HOUR)) AS new_notice_count,
        CASE WHEN e >= 6 OR f >= 1 THEN 'critical' WHEN e >= 3 OR latest = 'partial' THEN 'warning' WHEN latest = 'succeeded' THEN 'normal' ELSE 'warning' END AS health_status, e AS recent_7d_error_count, a.id AS active_job_id,
        CASE WHEN a.id IS NULL THEN NULL WHEN a.stale AND a.now_status = 'pending' THEN '等待重派发' WHEN a.stale THEN '心跳超时' WHEN a.now_status = 'pending' AND a.picked_at IS NOT NULL THEN '等待 Worker 启动' WHEN a.now_status = 'pending' THEN '等待启动' WHEN a.detail_pages_fetched > 0 OR a.documents_saved > 0 OR a.notices_upserted > 0 THEN '抓取详情与入库' WHEN a.list_items_seen > 0 OR a.list_items_unique > 0 THEN '解析列表页' WHEN a.pages_fetched > 0 THEN '抓取列表页' ELSE '启动 Spider' END AS stage_label
        FROM x JOIN source s ON s.id = x.id LEFT JOIN (SELECT job.*, coalesce(coalesce(timeout_at, lease_expires_at) <= {JOBS_AS_OF}, false) AS stale FROM job) a ON a.id = (SELECT max(id) FROM job z WHERE z.source_site_id = x.id AND z.now_status IN ('pending', 'running'))"""),
    "error_page": f"""WITH {_JOB}, top AS (SELECT source_site_id, count(*) AS error_count, max(id) AS last_id FROM crawl_error GROUP BY source_site_id ORDER BY error_count DESC, last_id DESC LIMIT 10)
        SELECT s.code AS source_code, top.error_count, top.last_id, e.message AS last_message, (SELECT now_status FROM job WHERE job.source_site_id = s.id ORDER BY id DESC LIMIT 1) AS last_job_status, (SELECT max(id) FROM job WHERE job.source_site_id = s.id AND retry_of_job_id IS NOT NULL) AS last_retry_job_id FROM top JOIN source s ON s.id = top.source_site_id JOIN crawl_error e ON e.id = top.last_id""",
    "error_source_summary": "SELECT e.source_site_id, e.error_count, e.last_id, c.message AS last_message FROM (SELECT source_site_id, count(*) AS error_count, max(id) AS last_id FROM crawl_error GROUP BY source_site_id) e JOIN crawl_error c ON c.id = e.last_id ORDER BY e.error_count DESC, e.last_id DESC LIMIT 10",
    "job_list": f"""WITH {_JOB}, r1 AS (SELECT job.*, row_number() OVER (PARTITION BY retry_of_job_id ORDER BY id DESC) AS k FROM job WHERE retry_of_job_id IS NOT NULL)
        SELECT j.id, s.code AS source_code, j.now_status AS status, j.job_type, o.now_status AS retry_of_status, o.message AS retry_of_message, q.id AS retried_by_id, q.now_status AS retried_by_status, q.message AS retried_by_message, epoch_us(q.now_finished) AS retried_by_finished_us, epoch_us(j.now_finished) AS finished_us, {", ".join(f"coalesce(j.{c}, 0) AS {c}" for c in r.COUNTERS)}
        FROM job j JOIN source s ON s.id = j.source_site_id LEFT JOIN job o ON o.id = j.retry_of_job_id LEFT JOIN r1 q ON q.retry_of_job_id = j.id AND q.k = 1 WHERE j.now_status IN ('failed', 'partial') AND j.started_at >= {JOBS_AS_OF} - INTERVAL '365' DAY""",
    "job_page": f"WITH {_JOB} SELECT id, now_status AS status, row_number() OVER (ORDER BY moved DESC NULLS LAST, id DESC) AS place FROM (SELECT id, now_status, coalesce(picked_at, queued_at, started_at, created_at) AS moved FROM job ORDER BY moved DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20) p",
    "job_page_by_id": f"WITH {_JOB} SELECT id, now_status AS status, row_number() OVER (ORDER BY id DESC) AS place FROM (SELECT id, now_status FROM job ORDER BY id DESC LIMIT 20) p",
    "job_stage": f"""WITH {_JOB}, p AS (SELECT job.*, coalesce({_STALE}, false) AS stale, list_items_source_duplicates_skipped + coalesce(source_duplicates_suppressed, 0) AS skipped FROM job)
        SELECT id, CASE WHEN now_status = 'pending' OR (now_status = 'running' AND NOT stale) THEN 1 ELSE 0 END AS is_active, CASE WHEN stale THEN 1 ELSE 0 END AS is_stale,
        CASE WHEN stale AND now_status = 'pending' THEN '等待重派发' WHEN stale THEN '心跳超时' WHEN now_status = 'pending' AND picked_at IS NOT NULL THEN '等待 Worker 启动' WHEN now_status = 'pending' THEN '等待启动' WHEN now_status <> 'running' THEN {_STATE}
        WHEN detail_pages_fetched > 0 OR documents_saved > 0 OR notices_upserted > 0 THEN '抓取详情与入库' WHEN list_items_seen > 0 OR list_items_unique > 0 THEN '解析列表页' WHEN pages_fetched > 0 THEN '抓取列表页' ELSE '启动 Spider' END AS stage_label,
        CASE WHEN stale AND now_status = 'pending' THEN '任务派发租约已过期，等待独立 dispatcher 重试' WHEN stale THEN '任务心跳已过期，执行进程可能已退出或卡死' WHEN now_status = 'pending' AND picked_at IS NOT NULL THEN 'dispatcher 已领取任务，等待 worker 启动' WHEN now_status = 'pending' THEN '已入队，等待启动' WHEN now_status <> 'running' THEN {_DONE}
        WHEN {_SOME} = '' THEN {_TYPE} || '已启动，正在持续更新统计' ELSE substr({_SOME}, 4) END AS summary_text FROM p""",
    "job_final_status": f"""WITH m AS (SELECT j.*, {_FIRST.format(more="AND e.stage = 'fetch'")} AS fe, {_FIRST.format(more="AND e.stage = 'parse'")} AS pe, {_FIRST.format(more="AND e.stage = 'parse' AND (e.message LIKE '%详情%' OR e.message ILIKE '%detail%')")} AS de, {_FIRST.format(more="")} AS ae FROM crawl_job j),
        q AS (SELECT id, return_code, error_count, CASE WHEN return_code <> 0 THEN '页面获取失败: spider 进程退出(' || return_code || ')' WHEN fe IS NOT NULL AND (pages_fetched <= 0 OR list_items_seen <= 0) THEN {_with_prefix("页面获取失败", "fe")} WHEN list_items_seen <= 0 THEN '列表解析为0'
        WHEN de IS NOT NULL THEN {_with_prefix("详情解析失败", "de")} WHEN detail_pages_fetched <= 0 AND pe IS NOT NULL THEN {_with_prefix("详情解析失败", "pe")} WHEN ae IS NOT NULL THEN {_with_prefix("详情解析失败", "ae")} ELSE '-' END AS failure_reason FROM m)
        SELECT id, failure_reason, CASE WHEN return_code <> 0 THEN 'failed' WHEN starts_with(failure_reason, '页面获取失败') THEN 'failed' WHEN error_count > 0 THEN 'partial' ELSE 'succeeded' END AS final_status FROM q""",
    "job_retry_candidate": f"""WITH {_JOB}, bad AS (SELECT job.*, row_number() OVER (PARTITION BY source_site_id ORDER BY id DESC) AS k FROM job WHERE now_status IN ('failed', 'partial')),
        free AS (SELECT b.*, row_number() OVER (PARTITION BY source_site_id ORDER BY id DESC) AS f FROM bad b WHERE k <= 30 AND retry_of_job_id IS NULL AND id NOT IN (SELECT retry_of_job_id FROM crawl_job WHERE retry_of_job_id IS NOT NULL)) SELECT source_site_id, id AS job_id FROM free WHERE f = 1 AND job_type = 'manual'""",
    "job_due_sources": f"""WITH {_JOB}, d AS (SELECT s.id, s.schedule_days, (SELECT max(created_at) FROM job WHERE job.source_site_id = s.id) AS last_at, EXISTS (SELECT 1 FROM job WHERE job.source_site_id = s.id AND now_status IN ('pending', 'running')) AS busy FROM source s WHERE s.is_active AND s.schedule_enabled)
        SELECT id AS source_site_id, CASE WHEN last_at + to_days(schedule_days) > {JOBS_AS_OF} THEN epoch_us(last_at + to_days(schedule_days)) ELSE epoch_us({JOBS_AS_OF}) END AS next_run_us, CASE WHEN last_at + to_days(schedule_days) > {JOBS_AS_OF} THEN 'wait' WHEN busy THEN 'skipped' ELSE 'start' END AS action FROM d""",
    "list_meta_dates": """SELECT crawl_job_id, count(DISTINCT id) AS list_pages, max(d) AS first_seen, min(d) AS last_seen FROM (SELECT id, crawl_job_id, CASE WHEN v LIKE '____-__-__%' THEN substr(v, 1, 10) END AS d FROM (SELECT id, crawl_job_id, trim(unnest([json_extract_string(extra_meta, '$.list_page_publish_date_max'), json_extract_string(extra_meta, '$.list_page_publish_date_min'),
        json_extract_string(extra_meta, '$.first_publish_date_seen_total'), json_extract_string(extra_meta, '$.last_publish_date_seen_total')])) AS v FROM raw_document WHERE lower(role) = 'list') u) w GROUP BY crawl_job_id""",
    "error_list": "SELECT id, code AS source_code, stage, error_type, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM (SELECT e.id, s.code, e.stage, e.error_type, e.created_at FROM crawl_error e JOIN source s ON s.id = e.source_site_id WHERE e.stage = 'parse' ORDER BY e.created_at DESC, e.id DESC LIMIT 200) p",
    "raw_doc_list": "SELECT id, code AS source_code, title, row_number() OVER (ORDER BY fetched_at DESC NULLS LAST, id DESC) AS place FROM (SELECT d.id, s.code, d.title, d.fetched_at FROM raw_document d JOIN source s ON s.id = d.source_site_id WHERE d.document_type = 'html' ORDER BY d.fetched_at DESC NULLS LAST, d.id DESC LIMIT 200) p",
}
SQL |= {name: sqlbook.BOOK[name] for name in PLAIN if name in sqlbook.BOOK}
SQL["job_queue"] = f"SELECT id, epoch_us(queued_at) AS queued_us, row_number() OVER (ORDER BY queued_at ASC NULLS FIRST, id ASC) AS place FROM ({sqlbook.BOOK['job_queue'].replace('unix_micros(queued_at) AS queued_us', 'queued_at')}) q"
for _field in r.SORTS:
    for _way in ("ASC", "DESC"):
        _lead = "is_recent_new DESC, " if (_field, _way) == ("published_at", "DESC") else ""
        SQL[f"notice_sort_{_field}_{_way.lower()}"] = _placed(f"ORDER BY {_lead}{_field} {_way} NULLS LAST, id DESC", "LIMIT 200")

QUERIES = {name: (lambda spark, sf, f=f: f(r.Tables(spark, sf))) for name, f in REPORTS.items()}
ORACLES = {name: sqlbook.duckdb(text) for name, text in SQL.items()}
