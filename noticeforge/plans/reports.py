"""The read API: one function a report, with its parameters, over the domain's relations.

Each takes the relations (`Tables`) and keyword arguments and gives a DataFrame; nothing reads a clock, reports are
made at `as_of`. Lists group by the query-time key in one aggregate (count and best row), which Spark combines
before it shuffles, so a key that holds a third of all rows costs no task more than its share. Sources are few and
joined as measured by the optimizer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticeforge.plans import sqlbook
from noticeforge.plans.domain import AS_OF, ERRORS_AS_OF, JOBS_AS_OF, RELATIONS

# Labels of kinds and states.
JOB_TYPES = {"manual": "手动抓取", "scheduled": "自动抓取", "backfill": "回填抓取", "manual_retry": "重试抓取"}
JOB_STATES = {"pending": "排队中", "running": "抓取中", "succeeded": "已完成", "failed": "失败", "partial": "部分成功"}
HEALTH = {"normal": "正常", "warning": "警告", "critical": "异常"}
HEALTH_JOB_STATES = {"pending": "等待中", "running": "进行中", "succeeded": "成功", "failed": "失败", "partial": "部分成功"}
#: Thresholds of health where none are given.
RULES = {"errors_warning": 3, "errors_critical": 6, "streak_warning": 1, "streak_critical": 1, "partial_warns": True}
COUNTERS = ("pages_fetched", "documents_saved", "notices_upserted", "deduplicated_count", "error_count", "list_items_seen", "list_items_unique", "list_items_source_duplicates_skipped", "detail_pages_fetched", "records_inserted", "records_updated", "source_duplicates_suppressed")
ACTIVE = ("pending", "running")
SORTS = ("published_at", "deadline_at", "budget_amount", "source_name")
PRESETS = ("abnormal", "today_failed", "partial")


@dataclass
class Tables:
    """The domain's relations over a folder of tables; each is planned once."""

    spark: SparkSession
    folder: str
    given: dict | None = None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = (self.given or {}).get(name) or (sqlbook.run(self.spark, self.folder, f"SELECT * FROM {name}"))
        return self._made[name]

    @cached_property
    def _made(self) -> dict:
        return {}


def _labels(column: str | Column, labels: dict, default: Column | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), c), c if default is None else default)


def _blank(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _at(as_of: str) -> Column:
    return F.expr(as_of)


# ---- notices


def base_rows(t: Tables, *, keyword: str | None = None, source_code: str | None = None, notice_type: str | None = None, region: str | None = None, recent_hours: int | None = None, date_from: str | None = None, date_to: str | None = None, new_hours: int = 24, as_of: str = AS_OF) -> DataFrame:
    """Notices with source, query-time key and whether they are new; filters that are null don't filter. A keyword's
    % and _ are wildcards. Dates are whole UTC days, the last one included."""
    sources = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"), F.col("name").alias("source_name"))
    named = F.concat_ws("|", F.concat(F.lit("fallback:"), F.col("source_site_id").cast("string")), *(F.trim(F.coalesce(c, F.lit(""))) for c in ("external_id", "project_code", "title")))
    rows = t["tender_notice"].join(sources, "source_site_id").withColumn("group_key", F.coalesce(_blank("dedup_key"), _blank("source_duplicate_key"), _blank("dedup_hash"), named))
    if source_code is not None:
        rows = rows.filter(F.col("source_code") == source_code)
    if notice_type is not None:
        rows = rows.filter(F.col("notice_type") == notice_type)
    if region is not None:
        rows = rows.filter(F.col("region") == region)
    if keyword and keyword.strip():
        like = f"%{keyword.strip()}%"
        rows = rows.filter(F.col("title").ilike(like) | F.col("issuer").ilike(like) | F.col("region").ilike(like))
    if date_from is not None:
        rows = rows.filter(F.col("published_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        rows = rows.filter(F.col("published_at") < F.lit(date_to).cast("timestamp") + F.expr("INTERVAL '1' DAY"))

    def new_since(hours: int, name: str, rows: DataFrame) -> DataFrame:
        since = _at(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
        versions = t["notice_version"].filter(F.col("created_at") >= since).select(F.col("notice_id").alias("id")).distinct().withColumn("_v", F.lit(True))
        return rows.join(versions, "id", "left").withColumn(name, (F.col("created_at") >= since) | F.col("_v").isNotNull()).drop("_v")

    rows = new_since(new_hours, "is_recent_new", rows).withColumn("is_recent_new", F.col("is_recent_new").cast("int"))
    if recent_hours is not None:
        if not 1 <= recent_hours <= 720:
            raise ValueError("recent_hours is 1 to 720")
        rows = new_since(recent_hours, "_recent", rows).filter("_recent").drop("_recent")
    return rows


def deduplicated(rows: DataFrame) -> DataFrame:
    """The best row of each key (new, latest published, highest id), and how many rows have it."""
    better = F.struct("is_recent_new", F.col("published_at").isNotNull().alias("dated"), "published_at", "id")
    best = rows.groupBy("group_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "group_key"]), better).alias("r"), F.count("*").alias("duplicate_count"))
    return best.select("group_key", "r.*", "duplicate_count")


def ordered(rows: DataFrame, sort_by: str | None, sort_order: str | None) -> DataFrame:
    """Notices in order: nulls last either way, then the higher id; what is new first only for the latest published.
    An unknown field is published_at, an unknown order descending."""
    field = sort_by if sort_by in SORTS else "published_at"
    c = F.col(field)
    falling = sort_order != "asc"
    first = [F.desc("is_recent_new")] if field == "published_at" and falling else []
    return rows.orderBy(*first, c.desc_nulls_last() if falling else c.asc_nulls_last(), F.desc("id"))


def notices(t: Tables, *, dedup: bool = True, sort_by: str | None = None, sort_order: str | None = None, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """The notice list. With a limit, a page of it; without, all rows, in no order."""
    rows = base_rows(t, **filters)
    rows = deduplicated(rows) if dedup else rows.withColumn("duplicate_count", F.lit(1).cast("long"))
    if limit is None:
        return rows
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset at least 0")
    return ordered(rows, sort_by, sort_order).offset(offset).limit(limit)


def totals(t: Tables, **filters) -> DataFrame:
    """Rows and keys of a list, counted in one pass."""
    return base_rows(t, **filters).agg(F.count("*").alias("raw_total"), F.countDistinct("group_key").alias("dedup_total"))


def paging_links(total: int, limit: int, offset: int) -> dict:
    """Where the page before and after begin, and whether there are any."""
    return {"has_prev": offset > 0, "prev_offset": max(offset - limit, 0), "has_next": offset + limit < total, "next_offset": offset + limit}


def related(t: Tables, ids: Column | None = None) -> DataFrame:
    """(notice_id, related_id, source_code) of notices with the key of those chosen, the notice itself among them."""
    rows = base_rows(t).select("id", "group_key", "source_code")
    chosen = rows if ids is None else rows.filter(ids)
    return chosen.select(F.col("id").alias("notice_id"), "group_key").join(rows.withColumnRenamed("id", "related_id"), "group_key").select("notice_id", "related_id", "source_code")


def current_versions(t: Tables, version_id: int | None = None, version_no: int | None = None) -> DataFrame:
    """The version shown of each notice: the one asked for by id, else by number, else the one marked current, else
    the newest."""
    asked = [F.when(F.col("id") == version_id, 1).otherwise(0)] if version_id is not None else []
    asked += [F.when(F.col("version_no") == version_no, 1).otherwise(0)] if version_no is not None else []
    rank = F.struct(*(c.alias(f"a{i}") for i, c in enumerate(asked)), "is_current", "version_no", "id")
    return t["notice_version"].groupBy("notice_id").agg(F.max_by(F.struct(F.col("id").alias("version_id"), "version_no", "content_hash", "is_current"), rank).alias("v")).select("notice_id", "v.*")


def detail(t: Tables, **asked) -> DataFrame:
    """Notices with source, version shown, all versions (newest first) and their files (by id)."""
    versions = t["notice_version"].groupBy("notice_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("version_no", "id", "content_hash")))).alias("versions"))
    files = t["tender_attachment"].filter(F.col("notice_id").isNotNull()).groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "attachment_type", "file_size_bytes"))).alias("attachments"))
    sources = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"), F.col("name").alias("source_name"))
    n = t["tender_notice"].withColumnRenamed("id", "notice_id").join(sources, "source_site_id")
    return n.join(current_versions(t, **asked), "notice_id", "left").join(versions, "notice_id", "left").join(files, "notice_id", "left")


def export_rows(t: Tables, **filters) -> DataFrame:
    """The list as exported, without limit: ten columns of text, null as '', times in ISO form, exact decimals."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return notices(t, **filters).select("id", *(text(c).alias(c) for c in ("source_code", "title", "notice_type", "issuer", "region")), iso("published_at").alias("published_at"), iso("deadline_at").alias("deadline_at"), text("budget_amount").alias("budget_amount"), text("budget_currency").alias("budget_currency"))


# ---- jobs


def swept(t: Tables, as_of: str = JOBS_AS_OF) -> DataFrame:
    """Jobs once those whose lease has ended are failed: only running ones."""
    ends = F.coalesce("timeout_at", "lease_expires_at")
    over = (F.col("status") == "running") & ends.isNotNull() & (ends <= _at(as_of))
    return t["crawl_job"].withColumns({"status": F.when(over, "failed").otherwise(F.col("status")), "finished_at": F.when(over, _at(as_of)).otherwise(F.col("finished_at"))})


def jobs(t: Tables, *, source_code: str | None = None, status: str | None = None, status_in: tuple = (), job_type: str | None = None, started_from: str | None = None, preset: str | None = None, order_by: str = "started_at", limit: int | None = None, offset: int = 0, as_of: str = JOBS_AS_OF) -> DataFrame:
    """Jobs with source, retry links and progress. Presets: abnormal (failed or partial), today_failed, partial;
    an unknown preset is none."""
    sources = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"), F.col("name").alias("source_name"))
    every = swept(t, as_of)
    rows = every
    if preset == "abnormal":
        rows = rows.filter(F.col("status").isin("failed", "partial"))
    elif preset == "today_failed":
        rows = rows.filter((F.col("status") == "failed") & (F.col("started_at") >= F.date_trunc("day", _at(as_of))))
    elif preset == "partial":
        rows = rows.filter(F.col("status") == "partial")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if status_in:
        rows = rows.filter(F.col("status").isin(*status_in))
    if job_type is not None:
        rows = rows.filter(F.col("job_type") == job_type)
    if started_from is not None:
        rows = rows.filter(F.col("started_at") >= F.expr(started_from))
    rows = rows.join(sources, "source_site_id")
    if source_code is not None:
        rows = rows.filter(F.col("source_code") == source_code)
    if limit is not None:
        time = [F.coalesce("picked_at", "queued_at", "started_at", "created_at").desc_nulls_last()] if order_by == "started_at" else []
        rows = rows.orderBy(*time, F.desc("id")).offset(offset).limit(limit)
    # one step of the retry chain, both ways
    original = every.select(F.col("id").alias("retry_of_job_id"), F.col("status").alias("retry_of_status"), F.col("message").alias("retry_of_message"))
    retry = every.filter(F.col("retry_of_job_id").isNotNull()).groupBy("retry_of_job_id").agg(F.max_by(F.struct(F.col("id").alias("retried_by_id"), F.col("status").alias("retried_by_status"), F.col("finished_at").alias("retried_by_finished_at"), F.col("message").alias("retried_by_message")), "id").alias("x")).select(F.col("retry_of_job_id").alias("id"), "x.*")
    return progress(rows.join(original, "retry_of_job_id", "left").join(retry, "id", "left"), as_of).withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTERS})


def progress(rows: DataFrame, as_of: str = JOBS_AS_OF) -> DataFrame:
    """Jobs with what they do now: is_active, is_stale, labels, stage_label and summary_text."""
    ends = F.coalesce("timeout_at", "lease_expires_at")
    waiting, running = F.col("status") == "pending", F.col("status") == "running"
    stale = (waiting | running) & F.coalesce(ends <= _at(as_of), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    skipped = n("list_items_source_duplicates_skipped") + n("source_duplicates_suppressed")
    said = [("列表页", n("pages_fetched")), ("列表项", n("list_items_seen")), ("唯一项", n("list_items_unique")), ("详情页", n("detail_pages_fetched")), ("公告", n("notices_upserted")), ("归档", n("documents_saved")), ("去重跳过", skipped), ("错误", n("error_count"))]
    line = lambda name, v: F.concat(F.lit(name + " "), v.cast("string"))
    some = F.concat_ws(" / ", *(F.when(v > 0, line(name, v)) for name, v in said))
    kind = _labels(F.coalesce(_blank("job_type"), F.lit("-")), JOB_TYPES)
    state = _labels(F.coalesce(_blank("status"), F.lit("-")), JOB_STATES)
    done = F.when(n("detail_pages_fetched") + n("documents_saved") + n("notices_upserted") > 0, "抓取详情与入库").when(n("list_items_seen") + n("list_items_unique") > 0, "解析列表页").when(n("pages_fetched") > 0, "抓取列表页").otherwise("启动 Spider")
    picked = F.col("picked_at").isNotNull()
    return rows.withColumns({
        "is_active": waiting | (running & ~stale), "is_stale": stale, "job_type_label": kind, "status_label": state,
        "stage_label": F.when(stale & waiting, "等待重派发").when(stale, "心跳超时").when(waiting & picked, "等待 Worker 启动").when(waiting, "等待启动").when(running, done).otherwise(state),
        "summary_text": F.when(stale & waiting, "任务派发租约已过期，等待独立 dispatcher 重试").when(stale, "任务心跳已过期，执行进程可能已退出或卡死").when(waiting & picked, "dispatcher 已领取任务，等待 worker 启动").when(waiting, "已入队，等待启动")
        .when(running, F.coalesce(F.nullif(some, F.lit("")), F.concat(kind, F.lit("已启动，正在持续更新统计")))).otherwise(F.concat_ws(" / ", *(line(name, v) for name, v in said))),
    })


def prefixed(prefix: str, reason: Column) -> Column:
    """The reason behind its prefix, unless it has it; the prefix where there is no reason."""
    r = F.coalesce(F.trim(reason), F.lit(""))
    return F.when(r == "", prefix).when((r == prefix) | r.startswith(prefix + ":"), r).otherwise(F.concat(F.lit(prefix + ": "), r))


def outcomes(t: Tables) -> DataFrame:
    """(id, failure_reason, final_status) that jobs end with, from exit code, errors and counters. Of several errors
    the one of the smallest id speaks."""
    said = _blank("message")
    fetch, parse = F.col("stage") == "fetch", F.col("stage") == "parse"
    in_detail = parse & (F.col("message").contains("详情") | F.lower("message").contains("detail"))
    first = lambda test, name: F.min_by(F.when(test, F.col("message")), F.when(test & said.isNotNull(), F.col("id"))).alias(name)
    errors = t["crawl_error"].groupBy(F.col("crawl_job_id").alias("id")).agg(first(fetch, "fetch"), first(parse, "parse"), first(in_detail, "detail"), first(F.lit(True), "any"))
    j = t["crawl_job"].join(errors, "id", "left")
    lists = F.when(F.col("fetch").isNotNull() & ((F.col("pages_fetched") <= 0) | (F.col("list_items_seen") <= 0)), prefixed("页面获取失败", F.col("fetch"))).when(F.col("list_items_seen") <= 0, "列表解析为0")
    details = F.when(F.col("detail").isNotNull(), prefixed("详情解析失败", F.col("detail"))).when((F.col("detail_pages_fetched") <= 0) & F.col("parse").isNotNull(), prefixed("详情解析失败", F.col("parse"))).when(F.col("any").isNotNull(), prefixed("详情解析失败", F.col("any")))
    reason = F.when(F.col("return_code") != 0, F.concat(F.lit("页面获取失败: spider 进程退出("), F.col("return_code").cast("string"), F.lit(")"))).otherwise(F.coalesce(lists, details, F.lit("-")))
    status = F.when((F.col("return_code") != 0) | reason.startswith("页面获取失败"), "failed").when(F.col("error_count") > 0, "partial").otherwise("succeeded")
    return j.select("id", reason.alias("failure_reason"), status.alias("final_status"))


def queue(t: Tables, limit: int = 20, as_of: str = JOBS_AS_OF) -> DataFrame:
    """The jobs to be claimed next: pending, and unclaimed or with a claim that has run out."""
    ends = F.coalesce("timeout_at", "lease_expires_at")
    free = (F.col("status") == "pending") & (F.col("picked_at").isNull() | ends.isNull() | (ends <= _at(as_of)))
    return t["crawl_job"].filter(free).orderBy(F.col("queued_at").asc_nulls_first(), F.asc("id")).limit(limit)


def retry_candidates(t: Tables, newest: int = 30, as_of: str = JOBS_AS_OF) -> DataFrame:
    """(source_site_id, job_id) that a source's retry would take: of its newest failed or partial jobs the newest that
    is no retry, wasn't retried and was started by hand."""
    bad = swept(t, as_of).filter(F.col("status").isin("failed", "partial"))
    last = bad.withColumn("k", F.row_number().over(Window.partitionBy("source_site_id").orderBy(F.desc("id")))).filter(F.col("k") <= newest)
    retried = t["crawl_job"].filter(F.col("retry_of_job_id").isNotNull()).select(F.col("retry_of_job_id").alias("id"))
    free = last.filter(F.col("retry_of_job_id").isNull()).join(retried, "id", "left_anti").groupBy("source_site_id").agg(F.max_by(F.struct("id", "job_type"), "id").alias("x"))
    return free.filter(F.col("x.job_type") == "manual").select("source_site_id", F.col("x.id").alias("job_id"))


def due(t: Tables, as_of: str = JOBS_AS_OF) -> DataFrame:
    """(source_site_id, next_run_at, action) of scheduled sources: skipped where a job of the source is active."""
    last = swept(t, as_of).groupBy("source_site_id").agg(F.max("created_at").alias("last_at"), F.count_if(F.col("status").isin(*ACTIVE)).alias("n_active"))
    s = t["source"].filter("is_active and schedule_enabled").withColumnRenamed("id", "source_site_id").join(last, "source_site_id", "left")
    following = F.coalesce(F.greatest(F.col("last_at") + F.make_dt_interval(F.col("schedule_days")), _at(as_of)), _at(as_of))
    return s.select("source_site_id", following.alias("next_run_at"), F.when(following > _at(as_of), "wait").when(F.coalesce("n_active", F.lit(0)) > 0, "skipped").otherwise("start").alias("action"))


# ---- statistics, operations, health


def trend(t: Tables, relation: str, days: int = 7, as_of: str = AS_OF, column: str = "created_at") -> DataFrame:
    """(day, n) of the last days, that of as_of included, always as many rows, days without rows as 0."""
    last = F.to_date(_at(as_of))
    calendar = t.spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counted = t[relation].filter((F.col(column) >= F.date_sub(last, days - 1).cast("timestamp")) & (F.col(column) < F.date_add(last, 1).cast("timestamp"))).groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def new_notices(t: Tables, since: Column, until: Column | None = None) -> DataFrame:
    """(source_site_id, notice_id) of notices that are new or have a new version, each once."""
    late = lambda df: df.filter(F.col("created_at") >= since) if until is None else df.filter((F.col("created_at") >= since) & (F.col("created_at") < until))
    own = late(t["tender_notice"]).select("source_site_id", F.col("id").alias("notice_id"))
    versions = late(t["notice_version"]).select("notice_id").join(t["tender_notice"].select(F.col("id").alias("notice_id"), "source_site_id"), "notice_id").select("source_site_id", "notice_id")
    return own.unionByName(versions).distinct()


def overview(t: Tables, as_of: str = AS_OF, jobs_as_of: str = JOBS_AS_OF) -> DataFrame:
    """The nine figures of the overview, one row."""
    figures = ("n_sources", "n_active", "n_jobs", "n_running", "n_notices", "new_today", "new_24h", "n_documents", "n_errors")

    def one(df: DataFrame, **counts: Column) -> DataFrame:
        """One row of a part's figures, the others null."""
        return df.agg(*(counts.get(f, F.max(F.lit(None).cast("long"))).alias(f) for f in figures))

    n = F.count("*")
    parts = [
        one(t["source"], n_sources=n, n_active=F.count_if("is_active")), one(swept(t, jobs_as_of), n_jobs=n, n_running=F.count_if(F.col("status") == "running")), one(t["tender_notice"], n_notices=n),
        one(new_notices(t, F.date_trunc("day", _at(as_of))), new_today=n), one(new_notices(t, _at(as_of) - F.expr("INTERVAL '24' HOUR")), new_24h=n), one(t["raw_document"], n_documents=n), one(t["crawl_error"], n_errors=n),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*(F.max(f).alias(f) for f in figures))


def operations(t: Tables, recent_hours: int = 24, as_of: str = AS_OF, jobs_as_of: str = JOBS_AS_OF) -> DataFrame:
    """The seventeen fields of each source's operations in the last hours."""
    if recent_hours < 1:
        raise ValueError("recent_hours is at least 1")
    back = F.make_dt_interval(F.lit(0), F.lit(recent_hours))
    every = swept(t, jobs_as_of)
    done = lambda s: F.count_if(F.col("status") == s)
    window = every.filter(F.col("created_at") >= _at(jobs_as_of) - back).groupBy("source_site_id").agg(F.count("*").alias("job_count"), done("succeeded").alias("success_count"), done("failed").alias("failed_count"), done("partial").alias("partial_count"))
    fresh = new_notices(t, _at(as_of) - back).groupBy("source_site_id").agg(F.count("*").alias("new_notice_count"))
    # the latest job and the latest retry, in one pass
    retry = F.col("retry_of_job_id").isNotNull()
    last = every.groupBy("source_site_id").agg(F.max_by(F.struct("status", "finished_at"), "id").alias("j"), F.max_by(F.struct("status", "id"), F.when(retry, F.col("id"))).alias("r"))
    last = last.select("source_site_id", F.col("j.status").alias("last_job_status"), F.col("j.finished_at").alias("last_job_finished_at"), F.col("r.status").alias("last_retry_status"), F.col("r.id").alias("last_retry_job_id"))
    error = t["crawl_error"].groupBy("source_site_id").agg(_blank_kept(F.max_by("message", "id")).alias("last_error_message"))
    s = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"), F.col("name").alias("source_name"), F.coalesce(F.nullif("official_url", F.lit("")), "base_url").alias("official_url"), "is_active", "schedule_enabled", "schedule_days")
    counts = ("job_count", "success_count", "failed_count", "partial_count", "new_notice_count")
    out = s.join(window, "source_site_id", "left").join(fresh, "source_site_id", "left").join(last, "source_site_id", "left").join(error, "source_site_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def _blank_kept(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def health_of(errors: Column, streak: Column, latest: Column, rules: dict = RULES) -> Column:
    """The ladder of health; its order matters."""
    r = RULES | rules
    failing = (latest == "failed") & (streak >= 1)
    return (
        F.when(errors >= r["errors_critical"], "critical").when(streak >= r["streak_critical"], "critical")
        .when(failing, "critical" if r["streak_critical"] <= 1 else "warning").when(errors >= r["errors_warning"], "warning").when(streak >= r["streak_warning"], "warning")
        .when(latest == "partial", "warning" if r["partial_warns"] else "normal").when(latest == "succeeded", "normal").otherwise("warning")
    )


def newest_jobs(t: Tables, as_of: str = JOBS_AS_OF, n: int = 10) -> DataFrame:
    """The newest jobs of each source, numbered by k; each partition keeps as many of a source before they are moved."""
    return swept(t, as_of).withColumn("k", F.row_number().over(Window.partitionBy("source_site_id").orderBy(F.desc("id")))).filter(F.col("k") <= n)


def streaks(newest: DataFrame) -> DataFrame:
    """(source_site_id, streak): how many of the newest jobs failed in a row."""
    return newest.groupBy("source_site_id").agg((F.coalesce(F.min(F.when(F.col("status") != "failed", F.col("k"))), F.count("*") + 1) - 1).alias("streak"))


def health(t: Tables, rules: dict = RULES, jobs_as_of: str = JOBS_AS_OF, errors_as_of: str = ERRORS_AS_OF) -> DataFrame:
    """The twenty fields of each source's health. A streak is counted over the ten newest jobs."""
    every = swept(t, jobs_as_of)
    newest = newest_jobs(t, jobs_as_of)
    shown = ["notices_upserted", "error_count", "list_items_seen", "list_items_unique", "list_items_source_duplicates_skipped", "detail_pages_fetched", "source_duplicates_suppressed"]
    latest = newest.filter("k = 1").select("source_site_id", F.col("id").alias("latest_job_id"), F.col("status").alias("latest_job_status"), F.coalesce("picked_at", "started_at", "queued_at").alias("latest_job_started_at"), *(F.coalesce(c, F.lit(0)).alias(f"latest_{c}") for c in shown), _blank_kept(F.col("failure_reason")).alias("_reason"), _blank_kept(F.col("message")).alias("_message"))
    week = F.expr("INTERVAL '7' DAY")
    recent = every.filter(F.col("created_at") >= _at(jobs_as_of) - week).groupBy("source_site_id").agg(F.count("*").alias("recent_7d_job_count"), F.count_if(F.col("status") == "failed").alias("recent_7d_failed_count"))
    errors = t["crawl_error"].groupBy("source_site_id").agg(F.count_if(F.col("created_at") >= _at(errors_as_of) - week).alias("recent_7d_error_count"), _blank_kept(F.max_by("message", F.struct("created_at", "id"))).alias("_error"))
    bad = every.filter(F.col("status").isin("failed", "partial")).groupBy("source_site_id").agg(_blank_kept(F.max_by("failure_reason", F.struct(F.coalesce("picked_at", "queued_at", "started_at", "created_at").alias("at"), "id"))).alias("_bad"))
    out = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"))
    for part in (streaks(newest), latest, recent, errors, bad):
        out = out.join(part, "source_site_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counts = ["recent_7d_job_count", "recent_7d_failed_count", "recent_7d_error_count", *(f"latest_{c}" for c in shown)]
    out = out.withColumns({c: zero(c) for c in counts} | {"streak": zero("streak")}).withColumn("health_status", health_of(F.col("recent_7d_error_count"), F.col("streak"), F.col("latest_job_status"), rules))
    return out.withColumns({
        "health_status_label": _labels("health_status", HEALTH), "latest_job_status_label": _labels("latest_job_status", HEALTH_JOB_STATES, F.lit("-")),
        "consecutive_failed": F.col("streak") >= 2, "latest_failure_reason": F.coalesce("_error", "_bad", "_reason", "_message", F.lit("-")),
    }).drop("_reason", "_message", "_error", "_bad", "streak")


def active_jobs(t: Tables, as_of: str = JOBS_AS_OF) -> DataFrame:
    """(source_site_id, active_job_id, stage_label, summary_text) of each source's newest active job."""
    rows = progress(swept(t, as_of).filter(F.col("status").isin(*ACTIVE)), as_of)
    return rows.groupBy("source_site_id").agg(F.max_by(F.struct(F.col("id").alias("active_job_id"), "stage_label", "summary_text"), "id").alias("x")).select("source_site_id", "x.*")


def source_page(t: Tables, **rules) -> DataFrame:
    """The page of sources: operations, health and active job of each; without health it is a warning."""
    ops = operations(t)
    h = health(t, rules or RULES).select("source_site_id", "health_status", "health_status_label", "latest_failure_reason", "recent_7d_error_count", "consecutive_failed")
    return ops.join(h, "source_site_id", "left").join(active_jobs(t), "source_site_id", "left").withColumn("health_status", F.coalesce("health_status", F.lit("warning")))


def error_sources(t: Tables, k: int = 10) -> DataFrame:
    """(source_site_id, error_count, last_id, last_message) of the sources with most errors."""
    e = t["crawl_error"].groupBy("source_site_id").agg(F.count("*").alias("error_count"), F.max("id").alias("last_id"), F.max_by("message", "id").alias("last_message"))
    return e.orderBy(F.desc("error_count"), F.desc("last_id")).limit(k)


def error_page(t: Tables, k: int = 10) -> DataFrame:
    """The sources with most errors, with their operations."""
    return error_sources(t, k).join(operations(t).drop("last_error_message"), "source_site_id", "left")


def errors(t: Tables, *, source_code: str | None = None, stage: str | None = None, crawl_job_id: int | None = None, error_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    sources = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"))
    return _filtered(t["crawl_error"].join(sources, "source_site_id"), {"source_code": source_code, "stage": stage, "crawl_job_id": crawl_job_id, "error_type": error_type}, [F.desc("created_at"), F.desc("id")], limit, offset)


def documents(t: Tables, *, source_code: str | None = None, document_type: str | None = None, crawl_job_id: int | None = None, content_hash: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    sources = t["source"].select(F.col("id").alias("source_site_id"), F.col("code").alias("source_code"))
    return _filtered(t["raw_document"].join(sources, "source_site_id"), {"source_code": source_code, "document_type": document_type, "crawl_job_id": crawl_job_id, "content_hash": content_hash}, [F.col("fetched_at").desc_nulls_last(), F.desc("id")], limit, offset)


def _filtered(rows: DataFrame, wanted: dict, order: list, limit: int | None, offset: int) -> DataFrame:
    for c, v in wanted.items():
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    return rows if limit is None else rows.orderBy(*order).offset(offset).limit(limit)


def list_dates(t: Tables) -> DataFrame:
    """(crawl_job_id, list_pages, first_seen, last_seen) over four fields of list pages' meta: first is the newest."""
    fields = ("list_page_publish_date_max", "list_page_publish_date_min", "first_publish_date_seen_total", "last_publish_date_seen_total")
    iso = lambda c: F.when((F.length(c) >= 10) & (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-"), F.substring(c, 1, 10))
    dates = [iso(F.trim(F.get_json_object("extra_meta", f"$.{f}"))) for f in fields]
    lists = t["raw_document"].filter(F.lower("role") == "list")
    return lists.groupBy("crawl_job_id").agg(F.count("*").alias("list_pages"), F.max(F.greatest(*dates)).alias("first_seen"), F.min(F.least(*dates)).alias("last_seen"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """A page's rows with their place in it. A page is at most 200 rows."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
