"""What a run over list pages keeps: items of a window of time, pages up to a stop, each page once; and texts of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_window(day: Column, year: int) -> Column:
    """Whether an item belongs to a run from the first of January of a year on: what has no date does."""
    return day.isNull() | (day >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))


def all_older(items: DataFrame, year: int, keys: tuple = ("crawl_job_id", "page_no"), day: str = "day") -> DataFrame:
    """(*keys, all_older): pages all of whose items have a date before the year. A page without items isn't one."""
    start = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    return items.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(day) < start, F.lit(False))).alias("all_older"))


def once(pages: DataFrame, keys: tuple = ("crawl_job_id",), url: str = "normalized_url", order: str = "raw_id") -> DataFrame:
    """Pages of a run without those that came before, the first of each URL kept."""
    return pages.join(pages.groupBy(*keys, url).agg(F.min(order).alias(order)), [*keys, url, order], "left_semi")


def until_stale(pages: DataFrame, n: int = 3, keys: tuple = ("crawl_job_id",), order: str = "raw_id", new: str = "new_items") -> DataFrame:
    """Pages of each run up to the n-th page in a row without anything new, that one included, with the length of the
    row so far. A run is some hundred pages, so a window over it is small whatever the table's size."""
    by = Window.partitionBy(*keys).orderBy(order)
    some = pages.withColumn("_run", F.sum((F.coalesce(F.col(new), F.lit(0)) > 0).cast("int")).over(by))
    rows = some.withColumn("stale_pages", F.sum((F.coalesce(F.col(new), F.lit(0)) <= 0).cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(order)).cast("int"))
    before = F.coalesce(F.max("stale_pages").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).filter(F.col("_before") < n).drop("_run", "_before")


def job_summary(rows: DataFrame) -> DataFrame:
    """(id, summary) of jobs that have ended: (id, job_type, status, pages_scraped, the counters, first_seen, last_seen,
    failure_reason, return_code)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    skipped = (F.coalesce("list_items_source_duplicates_skipped", F.lit(0)) + F.coalesce("source_duplicates_suppressed", F.lit(0))).cast("string")
    pages = F.when(F.col("pages_scraped") > 0, F.col("pages_scraped")).otherwise(F.coalesce("pages_fetched", F.lit(0))).cast("string")
    reason = F.trim("failure_reason")
    said = lambda name, v: F.concat(F.lit(name + " "), v)
    parts = [
        F.concat("job_type", F.lit(" 任务已结束")), said("状态", F.col("status")), said("列表页", pages), F.concat(F.lit("列表项 "), n("list_items_unique"), F.lit("/"), n("list_items_seen")), said("详情请求", n("detail_pages_fetched")), said("公告", n("notices_upserted")),
        said("归档", n("documents_saved")), said("去重跳过", skipped), said("最早发布日期", F.col("first_seen")), said("最晚发布日期", F.col("last_seen")), F.when((reason != "") & (reason != "-"), said("异常", reason)), F.when(F.col("return_code") != 0, said("退出码", F.col("return_code").cast("string"))),
    ]
    return rows.select("id", F.concat_ws("，", *parts).alias("summary"))


def payload(message: Column) -> Column:
    """A message of 'a=1; b=2' as JSON of text values, of equal keys the later; null if it has none."""
    from noticeforge.functions.text import k_v_map

    made = k_v_map(message)
    return F.when(F.size(made) > 0, F.to_json(made))


def backfilled(jobs: DataFrame) -> DataFrame:
    """Jobs of before the queue: times it would have set, known codes, messages as JSON."""
    return jobs.withColumns({"queued_at": F.coalesce("queued_at", "created_at"), "picked_at": F.coalesce("picked_at", "started_at"), "job_params_json": payload(F.col("message"))})


def demoted(jobs: DataFrame) -> DataFrame:
    """Jobs of which each source has one active at most: the newest; the others have failed."""
    active = F.col("status").isin("pending", "running")
    newest = jobs.filter(active).groupBy("source_site_id").agg(F.max("id").alias("_kept"))
    return jobs.join(newest, "source_site_id", "left").withColumn("status", F.when(active & (F.col("id") < F.col("_kept")), "failed").otherwise(F.col("status"))).drop("_kept")
