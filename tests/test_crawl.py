"""Runs over pages, archives, starting rows, states of jobs as batch and stream, routing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.operators import crawl
from noticeforge.sources import archives
from noticeforge.streaming import jobs, twins

SF = "/root/testdata/sf0.001"


def test_windows_of_time(spark):
    d = dt.date
    rows = [(1, 1, d(2023, 12, 31)), (1, 1, d(2024, 1, 1)), (1, 2, d(2023, 5, 1)), (1, 3, None), (1, 3, d(2020, 1, 1))]
    items = spark.createDataFrame(rows, "crawl_job_id long, page_no int, day date")
    assert items.filter(crawl.in_window(F.col("day"), 2024)).count() == 2
    assert {r.page_no: r.all_older for r in crawl.all_older(items, 2024).collect()} == {1: False, 2: True, 3: False}


def test_a_run_stops_after_stale_pages(spark):
    new = {1: [5, 0, 0, 1, 0, 0, 0, 9, 0], 2: [0, None, 0, 4], 3: [1, 1]}
    rows = [(j, i, n) for j, ns in new.items() for i, n in enumerate(ns)]
    got = crawl.until_stale(spark.createDataFrame(rows, "crawl_job_id long, raw_id long, new_items int"), 3)
    assert sorted((r.crawl_job_id, r.raw_id) for r in got.collect()) == [(1, i) for i in range(7)] + [(2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]


def test_each_page_once(spark):
    rows = [(1, 1, "u"), (1, 2, "v"), (1, 3, "u"), (2, 4, "u")]
    assert sorted(r.raw_id for r in crawl.once(spark.createDataFrame(rows, "crawl_job_id long, raw_id long, normalized_url string")).collect()) == [1, 2, 4]


def test_texts_and_old_jobs(spark):
    df = spark.createDataFrame([(1, "manual", "partial", 0, 4, 3, 2, 1, 5, 6, 1, None, "2024-02-01", None, " 超时 ", 1)], "id int, job_type string, status string, pages_scraped int, pages_fetched int, list_items_seen int, list_items_unique int, detail_pages_fetched int, notices_upserted int, documents_saved int, list_items_source_duplicates_skipped int, source_duplicates_suppressed int, first_seen string, last_seen string, failure_reason string, return_code int")
    assert crawl.job_summary(df).first().summary == "manual 任务已结束，状态 partial，列表页 4，列表项 2/3，详情请求 1，公告 5，归档 6，去重跳过 1，最早发布日期 2024-02-01，异常 超时，退出码 1"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, 9, "pending", t, None, None, None, "a=1; b=2; a=3"), (2, 9, "running", t, t, None, None, "x"), (3, 8, "running", t, t, None, None, None)], "id long, source_site_id long, status string, created_at timestamp, started_at timestamp, queued_at timestamp, picked_at timestamp, message string")
    got = {r.id: (r.queued_at == t, r.picked_at == t, r.job_params_json) for r in crawl.backfilled(old).collect()}
    assert got == {1: (True, False, '{"a":"3","b":"2"}'), 2: (True, True, None), 3: (True, True, None)} or got[1][2] == '{"b":"2","a":"3"}'
    assert {r.id: r.status for r in crawl.demoted(old).collect()} == {1: "failed", 2: "running", 3: "running"}


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "s", "http://a/x", "甲a", "text/html", "html", dt.datetime(2024, 1, 2, 3, 4, 5)), (2, None, "http://a/y", "{}", "application/json", "json", dt.datetime(2024, 1, 2)), (3, "s", "u", None, None, None, None)], "raw_id long, source_code string, url string, raw_body string, mime_type string, document_type string, fetched_at timestamp")
    got = {r.raw_id: r for r in archives.raw_archive(pages, "base/").collect()}
    assert got[1].storage_uri.startswith("base/s/20240102T030405Z_") and got[1].storage_uri.endswith(".html") and got[1].content_length == 4 and got[2].storage_uri.startswith("base/unknown_source/") and got[2].storage_uri.endswith(".json") and len(got) == 2
    archives.write_archive(pages, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).filter("source_code = 's'").count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "A.PDF").write_bytes(b"abc")
    f = archives.file_archive(spark.read.format("binaryFile").load(str(tmp_path / "f")), "files").first()
    assert (f.file_size_bytes, f.mime_type, f.storage_uri) == (3, "application/pdf", f"files/{f.file_hash[:2]}/{f.file_hash}.pdf") and f.file_hash.startswith("ba7816bf")
    names = spark.createDataFrame([("http://a/b/%E7%94%B2.Docx?x=1", None), ("http://a/", "n.tar.GZ")], "u string, n string").select(archives.file_name(F.col("u")).alias("name"), archives.suffix(F.col("n"), F.col("u")).alias("s")).collect()
    assert [tuple(r) for r in names] == [("甲.Docx", "docx"), (None, "gz")]
    (tmp_path / "log").write_text('{"level": "info", "n": 1}\nplain line\n{"broken\n{"n": 2}\n')
    assert [(r.level, r.n) for r in archives.read_log(spark, str(tmp_path / "log"), "level string, n int").collect()] == [("info", 1), (None, 2)]


def test_sources_are_seeded_once_patched_and_created(spark):
    s = spark.createDataFrame([(7, "demo_a", "old", "x", True)], "id long, code string, name string, base_url string, is_active boolean")
    one = archives.seeded(s)
    assert sorted((r.id, r.code, r.name) for r in one.collect())[:2] == [(7, "demo_a", "Demo A"), (8, "demo_b", "Demo B")] and one.count() == 5
    assert sorted(map(tuple, archives.seeded(one).collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)
    assert archives.patched(s, "demo_a", name="n", is_active=False).first().name == "n"
    assert sorted(r.id for r in archives.created(s, "c", name="n").collect()) == [7, 8]
    with pytest.raises(KeyError):
        archives.patched(s, "none", name="n")
    with pytest.raises(ValueError, match="exists"):
        archives.created(s, "demo_a")


EVENTS = [
    (1, "queue", 0, None), (1, "claim", 5, None), (1, "claim", 60, None), (1, "claim", 200, None), (1, "start", 210, None), (1, "start", 211, None), (1, "heartbeat", 1000, None), (1, "finish", 2500, "partial"), (1, "finish", 2600, "succeeded"),
    (2, "queue", 0, None), (2, "start", 10, None), (2, "finish", 5000, "succeeded"), (3, "start", 1, None), (4, "queue", 0, None), (4, "tick", 10_000, None), (4, "finish", 10_001, "failed"), (5, "queue", 0, None), (5, "start", 1, None), (5, "tick", 1801, None),
]
ACCEPTED = [True, True, False, True, True, False, True, True, False, True, True, False, False, True, False, True, True, True, True]


def test_states_of_jobs(spark):
    got = {(r.job_id, r.at, r.action): r for r in jobs.fold_jobs(spark.createDataFrame(EVENTS, jobs.EVENT)).collect()}
    assert [got[e[0], e[2], e[1]].accepted for e in EVENTS] == ACCEPTED
    last = {r.job_id: (r.status, r.picked_at, r.finished_at) for r in jobs.snapshot(jobs.fold_jobs(spark.createDataFrame(EVENTS, jobs.EVENT))).collect()}
    assert last == {1: ("partial", 200, 2500), 2: ("failed", 10, 1810), 4: ("failed", None, 10_001), 5: ("failed", 1, 1801)}
    assert jobs.may_follow("pending", "running") and not jobs.may_follow("failed", "running")


def test_jobs_as_a_stream(spark, tmp_path):
    for i in range(3):  # three files, three batches
        spark.createDataFrame(EVENTS[i * 7 : i * 7 + 7], jobs.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    twins.run_available(jobs.fold_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = jobs.fold_jobs(spark.createDataFrame(EVENTS, jobs.EVENT))
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0 and spark.read.parquet(str(tmp_path / "out")).count() == len(EVENTS)


def test_items_are_routed_and_remembered(spark, tmp_path):
    rows = [("tender_notice", "a", dt.datetime(2024, 1, 1)), ("tender_notice", "a", dt.datetime(2024, 1, 1, 1)), ("crawl_error", "b", dt.datetime(2024, 1, 1)), ("other", "c", dt.datetime(2024, 1, 1))]
    items = spark.createDataFrame(rows, "item_type string, key string, ts timestamp")
    write = twins.route(str(tmp_path / "r"))
    write(items, 0)
    write(items, 0)  # a batch that runs again replaces itself
    assert spark.read.parquet(str(tmp_path / "r" / "tender_notice")).count() == 2 and spark.read.parquet(str(tmp_path / "r" / "crawl_error")).count() == 1
    items.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    twins.run_available(twins.once_per_run(stream, "key"), str(tmp_path / "once"), str(tmp_path / "check"))
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b", "c"]
