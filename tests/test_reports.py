"""Reports by parameters on small tables, and every SQL text against its plan."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeforge.plans import catalog, reports

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 5, 10, 12)
AT = "TIMESTAMP '2024-05-10 12:00:00'"


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    try:
        return round(float(v), 4)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_duckdb(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    run = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in run.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in run.fetchall()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    """The five notices of the surveyed list test: 105 is a later copy of 101."""
    back = lambda **kw: NOW - dt.timedelta(**kw)
    source = spark.createDataFrame([(1, "a", "甲网", "http://a", "", True, True, 1), (2, "b", "乙网", "http://b", "http://o", False, True, 7)], "id long, code string, name string, base_url string, official_url string, is_active boolean, schedule_enabled boolean, schedule_days int")
    n = [(101, 1, "h1", "announcement", "合肥", 1000000, back(days=2), back(days=2)), (102, 1, "h2", "result", "芜湖", 560000, back(days=1), back(hours=30)), (103, 2, "h3", "change", "合肥", 800000, back(days=3), back(days=3)), (104, 1, "h4", "announcement", "马鞍山", 120000, None, back(hours=4)), (105, 2, "h1", "announcement", "合肥", 900000, NOW, NOW)]
    notices = spark.createDataFrame([(i, s, None, None, h, " ", None, f"标题{i}", k, "某单位", r, p, None, float(b), "CNY", None, c) for i, s, h, k, r, b, p, c in n], "id long, source_site_id long, external_id string, project_code string, dedup_hash string, dedup_key string, source_duplicate_key string, title string, notice_type string, issuer string, region string, published_at timestamp, deadline_at timestamp, budget_amount double, budget_currency string, summary string, created_at timestamp")
    versions = spark.createDataFrame([(201, 101, "x", "t", "announcement", None, 0, back(days=2), 1), (204, 101, "y", "t", "announcement", None, 1, back(hours=3), 2), (202, 102, "z", "t", "result", None, 1, back(hours=30), 1)], "id long, notice_id long, content_hash string, title string, notice_type string, change_summary string, is_current int, created_at timestamp, version_no int")
    job = "id long, source_site_id long, status string, job_type string, retry_of_job_id long, created_at timestamp, started_at timestamp, queued_at timestamp, picked_at timestamp, timeout_at timestamp, lease_expires_at timestamp, finished_at timestamp, message string, failure_reason string, return_code int, " + ", ".join(f"{c} int" for c in reports.COUNTERS)
    j = [(701, 1, "running", "manual", None, back(hours=0), back(minutes=1)), (702, 1, "failed", "manual", None, back(days=1), None), (703, 2, "partial", "scheduled", None, back(days=2), None), (704, 1, "succeeded", "manual", None, back(days=8), None), (705, 2, "running", "manual", None, back(hours=1), NOW + dt.timedelta(hours=1))]
    jobs = spark.createDataFrame([(i, s, st, k, r, c, c, c, None, None, lease, None, f"m{i}", None, 0, *([0] * 12)) for i, s, st, k, r, c, lease in j], job)
    errors = spark.createDataFrame([(501, 1, 701, "fetch", "E", back(hours=0), back(hours=0), "late"), (502, 1, 702, "parse", "E", back(days=1), back(days=1), "detail broke"), (503, 2, 703, "parse", "E", back(days=9), back(days=9), " ")], "id long, source_site_id long, crawl_job_id long, stage string, error_type string, created_at timestamp, occurred_at timestamp, message string")
    documents = spark.createDataFrame([(401, 1, 701, "html", "c", back(days=1)), (402, 2, 703, "pdf", "d", None)], "id long, source_site_id long, crawl_job_id long, document_type string, content_hash string, fetched_at timestamp")
    files = spark.createDataFrame([(301, 101, "f1", "notice_file", 1)], "id long, notice_id long, file_name string, attachment_type string, file_size_bytes long")
    return reports.Tables(spark, "", {"source": source, "tender_notice": notices, "notice_version": versions, "crawl_job": jobs, "crawl_error": errors, "raw_document": documents, "tender_attachment": files})


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_orders_and_pages(tables):
    page = lambda limit=20, offset=0, **kw: ids(reports.notices(tables, limit=limit, offset=offset, as_of=AT, **kw))
    four = {"source_code": "a"}
    assert page(**four) == [101, 104, 102] and page(limit=2, offset=1, **four) == [104, 102]
    assert page() == [105, 104, 102, 103] and page(dedup=False) == [105, 101, 104, 102, 103]
    assert page(recent_hours=24) == [105, 104] and page(recent_hours=24, dedup=False) == [105, 101, 104]
    assert page(sort_by="budget_amount", sort_order="asc") == [104, 102, 103, 105] and page(sort_by="nonsense", sort_order="asc") == [103, 102, 105, 104]
    assert page(keyword="合__") == [] and page(keyword="%肥", dedup=False) == [105, 101, 103] and page(keyword=" ") == page()
    assert page(date_from="2024-05-09", date_to="2024-05-09") == [102] and page(region="合肥", notice_type="change") == [103]
    with pytest.raises(ValueError, match="limit"):
        reports.notices(tables, limit=201)
    with pytest.raises(ValueError, match="recent_hours"):
        reports.notices(tables, recent_hours=0)


def test_totals_related_and_detail(tables):
    assert tuple(reports.totals(tables, as_of=AT).first()) == (5, 4)
    assert {r.related_id for r in reports.related(tables, F.col("id") == 105).collect()} == {101, 105}
    r = reports.detail(tables).filter("notice_id = 101").first()
    assert [v.version_no for v in r.versions] == [2, 1] and r.version_id == 204 and [a.id for a in r.attachments] == [301]
    assert reports.current_versions(tables, version_no=1).filter("notice_id = 101").first().version_id == 201
    assert reports.current_versions(tables, version_id=201, version_no=2).filter("notice_id = 101").first().version_id == 201
    assert reports.paging_links(45, 20, 20) == {"has_prev": True, "prev_offset": 0, "has_next": True, "next_offset": 40}


def test_overview_and_trends(tables):
    r = reports.overview(tables, AT, AT).first()
    assert (r.n_sources, r.n_active, r.n_jobs, r.n_running, r.n_notices, r.new_today, r.new_24h, r.n_documents, r.n_errors) == (2, 1, 5, 1, 5, 3, 3, 2, 3)
    days = [(r.day, r.n) for r in reports.trend(tables, "crawl_error", 7, AT).orderBy("day").collect()]
    assert len(days) == 7 and days[-1] == ("2024-05-10", 1) and days[0] == ("2024-05-04", 0) and sum(n for _, n in days) == 2


def test_expired_jobs_are_failed_and_counted(tables):
    assert ids(reports.jobs(tables, preset="today_failed", as_of=AT)) == [701]
    assert ids(reports.jobs(tables, preset="abnormal", limit=10, as_of=AT)) == [701, 702, 703] and len(ids(reports.jobs(tables, preset="other", as_of=AT))) == 5
    ops = {r.source_code: r for r in reports.operations(tables, 24, AT, AT).collect()}
    assert (ops["a"].job_count, ops["a"].failed_count, ops["a"].last_job_status, ops["a"].official_url, ops["a"].last_error_message) == (2, 2, "succeeded", "http://a", "detail broke")
    assert ops["b"].last_error_message is None and ops["a"].new_notice_count == 2
    shown = {r.id: (r.is_active, r.is_stale, r.stage_label) for r in reports.progress(tables["crawl_job"], AT).collect()}
    assert shown[701] == (False, True, "心跳超时") and shown[705] == (True, False, "启动 Spider") and shown[702][2] == "失败"


def test_health(spark, tables):
    rules = {"errors_warning": 2, "errors_critical": 5, "streak_warning": 1, "streak_critical": 2, "partial_warns": False}
    cases = [(0, 1, "failed", "warning"), (0, 2, "failed", "critical"), (0, 0, "partial", "normal"), (5, 0, "succeeded", "critical"), (2, 0, "succeeded", "warning"), (0, 0, "succeeded", "normal"), (0, 0, "pending", "warning"), (0, 0, None, "warning")]
    df = spark.createDataFrame(cases, "e int, s int, latest string, want string")
    assert df.filter(reports.health_of(F.col("e"), F.col("s"), F.col("latest"), rules) != F.col("want")).count() == 0
    h = {r.source_code: r for r in reports.health(tables, jobs_as_of=AT, errors_as_of=AT).collect()}
    assert (h["a"].health_status, h["a"].recent_7d_error_count, h["a"].latest_failure_reason, h["b"].latest_failure_reason) == ("normal", 2, "late", "m705")
    assert {r.source_code: r.health_status for r in reports.source_page(tables).collect()}["b"] == "warning"


def test_sheet_of_operations(tables):
    import io
    import zipfile

    from noticeforge.sources import sinks

    sheet = zipfile.ZipFile(io.BytesIO(sinks.source_ops_xlsx(reports.operations(tables, 24, AT, AT)))).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and sheet.count("<c r=\"O") == 3 and "detail broke" in sheet


def test_rules_and_constraints(tables):
    from noticeforge.plans import checks

    assert checks.checked_rules({"errors_critical": 9})["errors_critical"] == 9
    for bad in ({"errors_warning": -1}, {"streak_warning": 3}, {"other": 1}):
        with pytest.raises(ValueError, match="thresholds|unknown"):
            checks.checked_rules(bad)


def test_list_records_by_any_name(spark):
    from noticeforge.plans import extraction

    body = '{"data": {"records": [{"titleShow": "甲项目中标公告", "detailUrl": "/d?id=Q1&utm_x=1", "publishDate": "2024-03-01 08:00", "provinceText": "合肥", "infoID": 7}, {"title": " "}, {"title": "甲项目 变更", "informationTypeText": "公告"}]}}'
    df = spark.createDataFrame([(1, "s", "http://a.example/l", body), (2, "s", None, "no json"), (3, "s", None, None)], "raw_id long, source_code string, url string, raw_body string")
    a, b = extraction.list_identities(df).orderBy("at").collect()
    assert (a.title, a.detail_url, a.day, a.subject, a.kind, a.own_id, a.province) == ("甲项目中标公告", "http://a.example/d?id=Q1", "2024-03-01", "甲项目", "result", "7", "合肥")
    assert b.kind == "change" and b.detail_url is None and len({a.source_key, a.fingerprint, b.source_key}) == 3 and b.source_key == b.fingerprint


def test_outcomes(tables):
    got = {r.id: (r.failure_reason, r.final_status) for r in reports.outcomes(tables).collect()}
    assert got[701] == ("页面获取失败: late", "failed") and got[702] == ("列表解析为0", "succeeded")


def test_filters_of_errors_and_documents(tables):
    assert ids(reports.errors(tables, stage="parse", limit=5)) == [502, 503] and ids(reports.errors(tables, crawl_job_id=701)) == [501]
    assert ids(reports.documents(tables, limit=5)) == [401, 402] and ids(reports.documents(tables, document_type="pdf")) == [402]
    assert {r.source_site_id for r in reports.error_page(tables).collect()} == {1, 2}
