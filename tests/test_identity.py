"""Identity keys: what must and what must not change them, and instants in every surveyed form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.functions import html, identity

ITEM = "source_code string, title string, issuer string, region string, published_at string, budget_amount string, detail_page_url string, external_id string, notice_type string, dedup_hash string, content_text string, _f string, seed string"
BASE = {"source_code": "S1", "title": "某校（一期）采购公告", "issuer": "某校", "region": "合肥", "published_at": "2024-03-01 09:00", "budget_amount": "1,001,201元", "detail_page_url": "http://a.example/d?guid=AB1&utm_source=x", "external_id": None, "notice_type": "result", "dedup_hash": None, "content_text": "正文", "_f": "x", "seed": "y"}


@pytest.fixture(scope="module")
def keyed(spark):
    def run(*changes):
        rows = [tuple((BASE | c).values()) for c in changes]
        return identity.with_keys(spark.createDataFrame(rows, ITEM)).collect()

    return run


def test_spelling_does_not_change_keys(keyed):
    a, *others = keyed({}, {"title": " 某校(一期)  采购公告 "}, {"budget_amount": "1001499"}, {"published_at": "2024年3月1日"}, {"published_at": "2024-03-01T17:00:00+08:00"}, {"detail_page_url": "HTTP://A.example/d?spm=1&guid=ab1#top"}, {"region": " 合肥 "}, {"issuer": "某　校"})
    for o in others:
        assert (o.built_dedup_key, o.built_source_key, o.built_persistence_key) == (a.built_dedup_key, a.built_source_key, a.built_persistence_key)
    assert a.locator == "ab1" and a.bucket == "1001000" and a.published_day == "2024-03-01" and a.merge_strategy == "detail_url"


def test_what_differs_changes_keys(keyed):
    a, *others = keyed({}, {"title": "某校二期采购公告"}, {"published_at": "2024-03-02"}, {"budget_amount": "2000000"}, {"region": "芜湖"})
    for o in others:
        assert o.built_persistence_key != a.built_persistence_key and o.built_source_key == a.built_source_key


def test_locator_counts_for_persistence_only_with_few_signals(keyed):
    a, b = keyed({}, {"detail_page_url": "http://a.example/d?guid=zz"})
    assert a.built_persistence_key == b.built_persistence_key and a.built_dedup_key != b.built_dedup_key
    a, b = keyed({"issuer": None, "region": " "}, {"issuer": None, "region": " ", "detail_page_url": "http://a.example/d?guid=zz"})
    assert a.built_persistence_key != b.built_persistence_key


def test_nulls_make_no_null_keys(keyed):
    nothing = dict.fromkeys(BASE)
    (r,) = keyed(nothing)
    assert all(getattr(r, c) for c in ("list_fingerprint", "built_source_key", "built_dedup_key", "built_persistence_key", "dedup_key", "source_duplicate_key")) and r.merge_strategy == "fallback" and r.identity_hash is None and r.content_hash is None
    order = [r.merge_strategy for r in keyed(BASE | {"external_id": "7"}, {}, {"detail_page_url": None}, {"detail_page_url": "", "title": None, "dedup_hash": "h"})]
    assert order == ["external_id", "detail_url", "title", "provided"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-01-03 08:05:07", (2024, 1, 3, 8, 5, 7)), ("2024-01-03 08:05", (2024, 1, 3, 8, 5)), ("2024/1/3 8:05:07", (2024, 1, 3, 8, 5, 7)), ("2024/1/3 8:05", (2024, 1, 3, 8, 5)), ("2024-1-3", (2024, 1, 3)), ("2024/01/03", (2024, 1, 3)), ("20240103", (2024, 1, 3)),
        ("2024年1月3日 8点5分", (2024, 1, 3, 8, 5)), ("2024年01月03日08点05分", (2024, 1, 3, 8, 5)), ("2024年1月3日", (2024, 1, 3)), ("2024-01-03T08:05:07Z", (2024, 1, 3, 8, 5, 7)), ("2024-01-03T08:05:07.123+08:00", (2024, 1, 3, 0, 5, 7)), ("2024-01-03T08:05:07-0500", (2024, 1, 3, 13, 5, 7)),
        ("2024-02-30", None), ("2024-13-01 08:00", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_moments(spark, value, want):
    got = spark.createDataFrame([(value,)], "a string").select(F.unix_timestamp(identity.moment(F.col("a"))).alias("s")).first().s
    assert got == (want and int(dt.datetime(*want, tzinfo=dt.UTC).timestamp()))


def test_days_of_longer_texts(spark):
    df = spark.createDataFrame([("发布于2024年3月1日上午",), ("2024-03-01T23:30:00-05:00",), ("2024-02-31",)], "a string")
    assert [r[0] for r in df.select(identity.day(F.col("a"))).collect()] == ["2024-03-01", "2024-03-02", None]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-05-28 24:00", "2024-05-29"), ("2024-12-31T24:00:00", "2025-01-01"), ("2024-02-28 24:00:00.000Z", "2024-02-29"), ("2024-05-28T24:00+08:00", "2024-05-28"), ("2024-05-28 24:00-0500", "2024-05-29"), ("9999-12-31 24:00", "10000-01-01"),
        ("2024-02-30 24:00", None), ("2024-05-28 23:59", "2024-05-28"), ("2024年5月28日 24点00分", "2024-05-28"),
    ],
)
def test_end_of_a_day_is_the_next_day(spark, value, want):
    assert spark.createDataFrame([(value,)], "a string").select(identity.day(F.col("a")).alias("d")).first().d == want


def test_list_fingerprint_at_the_end_of_a_day(keyed):
    end, start, before = keyed({"published_at": "2024-03-01 24:00"}, {"published_at": "2024-03-02 00:00"}, {})
    assert end.list_fingerprint == start.list_fingerprint != before.list_fingerprint


def test_dedup_key_at_the_end_of_a_day(keyed):
    end, start, before = keyed({"published_at": "2024-03-01 24:00"}, {"published_at": "2024-03-02 00:00"}, {})
    assert end.built_dedup_key == start.built_dedup_key != before.built_dedup_key


def test_persistence_key_at_the_end_of_a_day(keyed):
    for few in ({}, {"issuer": None, "region": None}):
        end, start, before = keyed(few | {"published_at": "2024-03-01 24:00"}, few | {"published_at": "2024-03-02 00:00"}, few)
        assert end.built_persistence_key == start.built_persistence_key != before.built_persistence_key


@pytest.mark.parametrize(("value", "want"), [("2023031", "2023-03-01"), ("2023129", "2023-12-09"), ("2023230", None), ("2023001", None), ("2023010", None), ("202311", None), ("202303011", None)])
def test_day_without_its_zero_among_digits(spark, value, want):
    assert spark.createDataFrame([(value,)], "a string").select(identity.day(F.col("a")).alias("d")).first().d == want


def test_list_fingerprint_of_a_day_without_its_zero(keyed):
    short, whole, none = keyed({"published_at": "2024031"}, {"published_at": "20240301"}, {"published_at": None})
    assert short.list_fingerprint == whole.list_fingerprint != none.list_fingerprint


def test_dedup_key_of_a_day_without_its_zero(keyed):
    short, whole, none = keyed({"published_at": "2024031"}, {"published_at": "20240301"}, {"published_at": None})
    assert short.built_dedup_key == whole.built_dedup_key != none.built_dedup_key


def test_persistence_key_of_a_day_without_its_zero(keyed):
    for few in ({}, {"issuer": None, "region": None}):
        short, whole, none = keyed(few | {"published_at": "2024031"}, few | {"published_at": "20240301"}, few | {"published_at": None})
        assert short.built_persistence_key == whole.built_persistence_key != none.built_persistence_key


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-03-01+08:00", "2024-03-01"), ("2024-03-01 +08:00", "2024-03-01"), ("2024-03-01T00+24:00", "2024-03-01"), ("2024-03-01T23:59:59,5-24:00", "2024-03-01"), ("2024-03-01T23:59:59,5 -05:00", "2024-03-01"), ("2024-03-01 24:00 Z", "2024-03-01"),
        ("2024-03-01T00+08:00", "2024-02-29"), ("2024-03-01 00:00 +08:00", "2024-02-29"), ("2024-03-01T23:59:59,5-05:00", "2024-03-02"),
    ],
)
def test_zones_follow_times(spark, value, want):
    assert spark.createDataFrame([(value,)], "a string").select(identity.day(F.col("a")).alias("d")).first().d == want


def test_dedup_key_of_a_date_with_a_zone_but_no_time(keyed):
    zoned, plain = keyed({"published_at": "2024-03-01+08:00"}, {"published_at": "2024-03-01"})
    assert zoned.built_dedup_key == plain.built_dedup_key


def test_dedup_key_of_a_blank_page_url(spark):
    urls = [(" ", "http://a.example/s?id=1"), ("\u3000", None), (None, "http://a.example/s?id=1"), ("", "http://a.example/s?id=1")]
    rows = [tuple((BASE | {"detail_page_url": u}).values()) + (s,) for u, s in urls]
    blank, nothing, missing, empty = (r.built_dedup_key for r in identity.with_keys(spark.createDataFrame(rows, ITEM + ", source_url string")).collect())
    assert blank == nothing != missing == empty


def test_persistence_key_of_an_amount_in_other_digits(keyed):
    for few in ({}, {"issuer": None, "region": None}):
        plain, *others, less = keyed(*(few | {"budget_amount": b} for b in ("1,200,000元", "①２⁰万元", "１﹐２₀0﹐000", "1½万", "12万")))
        assert {o.built_persistence_key for o in others[:2]} == {plain.built_persistence_key} and less.built_persistence_key != plain.built_persistence_key
        assert [r.bucket for r in others] == ["1200000", "1200000", "110000"]


def test_locators():
    assert identity.locator("http://a.example/x?ID=Q7&b=1") == "q7" and identity.locator("http://a.example/x?id=1&guid=G") == "g"
    assert identity.locator("HTTP://a.example") == "http://a.example/" and identity.locator(" ") is None


LIST = """<div class="list"><ul><li><span class="date">2024-03-05</span><a href="/zfcg/newDetail?guid=1">【合肥】甲项目中标公告</a></li>
<li><a href="/zfcg/newDetail?guid=2">乙项目变更公告</a> 2024/3/7</li><li><a href="/other">丙</a></li><li><a href="/zfcg/newDetail?guid=4"> </a></li></ul></div>
<div class="gcxxfy"><a onclick="pagination(2-1)">上一页</a><a>1</a><span>2</span><a>9</a><a href="#" onclick="pagination(2+1)">下一页</a></div><input name="currentPage" value="2"><input id="totalPage" value="12">"""


def test_list_pages():
    got = html.list_items(LIST, "http://a.example/l", "/zfcg/newDetail")
    assert [(i["guid"], i["published"], i["region"], i["notice_type"]) for i in got] == [("1", "2024-03-05", "合肥", "result"), ("2", "2024-03-07", None, "change")]
    assert html.paging(LIST) == {"current": 2, "last": 12, "next": 3} and html.paging(None) == {"current": 1, "last": 1, "next": None}
    assert html.paging('<div class="gcxxfy"><a class="disabled">下一页</a></div>')["next"] is None
    assert [html.page_target(x) for x in ("pagination(3+1)", "pagination( 7 )", "pagination(2-5)", "pagination(1+)", "x", None)] == [4, 7, None, None, None, None]


def test_pages_say_what_their_notice_is():
    page = '<title>t</title><div id="title">某项目变更公告</div><table><tr><td>采购人名称</td><td></td><td>某校</td><td>项目编号</td><td>X1</td></tr><tr><td>预算金额<td>163.5万元</tr></table><div id="content"><p>截止时间：2024年3月5日9点30分</p><script>no</script></div>footer'
    p = html.page(page, "http://a.example/d?guid=G1", "【合肥】某项目")
    assert (p["title"], p["notice_type"], p["external_id"], p["region"], p["deadline"], str(p["budget"])) == ("某项目变更公告", "change", "G1", "合肥", "2024-03-05 09:30", "1635000.00")
    assert p["fields"] == {"采购人名称": "某校", "项目编号": "X1", "预算金额": "163.5万元"} and p["text"] == "截止时间：2024年3月5日9点30分"
    assert html.page("截止时间: 2024-01-02 09:30", None)["deadline"] == "2024-01-02 09:30" and html.page("截止时间：2024年13月2日9时30分", None)["deadline"] is None
