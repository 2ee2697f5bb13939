"""Plans against DuckDB on a small scale, functions against cases, sinks and streams by round trip."""

import zipfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticeforge.functions import html, text
from noticeforge.plans import catalog
from noticeforge.sources import sinks
from noticeforge.streaming import twins

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_normal_forms_are_stable(s):
    for f in (text.plain_text,):
        once = f(s)
        assert once is None or f(once) == once


def test_urls_and_titles():
    assert text.normal_url("HTTP://A.example/x?b=2&a=1&utm_source=z#f", drop_tracking=True) == "http://a.example/x?a=1&b=2"
    assert text.normal_url("http://a.example?b=") == "http://a.example/?b="
    assert text.subject_title("某项目 招标公告（公示）") == "某项目招标公告(公示)"
    assert {text.subject_title(t) for t in ("某项目竞争性磋商公告", "某项目询价", "某项目终止 - 公告", "某项目 中标结果 公示")} == {"某项目"}
    assert text.subject_title("某项目中标结果公告") == "某项目"
    assert text.canonical_json_hash('{"b":1,"a":2}') == text.canonical_json_hash('{ "a": 2, "b": 1 }')
    assert text.canonical_json_hash("{") is None


def test_buckets_and_maps(spark):
    df = spark.createDataFrame([("1,001,499元", "a=1; b=2;a=3"), ("163.5万元", "x"), ("面议", None)], "amount string, message string")
    got = df.select(text.budget_bucket("amount").alias("b"), text.k_v_map("message").alias("m")).collect()
    assert [(r.b, r.m) for r in got] == [("1001000", {"a": "3", "b": "2"}), ("1635000", {}), (None, None)]


def test_page():
    p = html.page('<html><title>T</title><script>x</script><table><tr><td>预算</td><td>a</td><td>odd</td></tr></table><p>预算金额：人民币163.5万元</p><p>截止时间：2024年1月2日9时30分</p><a href="/f/1.PDF?b=1&a=2">附件</a><a href="/f/1.PDF?a=2&b=1">again</a><a href="/n">n</a>', "http://h.example/d")
    assert (p["title"], p["budget"], p["deadline"], p["fields"]) == ("T", 1_635_000.0, "2024-01-02 09:30", {"预算": "a"})
    assert [a["url"] for a in p["attachments"]] == ["http://h.example/f/1.PDF?b=1&a=2"]
    assert html.page(None, None) is None


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("tender_notice", 1, None), ("unknown", 2, "x")], "item_type string, id int, title string")
    sinks.sink("jsonl")(items, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    with pytest.raises(ValueError, match="unknown backend"):
        sinks.sink("paper")
    rows = items.withColumn("amount", F.lit("1.50").cast("decimal(18,2)"))
    assert '"title":null' in sinks.json_rows(rows).first()[0] and '"amount":"1.50"' in sinks.json_rows(rows).first()[0]
    book = zipfile.ZipFile(BytesIO(sinks.xlsx_bytes(rows, "notices")))
    assert "1.50" in book.read("xl/worksheets/sheet1.xml").decode()


def test_merge_keeps_what_was_known(spark):
    old = spark.createDataFrame([(1, "a", "t", 1), (2, "b", "u", 2)], "k int, x string, y string, seq int")
    new = spark.createDataFrame([(1, None, "v", 3), (1, "c", None, 4), (3, "d", None, 5)], "k int, x string, y string, seq int")
    assert sorted(map(tuple, sinks.merge(old, new, ["k"], "seq").collect())) == [(1, "c", "v", 4), (2, "b", "u", 2), (3, "d", None, 5)]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    twins.run_available(twins.daily_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.to_timestamp(F.to_date("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert done.join(batch, ["day", "event_type", "n"]).count() == done.count() > 0
