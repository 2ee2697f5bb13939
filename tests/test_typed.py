"""Queries over notices in every notation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.functions import text
from noticeforge.plans import catalog, sqlbook, typed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-08-17T08:13:13+08:00", "2024-08-17 00:13:13"), ("2023年12月31日 19时13分", "2023-12-31 19:13:00"), ("2024年1月2日9点5分", "2024-01-02 09:05:00"), ("20240102", "2024-01-02 00:00:00"),
        ("2024/1/2 9:05", "2024-01-02 09:05:00"), ("2024-01-02T09:05:00Z", "2024-01-02 09:05:00"), ("2024-01-02 09:05（北京时间）", "2024-01-02 01:05:00"), ("2024-02-30", None), ("待定", None), (None, None),
    ],
)
def test_instants(value, want):
    got = typed.instant(value, "Asia/Shanghai", "YMD")
    assert (got and str(dt.datetime.fromtimestamp(got, dt.UTC))[:19]) == want


def test_amounts(spark):
    cases = {"163万元": 1_630_000, "1,001,499.50": 1_001_499.5, "１６３．５ 万元": 1_635_000, "￥8,100": 8100, "1.234.000,00 EUR": 1_234_000, "about 90k": 90_000, "0.00": 0, "123": 123, "面议": None, "": None}
    rows = spark.createDataFrame([(a,) for a in cases], "a string").select("a", text.typed_amount("a").cast("double").alias("got")).collect()
    assert {r.a: r.got for r in rows} == cases


def test_typed_relation_adds_to_the_plain_one(spark):
    plain = sqlbook.run(spark, SF, "SELECT id, published_at, deadline_at, budget_amount, created_at, notice_type FROM tender_notice")
    more = typed.tender_notice(spark, SF)
    both = plain.alias("p").join(more.alias("m"), "id")
    kept = [F.count_if(F.col(f"p.{c}").isNotNull() & ~F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}"))).alias(c) for c in plain.columns[1:]]
    assert both.count() == plain.count() == more.count()
    assert set(both.agg(*kept).first()) == {0}
    n = more.agg(*(F.count(c) for c in ("published_at", "deadline_at", "budget_amount"))).first()
    assert all(a > 1.8 * b for a, b in zip(n, plain.agg(*(F.count(c) for c in ("published_at", "deadline_at", "budget_amount"))).first()))


def test_typed_queries_have_the_books_columns(spark):
    for name in ("notice_date_range", "notice_list_dedup", "similarity_match", "notice_page", "notice_sort_deadline_at_asc"):
        assert catalog.QUERIES[f"{name}_typed"](spark, SF).schema == catalog.QUERIES[name](spark, SF).schema
    count = lambda name: catalog.QUERIES[name](spark, SF).count()
    assert count("notice_date_range_typed") > count("notice_date_range")


def test_buckets_of_halves(spark):
    cases = {"500": "1000", "1500": "2000", "2500.00": "3000", "1499.99": "1000", "499.99996": "0", "0.25万": "3000", "-500": "-1000", "－1,500元": "-2000", "１，５００": "2000", "163万元": "1630000", "预计约49.95万": "500000", "面议": None, None: None}
    rows = list(enumerate(cases))
    got = {r.id: r.b for r in spark.createDataFrame(rows, "id long, budget_amount string").select("id", text.budget_bucket("budget_amount").alias("b")).collect()}
    assert got == {i: cases[a] for i, a in rows}
