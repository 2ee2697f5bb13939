"""Readings of typed times, the chain over a source's records, and the operator's edges."""

import datetime as dt
import itertools
import random
from zoneinfo import ZoneInfo

import pytest

from noticeforge.operators.timestamps import _step, best_chain, normalise_timestamps, readings

Z = "Asia/Shanghai"


def utc(*parts, zone=Z):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp())


@pytest.mark.parametrize(
    ("value", "zone", "order", "want"),
    [
        ("2024-01-03 08:05:07", Z, "YMD", utc(2024, 1, 3, 8, 5, 7)),
        ("2024-01-03T08:05:07.900Z", Z, "YMD", utc(2024, 1, 3, 8, 5, 7, zone="UTC")),
        ("2024-01-03T08:05:07-0500", Z, "YMD", utc(2024, 1, 3, 13, 5, 7, zone="UTC")),
        ("20240103080507", Z, "YMD", utc(2024, 1, 3, 8, 5, 7)),
        ("20240103", Z, "YMD", utc(2024, 1, 3)),
        ("1704240000", Z, "YMD", 1704240000),
        ("1704240000123", Z, "YMD", 1704240000),
        ("2024年1月3日下午3:05", Z, "YMD", utc(2024, 1, 3, 15, 5)),
        ("2024年01月14日14点整", Z, "YMD", utc(2024, 1, 14, 14)),
        ("２０２４－０１－０２　２１：２６", Z, "YMD", utc(2024, 1, 2, 21, 26)),
        ("二〇二四年二月二十五日", Z, "YMD", utc(2024, 2, 25)),
        ("北京时间2023-12-30 10:32", "Europe/Berlin", "DMY", utc(2023, 12, 30, 10, 32)),
        ("03/04/2024 7:10 pm", "America/New_York", "MDY", utc(2024, 3, 4, 19, 10, zone="America/New_York")),
        ("03/04/2024", "Europe/London", "DMY", utc(2024, 4, 3, zone="Europe/London")),
        ("13/04/2024", "America/New_York", "MDY", utc(2024, 4, 13, zone="America/New_York")),
        ("15 Jun 2024 11:07 BST", "Europe/London", "DMY", utc(2024, 6, 15, 11, 7, zone="Europe/London")),
        ("January 6, 2024 8:43 PM IST", "Asia/Kolkata", "DMY", utc(2024, 1, 6, 20, 43, zone="Asia/Kolkata")),
        ("Tue, 19 Dec 2023 15:44:56 GMT", Z, "YMD", utc(2023, 12, 19, 15, 44, 56, zone="UTC")),
        ("2024-01-03 24:00", Z, "YMD", utc(2024, 1, 4)),
    ],
)
def test_reading(value, zone, order, want):
    found = readings(value, zone, order)
    assert min(found, key=lambda r: r[2])[0] == want


@pytest.mark.parametrize("value", [None, "", "-", "N/A", "9:30", "2023-02-30", "2024-13-05 09:00", "0000-00-00 00:00:00", "2024-01-03 25:00", "见附件", "长期有效", "x" * 50_000])
def test_no_reading(value):
    assert readings(value, Z, "YMD") == []


def test_repeated_hour_has_two_readings():
    assert len(readings("2024-11-03 01:30:00", "America/New_York", "MDY")) == 2


def test_chain_equals_exhaustive_search():
    rnd = random.Random(5)
    for _ in range(200):
        states = [[(rnd.randrange(10) * 86_400, rnd.choice("ab"), rnd.random()) for _ in range(rnd.choice([1, 1, 2, 3]))] for _ in range(6)]
        cost = lambda pick: sum(s[i][2] for s, i in zip(states, pick)) + sum(_step(states[k][pick[k]], states[k + 1][pick[k + 1]]) for k in range(5))  # noqa: E731, B023
        best = min(cost(p) for p in itertools.product(*(range(len(s)) for s in states)))
        assert cost(best_chain(states)) == pytest.approx(best)


def test_operator_on_edges(spark):
    rows = [(1, "s", "2024-01-03", None, "x"), (2, "s", "03/04/2024", "2023-02-30", "x"), (3, "t", "2024-01-03 00:00:00", "", "x"), (4, None, "20240103", "TBD", "x"), (None, "s", "20240103", None, "x"), (2, "s", "03/04/2024", "2023-02-30", "x")]
    items = spark.createDataFrame(rows, "item_id long, source_code string, published_at string, deadline_at string, tz_name string")
    zones = spark.createDataFrame([("s", Z, "DMY"), ("s", "UTC", "MDY")], "source_code string, tz_name string, date_order string")
    got = [(r.id, r.field_name, r.utc_second) for r in normalise_timestamps(items, zones, ["published_at", "deadline_at"], block=2).collect()]
    assert set(got) == {(1, "published_at", utc(2024, 1, 3)), (2, "published_at", utc(2024, 4, 3)), (3, "published_at", utc(2024, 1, 3, zone="UTC")), (4, "published_at", utc(2024, 1, 3, zone="UTC"))}
    assert len(got) == 5
    assert normalise_timestamps(items.limit(0), zones, ["published_at"]).count() == 0


def _days(n):
    return [dt.date(2024, 1, 3) + dt.timedelta(days=2 * i) for i in range(n)]


def _read(spark, values, order, known=True):
    rows = [(i, "s", v) for i, v in enumerate(values)]
    items = spark.createDataFrame(rows, "item_id long, source_code string, published_at string")
    zones = spark.createDataFrame([("s" if known else "t", "UTC", order)], "source_code string, tz_name string, date_order string")
    return {r.id: dt.datetime.fromtimestamp(r.utc_second, dt.UTC).date() for r in normalise_timestamps(items, zones, ["published_at"]).collect()}


def test_chain_overrules_a_wrong_declaration(spark):
    """The source is declared DMY but writes MDY: its dates beyond the twelfth and its order show it."""
    days = _days(120)
    assert _read(spark, [d.strftime("%m/%d/%Y") for d in days], "DMY") == dict(enumerate(days))
    assert _read(spark, [d.strftime("%d/%m/%Y") for d in days], "DMY") == dict(enumerate(days))


def test_order_of_records_decides_without_a_declaration(spark):
    """Only steps back in time tell which order open dates have; the cheapest reading alone would take the first."""
    days = [d for d in _days(170) if d.day <= 12 and d.day != d.month]
    iso = [d.isoformat() for d in days]
    for form in ("%m/%d/%Y", "%d/%m/%Y"):
        values = [d.strftime(form) if i % 3 == 1 else iso[i] for i, d in enumerate(days)]
        assert _read(spark, values, "YMD", known=False) == dict(enumerate(days))


def test_declaration_holds_where_records_have_no_order(spark):
    rnd = random.Random(2)
    days = rnd.sample([dt.date(2024, m, d) for m in range(1, 13) for d in range(1, 28)], 200)
    assert _read(spark, [d.strftime("%d/%m/%Y") for d in days], "DMY") == dict(enumerate(days))
