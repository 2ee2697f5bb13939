"""The tree of runs against a fold over each history."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from noticeforge.operators.history import coalesce_history, notice_history, notice_looks

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "e string, observed_at timestamp, snap_id long, content_hash string, signature long"


def fold(looks):
    """Periods of one entity's looks, one after the other."""
    at = {}
    for t, snap, h, s in looks:
        if t is None:
            continue
        at[t] = min(at.get(t, (snap, h is None, h or "", s)), (snap, h is None, h or "", s))
    periods, last, pending = [], None, False
    for t in sorted(at):
        snap, _, h, s = at[t]
        if last is None:
            new = True
        elif h and last[0]:
            new = h != last[0]
        else:
            new = s != last[1]
        if new:
            periods.append([t, snap])
            last = (h, s)
        else:
            last = (last[0] or h, s)
    return periods


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_fold(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], []
    for e, n in (("hot", 400), ("b", 33), ("c", 2), ("d", 1)):
        body, looks = 0, []
        for i in range(n):
            body += rnd.random() < 0.3
            sig = body // 2
            looks.append((T0 + dt.timedelta(hours=i), 1000 * len(e) + i, None if rnd.random() < 0.3 else f"h{body % 7}", sig))
        looks += rnd.sample(looks, n // 4)
        rows += [(e, *x) for x in looks]
        want += [(e, i + 1, t, s) for i, (t, s) in enumerate(fold(looks))]
    rnd.shuffle(rows)
    got = coalesce_history(spark.createDataFrame(rows, SCHEMA), ["e"]).select("e", "period_no", "valid_from", "first_snap_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_periods_end_where_the_next_begin(spark):
    rows = [("a", T0 + dt.timedelta(days=i), i, h, 0) for i, h in enumerate("xxyyx")]
    got = coalesce_history(spark.createDataFrame(rows, SCHEMA), ["e"]).orderBy("period_no").collect()
    assert [(r.first_snap_id, r.valid_to and r.valid_to.day) for r in got] == [(0, 3), (2, 5), (4, None)]


def test_one_instant_is_one_whole_row(spark):
    """Two looks at one instant aren't mixed: the first row's hash goes with its own signature."""
    rows = [("a", T0, 2, "h1", 20), ("a", T0, 1, "h2", 10), ("a", T0 + dt.timedelta(1), 3, None, 10), ("a", T0 + dt.timedelta(2), 4, "h2", 10)]
    got = coalesce_history(spark.createDataFrame(rows, SCHEMA), ["e"]).collect()
    assert [(r.period_no, r.first_snap_id, r.content_hash) for r in got] == [(1, 1, "h2")]


VERSION = "snap_id long, source_code string, observed_at timestamp, notice_external_id string, notice_dedup_hash string, content_hash string, title string, notice_type string, issuer string, region string, deadline_at string, budget_amount string, hash string, pid int"


def test_notation_keys_and_nulls(spark):
    day = lambda i: T0 + dt.timedelta(days=i)
    rows = [
        (1, "s", day(0), " 7 ", "AB", "sha256:FF", "t（1）", "result", "i", "r", "2024-01-01T00:00:00Z", "1,000.00", "x", 1),
        (2, "s", day(1), None, "ab ", "-", "t(1)", "result", "i", "r", "2024-01-01T00:00:00Z", "1000", None, 2),
        (3, "s", day(2), "7", None, "ff ", "t(1)", "result", "i", "r", "2024-01-01T00:00:00Z", "1000.0", None, None),
        (3, "s", day(2), "7", None, "ff ", "t(1)", "result", "i", "r", "2024-01-01T00:00:00Z", "1000.0", None, None),
        (4, "s", day(3), "7", None, None, None, None, None, None, None, None, None, None),
        (5, "s", day(4), None, "cd", None, "a" * 70_000, None, None, None, "soon", "free", None, None),
        (6, "s", None, "7", None, None, None, None, None, None, None, None, None, None),
        (7, None, day(5), None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, VERSION)
    got = {(r.source_code, r.notice_external_id, r.period_no, r.first_snap_id) for r in notice_history(df).collect()}
    assert got == {("s", "7", 1, 1), ("s", "7", 2, 4), ("s", None, 1, 5)}
    assert notice_history(df.limit(0)).count() == 0
    assert notice_looks(df).filter(F.col("entity") == "e:7").count() == 6
