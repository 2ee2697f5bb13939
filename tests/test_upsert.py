"""Items written one after the other: small sequences, and components against one fold over everything."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.operators import upsert
from noticeforge.plans import writes

SF = "/root/testdata/sf0.001"
N = "item_id long, source_code string, crawl_job_id long, crawled_at timestamp, external_id string, source_duplicate_key string, dedup_key string, dedup_hash string, title string, notice_type string, issuer string, region string, published_at string, deadline_at string, budget_amount string, budget_currency string, detail_page_url string, content_text string, raw_content_hash string, component string"
V = "snap_id long, source_code string, crawl_job_id long, observed_at timestamp, notice_external_id string, notice_dedup_hash string, source_duplicate_key string, dedup_key string, title string, notice_type string, issuer string, region string, published_at string, deadline_at string, budget_amount string, budget_currency string, content_hash string, version_no string, is_current string"
T0 = dt.datetime(2024, 1, 1)


def rows(schema, items):
    names = [c.split()[0] for c in schema.split(", ")]
    return [tuple(({n: None for n in names} | i)[n] for n in names) for i in items]


@pytest.fixture
def written(spark):
    def run(notices, versions=()):
        n = [{"item_id": i, "source_code": "s", "crawl_job_id": 1, "crawled_at": T0 + dt.timedelta(hours=i), "detail_page_url": f"http://a.example/d?guid={i}", "dedup_key": f"k{i}", "source_duplicate_key": f"s{i}", "dedup_hash": f"h{i}", "title": "甲", "component": "x"} | x for i, x in notices]
        v = [{"snap_id": i, "source_code": "s", "crawl_job_id": 2, "observed_at": T0 + dt.timedelta(hours=i), "title": "甲", "source_duplicate_key": f"v{i}", "dedup_key": f"w{i}"} | x for i, x in versions]
        out = upsert.write_items(upsert.item_stream(spark.createDataFrame(rows(N, n), N), spark.createDataFrame(rows(V, v), V))).collect()
        effects = {(r.kind[0] + str(r.seq // 2)): (r.outcome, r.notice_seq) for r in out if r.what == "effect"}
        return effects, [r for r in out if r.what == "notice"], sorted(((r.notice_seq, r.version_no, r.content_hash, r.is_current) for r in out if r.what == "version")), out

    return run


def test_cascade_and_merge(written):
    effects, notices, _, out = written([
        (1, {"external_id": "7", "issuer": "某校", "published_at": "2024-03-02", "budget_amount": "1,000"}), (2, {"external_id": " 7 ", "issuer": None, "published_at": "2024-03-01", "title": "乙"}), (3, {"source_duplicate_key": "s2"}),
        (4, {"dedup_key": "k1", "source_duplicate_key": "s9"}), (5, {"dedup_hash": "h4", "dedup_key": "k9", "source_duplicate_key": "s5"}), (6, {"title": None}), (7, {"source_code": "t", "external_id": "7"}), (8, {}),
    ])
    # 4's keys became the notice's, so k1 is found by none after it; the hash of 4 is
    assert effects == {"n1": ("created", 2), "n2": ("merged", 2), "n3": ("merged", 2), "n4": ("created", 8), "n5": ("merged", 8), "n6": ("dropped", None), "n7": ("created", 14), "n8": ("created", 16)}
    first = next(r for r in notices if r.notice_seq == 2)
    assert (first.external_id, first.issuer, first.title, first.budget_amount) == ("7", "某校", "甲", "1000.00")
    day = lambda d: int(dt.datetime(2024, 3, d, tzinfo=dt.UTC).timestamp() * 1e6)
    assert (first.published_us, first.first_published_us, first.latest_published_us) == (day(1), day(1), day(2))
    counted = {r.outcome: (r.notices_upserted, r.deduplicated_count, r.records_inserted, r.records_updated) for r in out if r.what == "effect"}
    assert counted == {"created": (1, 0, 1, 0), "merged": (1, 1, 0, 1), "dropped": (0, 0, 0, 0)}


def test_likeness_needs_one_of_one_or_two_of_more(written):
    same = {"published_at": "2024-03-01", "issuer": "某校", "region": "合肥", "budget_amount": "1001201"}
    effects, *_ = written([(1, same), (2, same | {"budget_amount": "900000"}), (3, same | {"region": "芜湖", "budget_amount": "500000"}), (4, {"published_at": "2024-03-01", "region": "合肥"}), (5, {"published_at": "2024-03-01"}), (6, same | {"published_at": "2024-03-02"}), (7, same | {"title": " 甲 ", "budget_amount": "1001499"})])
    assert [effects[f"n{i}"][1] for i in range(1, 8)] == [2, 2, 6, 2, 10, 12, 2]


def test_versions(written):
    effects, _, versions, _ = written([(1, {"external_id": "7"})], [
        (2, {"notice_external_id": "7", "content_hash": "a", "version_no": "1"}), (3, {"notice_external_id": "7", "content_hash": "b", "version_no": "1"}), (4, {"notice_external_id": "7", "content_hash": "c", "version_no": "9"}),
        (5, {"notice_external_id": "7", "content_hash": "a", "version_no": "4"}), (6, {"notice_external_id": "7", "content_hash": None, "version_no": "9", "is_current": "false"}), (7, {"notice_external_id": "7", "content_hash": None, "version_no": "30"}),
    ])
    assert versions == [(2, 1, "a", True), (2, 2, "b", False), (2, 9, "c", False)]
    assert [effects[f"v{i}"][0] for i in range(2, 8)] == ["version", "version", "version", "version again", "version again", "dropped"]


def test_same_content_of_a_known_key_is_suppressed(written):
    effects, *_ = written([(1, {"external_id": "7"}), (3, {"source_duplicate_key": "s1", "raw_content_hash": "a"}), (5, {"dedup_key": "w2", "raw_content_hash": "a"}), (6, {"source_duplicate_key": "v2", "raw_content_hash": "b", "external_id": "7"})], [(2, {"notice_external_id": "7", "content_hash": "a"})])
    assert [effects[f"n{i}"][0] for i in (1, 3, 5, 6)] == ["created", "created", "suppressed", "merged"]


def test_components_give_what_one_fold_gives(spark):
    items = upsert.item_stream(spark.read.parquet(f"{SF}/notice_item.parquet"), spark.read.parquet(f"{SF}/notice_version_item.parquet"))
    want, folds = {}, {}
    for r in sorted((r.asDict() for r in items.collect()), key=lambda r: (r["source_code"], r["at"], r["seq"])):
        f = folds.setdefault(r["source_code"], upsert.Fold())
        number, outcome, _ = f.notice(r) if r["kind"] == "notice" else f.version(r)
        want[r["source_code"], r["seq"]] = (number, outcome)
    got = {(r.source_code, r.seq): (r.notice_seq, r.outcome) for r in writes.notice_resolution(spark, SF).collect()}
    assert got == want and len({o for _, o in got.values()}) >= 3
    versions = writes.notice_version_state(spark, SF)
    assert versions.filter("is_current").groupBy("source_code", "notice_seq").count().filter("count > 1").count() == 0
    assert upsert.write_items(items.limit(0)).count() == 0


def test_replay_adds_nothing(spark):
    items = upsert.item_stream(spark.read.parquet(f"{SF}/notice_item.parquet"), spark.read.parquet(f"{SF}/notice_version_item.parquet"))
    twice = items.unionByName(items.withColumn("at", F.col("at") + 10**15).withColumn("seq", F.col("seq") + 10**9))
    once, again = (upsert.write_items(x).filter("what != 'effect'").groupBy("what").count().collect() for x in (items, twice))
    assert sorted(map(tuple, once)) == sorted(map(tuple, again))


def test_pages(spark):
    df = spark.createDataFrame([(1, "s", 1, "u1", "c1", None, '{"role": "list", "page_item_count": -3, "new_unique_item_count": "4"}'), (2, "s", 1, "u1", "c1", None, None), (3, "s", 1, "u2", "c1", None, '{"role": "detail"}'), (4, "s", 1, "u1", "c2", None, None), (5, "t", 1, "u1", "c1", None, None), (6, "s", 1, None, "c1", None, None), (7, "s", None, "u3", None, None, None)], "raw_id long, source_code string, crawl_job_id long, url_hash string, content_hash string, one_url string, extra_meta string")
    got = {r.raw_id: (r.is_duplicate_url, r.is_duplicate_content, r.list_items_seen, r.list_items_unique, r.detail_pages_fetched) for r in upsert.page_effects(df.drop("one_url")).collect()}
    assert got == {1: (False, False, 0, 4, 0), 2: (True, False, 0, 0, 0), 3: (False, True, 0, 0, 1), 4: (True, False, 0, 0, 0), 5: (False, False, 0, 0, 0), 7: (False, False, 0, 0, 0)}
