"""Source duplicates by either key."""

from noticeforge.plans import catalog, suppression

SF = "/root/testdata/sf0.001"


def test_either_key_and_only_kept_items(spark, tmp_path):
    rows = [
        (1, "s", "k1", "s1", "h"), (2, "s", "k1", "s2", "h"), (3, "s", "k3", "s2", "h"),  # 3 is like 2 only, which isn't kept
        (4, "s", "k4", "s1", "h"), (5, "s", " ", "s9", "h"), (6, "s", "s9", None, "h"), (7, "s", "k1", "s1", "g"), (8, "t", "k1", "s1", "h"),
        (9, "s", None, "", "h"), (10, "s", " ", None, "h"), (11, "s", "k1", "s1", None), (12, "s", " k3 ", None, "h"),
    ]
    spark.createDataFrame(rows, "item_id long, source_code string, dedup_key string, source_duplicate_key string, raw_content_hash string").write.parquet(str(tmp_path / "notice_item.parquet"))
    got = catalog.QUERIES["source_dup_suppress_keys"](spark, str(tmp_path))
    assert sorted(r.item_id for r in got.collect()) == [2, 4, 6, 12]


def test_as_a_plain_fold_over_all_items(spark):
    items, want = spark.read.parquet(f"{SF}/notice_item.parquet").collect(), []
    clean = lambda v: (v or "").strip(" ") or None
    groups = {}
    for r in items:
        if r.raw_content_hash is not None:
            groups.setdefault((r.source_code, r.raw_content_hash), []).append((r.item_id, clean(r.dedup_key) or clean(r.source_duplicate_key), clean(r.source_duplicate_key)))
    for g in groups.values():
        want += suppression.suppressed(*map(list, zip(*g)))
    got = sorted(r.item_id for r in catalog.QUERIES["source_dup_suppress_keys"](spark, SF).collect())
    assert got == sorted(want) and len(got) > 0
