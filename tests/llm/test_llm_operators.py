"""Operators of the text problems on small tables: results, incremental loads, and defined edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noticeforge.llm import boilerplate, history_dedup, leaks, lookalikes, mixing, names, stuffed_pages, truth

ITEM = "item_id long, batch_no int, source_code string, crawled_at timestamp, project_code string, dedup_key string, source_duplicate_key string, title string, notice_type string, issuer string, region string, published_at string, deadline_at string, budget_amount string, summary string, detail_page_url string, content_text string, signature string, k string, hash string"
BODY = "甲市乙县丙局的水泵采购项目，编号为{code}，已具备实施条件，现采用询价方式选定承接单位。\n一、项目概况：用于更换到期设备，共计{n}台。\n二、资金已落实，预算{n}00元，报价超出者按无效处理。\n联系人：某工，电话：0900-{n}"


def item(i, code="ZC2024-A00000001", title="丙局2024年水泵采购项目公告", kind="announcement", n=123, text=True, **more):
    row = dict.fromkeys(c.split()[0] for c in ITEM.split(", "))
    row |= {"item_id": i, "batch_no": (i - 1) // 4, "source_code": "s", "crawled_at": dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "project_code": code, "title": title, "notice_type": kind, "detail_page_url": f"u{i}", "content_text": BODY.format(code=code or "ZC2024-A00000001", n=n) if text else None, "signature": "clash", "k": "clash", "hash": "clash"}
    return tuple((row | more).values())


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        item(1), item(2, n=124), item(3, title="丙局2024年水泵采购项目（一标段）公告"), item(4, title="丙局2024年水泵采购项目-01包公告"),
        item(5, code=None), item(6, title="丙局2024年水泵采购项目更正公告", kind=None), item(7, title="丙局2025年水泵采购项目（第二次）公告"), item(8, n=123),
        item(9, code="ZC2024-A00000002", n=7), item(10, code=None, text=False, detail_page_url="u9", dedup_key=None), item(11, title=None, notice_type=None, text=False, project_code=None, detail_page_url=None), item(12, title="丙局2024年水泵采购项目（一标段）公告", content_text="x" * 60_000 + "\n" + BODY.format(code="ZC2024-A00000001", n=5)),
        item(8, n=123),
    ]
    return spark.createDataFrame(rows, ITEM)


REPEATS = {(1, 2), (1, 5), (1, 8), (9, 10), (3, 12)}


def pairs(df):
    rows = [(r.kept_item_id, r.item_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_repeated_notices(items):
    assert pairs(history_dedup.repeated(items)) == REPEATS
    assert pairs(history_dedup.repeated(items.limit(0))) == set()


def test_loads_one_after_the_other_give_the_same(spark, items, tmp_path):
    history = history_dedup.AcceptedHistory(spark, str(tmp_path), buckets=4)
    found, sizes = set(), []
    for b in (0, 1, 1, 2):  # a batch that is loaded again adds nothing
        found |= pairs(history.load(items.filter(F.col("batch_no") == b), b))
        sizes.append(spark.table(history.name).count())
    assert found == REPEATS and sizes[1] == sizes[2]
    # a load that was broken off before it was noted is done again, with the same result
    (tmp_path / "loads" / "batch_no=2" / "_SUCCESS").unlink()
    for f in (tmp_path / "loads" / "batch_no=2").iterdir():
        f.unlink()
    (tmp_path / "loads" / "batch_no=2").rmdir()
    assert pairs(history.load(items.filter(F.col("batch_no") == 2), 2)) == {p for p in REPEATS if p[1] > 8}
    # bucketed by key: the history isn't moved when it is looked up
    assert "Exchange" not in history._known(9).groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    history.drop()
    assert not (tmp_path / "chunks").exists()


def test_coverage_decides(spark):
    """Without the chunks nothing is found; any shared chunk instead of coverage gives other rows."""
    items = spark.read.parquet("/root/testdata/sf0.01/notice_item.parquet")
    usual = pairs(history_dedup.repeated(items))
    assert len(usual) > 700 and pairs(history_dedup.repeated(items, coverage=2.0, alone=2.0)) == set()
    loose, strict = pairs(history_dedup.repeated(items, coverage=0.0, alone=0.0)), pairs(history_dedup.repeated(items, coverage=0.6, alone=0.9))
    assert len(usual - loose) >= 3 and len(usual - strict) >= 30
    # all batches at once, and one by one, agree but for records that name no project
    assert len(usual ^ pairs(history_dedup.repeated(items, loads=1))) <= 0.005 * len(usual)


def test_truth(spark):
    rows = [
        item(1, issuer="乙县丙局", budget_amount="约5万元", deadline_at="2024-02-01 10:00:00"), item(2, issuer="甲市乙县丙局", budget_amount="50,000.00", deadline_at="2024-02-03"),
        item(3, issuer="-", budget_amount="面议", deadline_at="2024-02-01T02:00:00Z"), item(4, issuer="甲市乙县​丙局", budget_amount="5万元", deadline_at="TBD"), item(5),
    ]
    members = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "g long, item_id long")
    zones = spark.createDataFrame([("s", "Asia/Shanghai", "YMD")], "source_code string, tz_name string, date_order string")
    best, reliability = truth.discover(members, spark.createDataFrame(rows, ITEM), zones)
    assert {(r.g, r.field_name, r.item_id) for r in best.collect()} == {(1, "budget_amount", 2), (1, "deadline_at", 1), (1, "issuer", 2)}
    assert {r.source for r in reliability.collect()} == {"s", "text of s"} and reliability.first().moved <= truth.TOLERANCE
    assert truth.discover(members.limit(0), spark.createDataFrame(rows, ITEM), zones)[0].count() == 0


def test_votes_decide_names(spark):
    """Two sources that type short forms outvote one full name once; what the other groups teach of them turns it."""
    rows, members, n = [], [], 0

    def add(g, source, name, text):
        nonlocal n
        n += 1
        rows.append(item(n, source_code=source, issuer=name, content_text=text))
        members.append((g, n))

    for g in range(1, 9):  # the sources a and b shorten, the texts and c don't
        full = f"甲市乙县第{g}学校"
        text = f"{full}的水泵采购项目，编号为1。\n乙县第{g}学校水泵"
        for source, name in (("c", full), ("a", full[2:]), ("b", full[2:]), ("c", full)):
            add(g, source, name, text)
    hard = "甲市乙县第9学校"
    add(9, "a", hard[2:], None)
    add(9, "b", hard[2:], None)
    add(9, "c", hard, hard + "的水泵")
    add(10, "c", "甲市乙县第1学校", None)
    add(10, "a", "乙县第1学校", None)
    items = spark.createDataFrame(rows, ITEM)
    groups = spark.createDataFrame(members, "g long, item_id long")
    zones = spark.createDataFrame([("s", "UTC", "YMD")], "source_code string, tz_name string, date_order string")
    found = lambda **kw: {r.g: r.item_id for r in truth.discover(groups, items, zones, **kw)[0].collect() if r.field_name == "issuer"}
    settled = found()
    assert settled == {g: 4 * g - 3 for g in range(1, 9)} | {9: 35, 10: 36}
    assert found(rounds=0).get(9) is None and found(rounds=0, start=0.0) != settled
    with pytest.warns(UserWarning, match="still move"):
        found(rounds=1, tolerance=-1.0)


def test_votes_decide_rows_of_the_tables(spark):
    items, zones = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("notice_item", "source_zone"))
    members = truth.members_of(history_dedup.repeated(items, loads=1)).cache()
    usual, without = (truth.discover(members, items, zones, **kw)[0].select("g", "field_name", "item_id") for kw in ({}, {"rounds": 0, "start": 0.0}))
    assert usual.exceptAll(without).count() >= 20


@pytest.mark.parametrize(("typed", "value", "exact"), [("376.48万元", 3764800, True), ("￥8,100.50", 8100.5, True), ("EUR 1,234,000", 1234000, True), ("1.234.000,00 EUR", 1234000, True), ("about 90k", 90000, False), ("约9万元", 90000, False), ("人民币7元整", 7, True), ("0.00", None, True), ("-", None, True), (None, None, None)])
def test_amounts(spark, typed, value, exact):
    v, e = truth.amount("a")
    r = spark.createDataFrame([(typed,)], "a string").select(v.alias("v"), e.alias("e")).first()
    assert (None if r.v is None else float(r.v)) == value and (value is None or r.e == exact)


def test_names(spark):
    same = [
        ["甲川市乙河县第九中学", "乙河县第9中学", "采购人：甲川市乙河县第九中学", "乙河九中", "第九中学（乙河县）", "甲川市 乙河县 第九中学"],
        ["甲川市乙河县第十九中学"], ["甲川市乙河县第九小学", "乙河县第九晓学"],
        ["甲川市乙河县瀚锐环境科技有限公司", "乙河县瀚锐环科", "乙河县瀚锐环境科技有限责任公司", "乙河县瀚锐环境科技有公限司", "乙河县瀚锐"], ["甲川市乙河县瀚岳环境科技有限公司"],
        ["甲川市丁山区数据资源管理局", "丁山区数据局", "丁山区数据据资源管理局"], ["甲川市乙河县数据资源管理局"],
        ["Bafobafo School District", "School District, Bafobafo", "BAFOBAFO SCHOOL DISTRICT", "Mun. of Bafobafo, Sch. District", "School Distrcit, Bafobafo"], ["Lodibana School District"],
    ]
    # what a kind is, and what an error, is told by how often it is written
    more = [[f"甲川市{p}县{k}" for k in (kind,)] for p in ("戊山", "己水", "庚林", "辛石", "壬岭") for kind in ("第九中学", "第九小学", "数据资源管理局", "人民医院")]
    same += more + [[f"{p} School District"] for p in ("Gatobaso", "Hujibado", "Kifabamo", "Dulabaho")]
    rows, ids = [], {}
    for body, spellings in enumerate(same):
        for s in spellings:
            ids[len(rows)] = body
            rows.append((len(rows), s, "Bafobafo" if "afobafo" in s.lower() else "Lodibana" if "Lodi" in s else None, "x"))
    rows += [(900, None, None, "x"), (901, "  ", None, "x"), (0, rows[0][1], None, "x")]
    got = {(r.name_id_a, r.name_id_b) for r in names.linked_pairs(spark.createDataFrame(rows, "name_id long, issuer string, region string, kind string")).collect()}
    want = {(a, b) for a in ids for b in ids if a < b and ids[a] == ids[b]}
    assert got == want


def test_full_cells_are_cut_into_blocks(spark):
    """Blocks of any size give the same, and all pairs that comparing everything with everything gives."""
    import random

    rnd = random.Random(3)
    base = ["".join(rnd.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(rnd.randrange(4, 9))) for _ in range(60)]
    kinds = {k: 20 for k in base}
    for k in base[:40]:
        i = rnd.randrange(1, len(k))
        kinds.setdefault(k[:i] + "子" + k[i:], 1)
    df = spark.createDataFrame(list(kinds.items()), "kind string, n long")
    want = {(a, b) for a in kinds for b in kinds if kinds[a] < 0.5 * kinds[b] and names.levenshtein([a], [b])[0, 0] == 1}
    for block in (7, 1000):
        got = {(r.kind, r.right) for r in names.corrected(df, block=block).collect()}
        assert {a for a, _ in got} == {a for a, _ in want} and got <= want


def test_short_forms_are_learned(spark):
    """A short form stands where its full form does; a likeness elsewhere isn't one."""
    rows = [(p, "文化和旅游局", 3) for p in "abcdef"] + [(p, "文旅局", 1) for p in "abc"] + [("x", "文局", 1), ("a", "roads department", 1), ("a", "department of roads", 2)]
    got = {(r.kind, r.full) for r in names.shortened(spark.createDataFrame(rows, "place string, kind string, n long")).collect()}
    assert got == {("文旅局", "文化和旅游局"), ("roads department", "department of roads")}
    assert names.shortens("energy coop", "energy cooperative") and not names.shortens("局文旅", "文化和旅游局") and not names.shortens("甲", "乙丙")


def test_leaks_and_clauses(spark):
    passage = "梨湾甲得三分乙得七九零九分密封条补记五十六分后谁先入围若菊阁的基准价高出八十六应改判"
    clause = "评审委员会按照客观公正审慎的原则根据采购文件规定的评审程序评审方法和评审标准进行独立评审"
    english = "suppose thirty walnut surcharges weigh more against one sable quota which scribe relabels first"
    items = spark.createDataFrame([(1, clause + passage, "zh", "c"), (2, english, "en", "c"), (3, None, "zh", "c"), (4, "短", "zh", "c"), (5, "春天河边许多柳树发芽孩子们放风筝老人下棋" + clause, "zh", "c")], "item_id long, text string, lang string, words string")
    swap = passage[:12] + "错" + passage[13:]
    docs = [(1, "前文。" + "，".join(swap) + "后文"), (2, passage[:20]), (3, clause), (4, clause), (5, clause), (6, clause), (7, "News: " + english.upper().replace(" ", " - ")), (8, english[:40]), (9, None), (10, ""), (11, "甲" * 200_000 + passage)]
    docs += [(i, "别的" * 20) for i in range(12, 40)] + [(1, docs[0][1])]
    got = leaks.leaks(spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string"), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (7, 2), (11, 1)}
    small = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, block_seeds=50)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == {(1, 1), (7, 2), (11, 1)}


def test_mixture(spark):
    docs = [(i, "word " * (5 + i % 40), "big", "p") for i in range(3000)] + [(5000 + i, "word " * 20, "small", "p") for i in range(60)] + [(9000, None, "big", "p"), (9001, "x", None, "p")]
    targets = spark.createDataFrame([("a", "big", 0.8, 3), ("a", "small", 0.15, 3), ("a", "none", 0.05, 3), ("b", "small", 1.0, 2)], "plan_name string, source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, part string"), targets)
    assert drawn.filter((F.col("plan_name") == "a") & (F.col("copies") > 3) | (F.col("plan_name") == "b") & (F.col("copies") > 2)).count() == 0
    share = {(r.plan_name, r.source): r.share for r in report.collect()}
    assert share["a", "big"] == pytest.approx(0.8 / 0.95, abs=0.01) and share["a", "small"] == pytest.approx(0.15 / 0.95, abs=0.01) and share["a", "none"] == 0 and share["b", "small"] == 1
    assert drawn.filter("plan_name = 'b'").agg(F.sum("copies")).first()[0] == 120
    # each document is used the expected number of times, rounded down or up
    assert drawn.groupBy("plan_name", "source").agg((F.max("copies") - F.min("copies")).alias("d")).filter("d > 1").count() == 0


def test_mixture_against_a_plain_walk(spark):
    """The same copies as walking along each source's documents by size, part and id."""
    import math

    docs = [(i, "word " * (1 + (i * 37) % 91), "big" if i % 5 else "small") for i in range(700)]
    targets = spark.createDataFrame([("a", "big", 0.7, 2), ("a", "small", 0.3, 4)], "plan_name string, source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    drawn, report = mixing.mix(df, targets)
    got = {r.doc_id: r.copies for r in drawn.collect()}
    placed = df.select("doc_id", "source", mixing.token_counter()("text").alias("n"), F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(mixing.PARTS)).alias("part")).collect()
    offsets = {r.source: r.o for r in targets.select("source", (F.pmod(F.xxhash64("plan_name", "source", F.lit(42)), F.lit(1 << 30)) / float(1 << 30)).alias("o")).collect()}
    rows = {r.source: r for r in report.collect()}
    size = min(r.max_repeats * r.source_tokens / r.target_share for r in rows.values())
    want = {}
    for source, r in rows.items():
        rate = min(r.target_share * size / r.source_tokens, r.max_repeats)
        for place, d in enumerate(sorted((x for x in placed if x.source == source), key=lambda x: (x.n, x.part, x.doc_id))):
            if n := math.floor(rate * (place + 1) + offsets[source]) - math.floor(rate * place + offsets[source]):
                want[d.doc_id] = n
    assert got == want


def test_edges_of_the_rest(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "中标查询 招标代理 " * 40, "c"), (3, "中标查询 招标代理 " * 40, "c")], "doc_id long, text string, is_case string")
    assert [r.doc_id for r in stuffed_pages.found(docs).collect()] == [3]
    assert stuffed_pages.found(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "云​岫省", None, "x"), (1, "云​岫省", None, "x"), (2, None, "​", "x"), (3, "云岫省", "（α型）", "x")], "item_id long, title string, issuer string, value string")
    assert [tuple(r) for r in lookalikes.found(rows, ["title", "issuer"]).collect()] == [(1, "title")]
    raw = spark.createDataFrame([(1, None, None, None, None), (2, "{}", "{}", "json", None), (None, "x", None, "html", "text/html")], "raw_id long, raw_body string, extra_meta string, document_type string, mime_type string")
    texts = spark.createDataFrame([(7, "丙局2024年水泵采购项目公告\n" + BODY.format(code="ZC2024-A00000001", n=3) + "\n版权所有 某网", 1)], "item_id long, content_text string, value int")
    assert [(r.field_name, r.row_id, r.line_no) for r in boilerplate.found(raw, texts).orderBy("line_no").collect()] == [("content_text", 7, k) for k in range(1, 6)]
