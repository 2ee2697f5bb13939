"""Furniture learned from where lines recur and stand, and blocks that decide what is left."""

import pytest
from pyspark.sql import functions as F

from noticeforge.llm import boilerplate

BODY = [
    "{p}县{i}局2024年水泵采购项目公告", "{p}县{i}局的水泵采购项目，编号为ZC2024-A{i:08}，已具备实施条件，现采用询价方式选定承接单位。",
    "一、项目概况：用于更换到期设备，交付地点为{p}县院内，共计{i}台。", "二、资金已落实，预算{i}000.00元，报价超出者按无效处理，其余按文件执行。",
    "三、供应商资格：须为中小企业；拟派负责人须持证上岗；不接受联合体。", "联系人：{p}工，电话：0900-{i:07}", "附件1：报名表{i}.pdf",
]
#: Furniture in no list: before, within and after the notice, some of it with marks of clauses and a telephone.
BEFORE, WITHIN, AFTER = "尊敬的用户，欢迎再次光临采招小站", "温馨提示，点右上角可放大字体", ["热线 0755-1234567（全天，节假日除外）", "第{i}位来客，祝您工作顺利"]


def page(i: int) -> str:
    body = [x.format(i=i, p="甲乙丙丁戊己庚辛"[i % 8]) for x in BODY]
    return "\n".join([BEFORE, *body[:3], *([WITHIN] if i % 4 == 0 else []), *body[3:], *(["" , WITHIN] if i % 4 else []), *(a.format(i=i) for a in AFTER)])


def pages(spark, n=60):
    return spark.createDataFrame([(i, "s", page(i)) for i in range(1, n)] + [(900, None, page(900)), (901, "s", None), (902, "s", "x" * 200_000)], "item_id long, source_code string, content_text string")


def own(found, i):
    lines = page(i).split("\n")
    return [lines[r.line_no - 1] for r in sorted(found, key=lambda r: r.line_no) if r.row_id == i]


def test_furniture_is_learned(spark):
    df = pages(spark)
    found = boilerplate.lines_of(df, "content_text", "item_id", False).collect()
    for i in range(1, 60):
        assert own(found, i) == [x.format(i=i, p="甲乙丙丁戊己庚辛"[i % 8]) for x in BODY]
    # the same, where the furniture is joined by site and not sent
    try:
        boilerplate.MOST_TEMPLATES = 0
        joined = boilerplate.lines_of(df, "content_text", "item_id", False).collect()
    finally:
        boilerplate.MOST_TEMPLATES = 1_000_000
    assert sorted(map(tuple, joined)) == sorted(map(tuple, found))
    assert boilerplate.lines_of(df.limit(0), "content_text", "item_id", False).count() == 0


def test_without_learning_furniture_stays():
    lines = boilerplate.notice_lines(page(4), False)
    assert len(lines) > len(BODY)


def test_the_block_decides():
    """Sentences far from the notice, on one page only, so that nothing can be learned of them."""
    body = [x.format(i=7, p="甲") for x in BODY]
    far = [f"{x}来稿须知，来稿请注明出处。" for x in "子丑寅"]
    gap = [f"栏目{k}" for k in range(5)]
    text = "\n".join([*far, *gap, *body, *gap, *far])
    first = len(far) + len(gap) + 1
    assert boilerplate.notice_lines(text, False) == list(range(first, first + len(body)))
    whole = boilerplate.notice_lines(text, False, block=lambda lengths: (0, len(lengths)))
    assert set(whole) - set(range(first, first + len(body)))


@pytest.mark.parametrize("scale", ["0.01"])
def test_the_block_decides_rows_of_the_tables(spark, scale):
    """With the longest line in place of the block, lines of notices are lost."""
    df = spark.read.parquet(f"/root/testdata/sf{scale}/notice_item.parquet").filter(F.col("content_text").isNotNull())
    texts = [r.content_text for r in df.select("content_text").orderBy("item_id").collect()]
    usual = [boilerplate.notice_lines(t, False) for t in texts]
    longest = [boilerplate.notice_lines(t, False, block=lambda x: (int(x.argmax()), int(x.argmax()) + 1)) for t in texts]
    lost = sum(len(set(a) - set(b)) for a, b in zip(usual, longest))
    assert lost >= 100
