"""Short pages of product tags, and lists that are none."""

import random

from noticeforge.llm import stuffed_pages

GOODS = "竹制绿篱 校服面料 木制书架 冷链疫苗柜 污泥脱水机 新能源公交车 GPS定位终端 防火门 消防水带 超声诊断仪 无人机航测服务 水质在线监测仪 数字化CT机 智慧黑板 不锈钢水箱 档案密集架 课桌椅".split()


def test_short_tag_page():
    page = "竹制绿篱 Z-78 hot sale 校服面料 K-24 包邮 木制书架 A-72 hot sale 冷链疫苗柜 B-25 厂家直销 竹制绿篱 X-68 厂家直销 污泥脱水机 A-80 包邮 新能源公交车 K-55 现货 GPS定位终端 A-28 特价 防火门 A-11 现货 防火门 A-45 现货 消防水带 A-84 特价 超声诊断仪 K-53 hot sale 无人机航测服务 X-57 包邮 水质在线监测仪 K-52 现货 数字化CT机 Z-13 厂家直销 新能源公交车 B-34 厂家直销 新能源公交车 X-97 现货 智慧黑板 B-30 hot sale 不锈钢水箱 A-22 现货 档案密集架 Z-95 特价 消防水带 K-44 现货 污泥脱水机 A-35 厂家直销 污泥脱水机 Z-26 包邮 课桌椅 K-32 hot sale 不锈钢水箱 X-49 特价"
    x = stuffed_pages.scores([page]).iloc[0]
    assert 0.3 < x.new < 0.5 and x.clauses == 0 and x.is_case
    assert list(stuffed_pages.scores([page], screen=False).is_case) == [True]


def test_goods_list_between_sentences():
    rnd = random.Random(4)
    goods = "".join(f"{i + 1}、{rnd.choice(GOODS)}，规格{rnd.choice('AKXZB')}-{rnd.randint(100, 999)}，数量{rnd.randint(3, 80)}台，单价上限{rnd.randint(100, 9999)}元" for i in range(12))
    said = "监管部门每季度抽查不低于13%的合同，重点核对审计服务的验收记录。"
    assert list(stuffed_pages.scores([said + goods, said + said + goods + said]).is_case) == [False, False]
