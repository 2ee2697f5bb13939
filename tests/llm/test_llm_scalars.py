"""Functions of the text problems against brute force and cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeforge.llm import boilerplate, history_dedup, leaks, names, notice_text, stuffed_pages
from noticeforge.llm.folding import codes_of, folded
from noticeforge.llm.lookalikes import canonical


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("２０２４年（Ａ包）", "2024年（A包）"),
        ("云​岫省﻿", "云岫省"),
        ("第⼀⼩学", "第一小学"),
        ("Péfobatu", "Péfobatu"),
        ("Сеdіbаfο", "Cedibafo"),
        ("Fohabalo – LED", "Fohabalo - LED"),
        ("a b　c", "a b c"),
        ("（Α包）", "（A包）"),
        ("\u1112\u1161\u11ab국", "한국"),
        ("\u09c7\u09be", "\u09cb"),
        ("ᎠᎬᏙ 2024", "DEV 2024"),
    ],
)
def test_disguises(value, want):
    assert canonical(value) == want


@pytest.mark.parametrize("value", [None, "", "（α型）、γ射线：“Ⅱ区”№3㎡", "Rüfobamo Ñandú", "【云岫省】·℃…—！", "x" * 100_000])
def test_ordinary_values_stay(value):
    assert canonical(value) == value


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_canonical_is_stable(s):
    assert canonical(canonical(s)) == canonical(s)


@given(st.text(alphabet="abc中文。 \n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_automaton_and_windows_cover_what_occurs_twice(s):
    m = stuffed_pages.MIN_REPEAT
    want = np.zeros(len(s), bool)
    for i in range(len(s) - m + 1):
        if any(s[j : j + m] == s[i : i + m] for j in range(len(s) - m + 1) if j != i):
            want[i : i + m] = True
    assert (stuffed_pages.automaton_covered(s) == want).all()
    assert (stuffed_pages.windows_covered(*codes_of([s])) == want).all()


def test_pages():
    prose = "采购人在三个工作日内作出答复，逾期视为放弃。" + "".join(f"第{i}项设备由{c}公司供应，单价不超过{i * 37}元。" for i, c in enumerate("甲乙丙丁"))
    goods = "本次采购按下列清单执行，供应商应当逐项报价并承诺供货期限。\n评审委员会按规定程序独立评审。\n" + "\n".join(f"{i}、设备{c}，规格K-{i * 91}，数量{i * 7}台" for i, c in enumerate("甲乙丙丁戊", 1))
    stuffed = "中标查询 TOP10 招标代理 中标查询 招标代理 TOP10 中标查询 " * 9
    links = "\n".join(f'<a href="http://a{i}.example/k={i * 7}">招标代理</a>' for i in range(20))
    got = stuffed_pages.scores([prose, goods, stuffed, links, None, "", "ab", prose + stuffed + links])
    assert got.is_case.tolist() == [False, False, True, True, False, False, False, True]
    assert stuffed_pages.scores([prose, goods, stuffed, links], screen=False).equals(stuffed_pages.scores([prose, goods, stuffed, links], screen=True))


def test_chunks_survive_edits():
    rnd = random.Random(1)
    text = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(3000))
    other = text[:500] + "改" + text[501:1200] + text[1210:]
    (a, wa), (b, _), (c, _) = history_dedup.chunks_of([text, other, None])
    assert len(c) == 0 and wa.sum() >= 0.99 * 3 * 3000
    assert wa[np.isin(a, b)].sum() / wa.sum() > 0.95
    # another text shares only what chunks of a few characters share by chance
    assert wa[np.isin(a, history_dedup.chunks_of([text[::-1]])[0][0])].sum() < 0.02 * wa.sum()
    # marks, width and case don't count; a batch gives what single texts give
    assert (history_dedup.chunks_of(["Ａb，c" * 40])[0][0] == history_dedup.chunks_of(["ab c" * 40])[0][0]).all()
    assert all((x == y).all() for x, y in zip(history_dedup.chunks_of([text, "", other])[2], history_dedup.chunks_of([other])[0]))


def test_folding():
    codes, lengths = folded(["Ａé㎡，中", None, "", "x​y"])
    assert lengths.tolist() == [5, 0, 0, 2] and "".join(map(chr, codes)) == "aem2中xy"


def test_notice_signature():
    t = notice_text.plain_title
    assert notice_text.lot_of(t("某工程（一标段）公告")) != notice_text.lot_of(t("某工程-01包公告"))
    assert notice_text.lot_of(t("某工程（А包）公告")) == notice_text.lot_of(t("某工程(A包)公告")) == "包A"
    assert notice_text.lot_of("X - Y, Lot B (second call): call for bids") == "lB"
    assert (notice_text.call_of("某项目(第二次)"), notice_text.call_of("X (second call)"), notice_text.call_of("某")) == (2, 2, 1)
    assert [notice_text.kind_of(k, "某项目成交公告", None) for k in (None, "other", "CHANGE")] == ["result", "result", "change"]


def test_best_run_against_all_runs():
    rnd = np.random.default_rng(3)
    for _ in range(100):
        e = rnd.random(25) < 0.7
        first, end = (int(x[0]) for x in leaks.best_runs(e[None, :]))
        gain = np.where(e, 1.0, -leaks.EXCHANGE)
        best = max([0.0, *(gain[i:j].sum() for i in range(25) for j in range(i + 1, 26))])
        assert gain[first:end].sum() == pytest.approx(best)


def test_levenshtein_and_edits():
    rnd = random.Random(2)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(40)]
    assert names.levenshtein(words, words).tolist() == [[plain(a, b) for b in words] for a in words]
    assert names.one_edit("有限公司", "有公限司") and names.one_edit("小学", "小小学") and not names.one_edit("甲乙", "丙丁") and not names.one_edit("甲", "甲")
    assert all(names.levenshtein([a], [b])[0, 0] <= names.RADIUS for a in words for b in words if names.one_edit(a, b))


def test_line_blocks():
    page = "\n".join([
        "<html><head><title>x</title>", "<style>p{}</style></head>", '<div class="nav">首页 | 政策法规 | 联系我们</div>', "<p>当前位置：首页</p>",
        "<h1>甲县乙局2024年水泵采购项目公告</h1>", "<p>甲县乙局的水泵采购项目，编号为ZC2024-A00000001，现采用询价方式选定承接单位。</p>", '<div class="side">丙县丁局2024年课桌采购项目公告</div>',
        "<tr><td>二、预算金额：</td><td>人民币100元，报价超出者按无效处理。</td></tr>", "<p>联系人：某工，电话：0900-1</p>", '<a href="/f.pdf">附件1：报名表.pdf</a>', "<p>版权所有 某网 未经授权不得转载</p>", "</html>",
    ])
    assert boilerplate.notice_lines(page, True) == [5, 6, 8, 9, 10]
    assert boilerplate.notice_lines(page, True, is_list=True) == []
    listing = "\n".join(f"<li>甲县{i}局2024年水泵采购项目公告</li>" for i in range(9))
    assert boilerplate.notice_lines(listing, True) == boilerplate.notice_lines('{"a": 1}', True) == boilerplate.notice_lines(None, False) == boilerplate.notice_lines(" \n ", False) == []
