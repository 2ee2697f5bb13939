"""Leaks of which a document holds several runs, and what makes a clause."""

import pytest

from noticeforge.llm import leaks

PASSAGE = "梨湾甲得三分乙得七九零九分密封条补记五十六分后谁先入围若菊阁的基准价高出八十六应改判"
CLAUSE = "评审委员会按照客观公正审慎的原则根据采购文件规定的评审程序评审方法和评审标准进行独立评审"
OTHER = "春天河边许多柳树发芽孩子们放风筝老人下棋远处传来钟声小船慢慢划过桥洞水面闪着金光鸭群游来游去"


@pytest.fixture
def found(spark):
    def run(documents, text, others=()):
        items = spark.createDataFrame([(1, text, "zh"), *((i, t, "zh") for i, t in enumerate(others, 2))], "item_id long, text string, lang string")
        rows = [(r.doc_id, r.length) for r in leaks.leaks(spark.createDataFrame(documents, "doc_id long, text string"), items).filter("item_id = 1").collect()]
        assert len(rows) == len({d for d, _ in rows})
        return dict(rows)

    return run


def test_a_clause_hides_no_shorter_leak(found):
    docs = [(1, "前文。" + CLAUSE + "。" + OTHER * 2 + PASSAGE[:33] + "。后文")] + [(i, f"第{i}号文件。{CLAUSE}。{OTHER[i:]}") for i in range(2, 32)]
    assert found(docs, CLAUSE + PASSAGE) == {1: 33}
    # few documents tell no clause; another item that quotes it does
    assert set(found(docs[:5], CLAUSE + PASSAGE)) == {1, 2, 3, 4, 5}
    assert found(docs[:5], CLAUSE + PASSAGE, [OTHER[::-1] + CLAUSE]) == {1: 33}


def test_a_passage_that_leaks_often_stays(found):
    """Into five of 55 documents with the same bounds; and a second item that is a copy makes no clause of it."""
    docs = [(i, f"第{i}号文件。{PASSAGE[:35]}。{OTHER[i:]}") for i in range(1, 6)] + [(i, f"别的文件{i}号") for i in range(6, 56)]
    assert found(docs, PASSAGE + OTHER[::-1]) == {i: 35 for i in range(1, 6)}
    assert set(found(docs, PASSAGE, [PASSAGE])) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize(("exchanges", "least"), [(0, 1.0), (1, 0.99), (2, 0.97), (3, 0.9), (4, 0.85)])
def test_recall_by_exchanges(exchanges, least):
    """Of 34 characters copied with some exchanged, alone in a text."""
    import random

    import numpy as np

    rnd, n, hits = random.Random(7), 300, 0
    text = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(400))
    block = leaks._Block([(1, text)], False)
    for _ in range(n):
        at = rnd.randrange(360)
        copy = list(text[at : at + 34])
        for k in rnd.sample(range(34), exchanges):
            copy[k] = chr(0x9000 + rnd.randrange(500))
        codes, sizes = leaks.folded(["前文如下" + "".join(copy) + "后文如上"])
        hits += bool(block.runs(codes, np.cumsum(sizes) - sizes))
    assert hits >= least * n, hits


def test_runs_of_one_diagonal(found):
    docs = [(1, CLAUSE + OTHER[:40] + PASSAGE[:33] + "止")] + [(i, f"第{i}号文件。{CLAUSE}。{OTHER[i:]}") for i in range(2, 32)]
    assert found(docs, CLAUSE + "某" * 40 + PASSAGE[:33]) == {1: 33}


def test_copies_and_whole_items_make_no_clause(found):
    """A leak copied often, and an item leaked whole into several texts, stay; the clause doesn't come out."""
    partly = "前文。" + PASSAGE[:35] + "。" + OTHER
    docs = [(i, partly) for i in range(1, 9)] + [(i, f"第{i}号文件。{CLAUSE}。{OTHER[i:]}") for i in range(11, 41)]
    assert found(docs, CLAUSE + PASSAGE) == {i: 35 for i in range(1, 9)}
    docs = [(i, f"第{i}号文件。{PASSAGE}。{OTHER[i:]}") for i in range(1, 9)]
    assert found(docs, PASSAGE) == {i: len(PASSAGE) for i in range(1, 9)}


def test_parts_with_other_bounds_make_no_clause(found):
    docs = [(i, f"第{i}号文件。{PASSAGE[i:]}。{OTHER[i:]}") for i in range(1, 14, 4)] + [(20, "另文。" + PASSAGE[:31] + OTHER)]
    assert set(found(docs, PASSAGE + OTHER[::-1])) == {1, 5, 9, 20}


def test_clause_positions():
    assert leaks.clause_positions([(0, 44, 2), (1, 44, 2), (0, 87, 9)], 3) == set(range(87))
    assert leaks.clause_positions([(0, 44, 2), (1, 46, 2), (44, 87, 3)], 3) == set(range(1, 44))
    assert leaks.clause_positions([(0, 31, 2), (9, 40, 2)], 3) == set()
