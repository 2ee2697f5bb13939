"""What a notice says of itself: project, lot, call and kind. Used as the exact check behind candidates."""

from __future__ import annotations

import re

from noticeforge.llm.lookalikes import canonical

# Words and patterns of the platforms' titles and texts.
CODE = r"[A-Z]{2}\s*\d{4}\s*-\s*[A-Z]\d{8}"
_CODE = re.compile(CODE)
_CHANGE = re.compile(r"更正|变更|澄清|corrigendum|notice of change", re.I)
_RESULT = re.compile(r"中标|成交|结果|候选|award", re.I)
_CHANGE_TEXT = re.compile(r"现作如下更正|of the documents is replaced", re.I)
_RESULT_TEXT = re.compile(r"评审工作已经结束|结果如下|was awarded", re.I)
_KINDS = ("announcement", "change", "result")
_CALL = re.compile(r"第([二三四五六七八九十\d]+)次|\b(second|third|fourth) call", re.I)
_CALLS = {"second": 2, "third": 3, "fourth": 4}
_LOT = re.compile(r"[(（]\s*第?([A-Za-z]|[一二三四五六七八九十\d]+)\s*(标段|标包|包)\s*[)）]|-\s*0*(\d+)\s*(包)|\b(Lot)\s+([A-Za-z]|\d+)\b", re.I)
_HAN = {c: i for i, c in enumerate("零一二三四五六七八九")}
_DECORATION = re.compile(r"^\s*(?:\[转载\]|【[^】]*】|转载[::])+|\((?:reposted)\)\s*$", re.I)
_SUFFIX = re.compile(r"(?:招标|采购|中标|成交|变更|更正|澄清|候选人|结果)*(?:公告|公示)$|:\s*[a-z ]+$", re.I)
_BLANK = re.compile(r"\s+")


def han_number(text: str) -> int | None:
    """一 to 九十九, or digits."""
    if text.isdigit():
        return int(text)
    try:
        if "十" in text:
            tens, _, ones = text.partition("十")
            return (_HAN[tens] if tens else 1) * 10 + (_HAN[ones] if ones else 0)
        return int("".join(str(_HAN[c]) for c in text))
    except KeyError:
        return None


def code_of(*texts: str | None) -> str | None:
    """The first project code in the texts."""
    for text in texts:
        if text and (m := _CODE.search(text)):
            return _BLANK.sub("", m[0])
    return None


def kind_of(notice_type: str | None, title: str, text: str | None) -> str:
    """announcement, change or result: as the type says, else the title, else the text."""
    said = (notice_type or "").strip().lower()
    if said in _KINDS:
        return said
    for change, result, of in ((_CHANGE, _RESULT, title), (_CHANGE_TEXT, _RESULT_TEXT, text or "")):
        if change.search(of):
            return "change"
        if result.search(of):
            return "result"
    return "announcement"


def call_of(title: str) -> int:
    if m := _CALL.search(title):
        return _CALLS.get((m[2] or "").lower()) or han_number(m[1]) or 2
    return 1


def lot_of(title: str) -> str:
    """The lot in one notation; '' without one. A section (标段) and a package (包) of one number are different."""
    if m := _LOT.search(title):
        said, unit = m[1] or m[3] or m[6], (m[2] or m[4] or m[5]).lower()
        number = han_number(said)
        return f"{unit[0]}{said.upper() if number is None else number}"
    return ""


def core_of(title: str) -> str:
    """A title without decoration, kind and spacing."""
    return _BLANK.sub("", _SUFFIX.sub("", _DECORATION.sub("", title).strip())).lower()


def plain_title(title: str | None) -> str:
    """A title in canonical characters, brackets of one width."""
    return (canonical(title) or "").replace("（", "(").replace("）", ")").replace("：", ":").strip()
