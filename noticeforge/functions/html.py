"""Fields, list items and paging of HTML pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from decimal import Decimal
from html.parser import HTMLParser
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.functions.text import absolute_url, normal_url, plain_text

# Suffixes of files that are attachments, words of links to them, and labels of fields.
SUFFIXES = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z")
_WORDS = ("附件", "下载")
_DATE = r"(\d{4})年(\d{1,2})月(\d{1,2})日(\d{1,2})[点时](\d{1,2})分?|(\d{4})-(\d{1,2})-(\d{1,2})\s*(\d{1,2}):(\d{2})"
_DEADLINE = re.compile(rf"截止时间[:：\s]*(?:{_DATE})")
_BUDGET = re.compile(r"预算金额[:：]\s*(?:人民币)?\s*(\d[\d,.]*)\s*(万元|元)?")
_BUYER = re.compile(r"采购人(?:信息)?[\s\S]{0,120}?名称[:：]\s*([^\n\r]+)")
_AREA = re.compile(r"【([^】]+)】")
_LIST_DATE = re.compile(r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})")
_TARGET = re.compile(r"pagination\(([^)]+)\)", re.I)
#: Words of a title that name its kind; the first kind that has one counts. One set a family of sites.
KIND_WORDS = {
    "pages": {"change": "更正|变更|澄清|延期", "result": "中标|成交|结果|中选"},
    "lists": {"change": "更正|变更|澄清|延期|终止|废标|流标", "result": "中标|成交|结果|合同"},
}
PREVIEW = 2000

FILE = T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])
PAGE = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("title", "summary", "text", "notice_type", "external_id", "project_code", "issuer", "region")),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("attachments", T.ArrayType(FILE)),
    T.StructField("deadline", T.StringType()), T.StructField("budget", T.DecimalType(24, 2)),
])
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "published", "region", "notice_type", "guid")])
PAGING = T.StructType([T.StructField(n, T.IntegerType()) for n in ("current", "last", "next")])

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_ENDS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ("div", "td", "li", "body")}


class Node:
    """An element: children are elements and texts, in their order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """This element and all below, in their order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> list[str]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                todo += reversed(node.children)
        return out

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(self.texts())).strip()

    def above(self, *tags: str) -> Node | None:
        node = self.parent
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:  # an element that its like ends
            like, node = {"td", "th"} if tag in ("td", "th") else {tag}, self.at
            while node is not None and node.tag not in like and node.tag not in _ENDS[tag]:
                node = node.parent
            if node is not None and node.tag in like:
                self.at = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(value: str) -> Node:
    t = _Tree()
    t.feed(value)
    t.close()
    return t.root


def kind_of(title: str | None, family: str = "pages") -> str:
    return next((k for k, words in KIND_WORDS[family].items() if re.search(words, title or "")), "announcement")


def kind_column(title: Column, family: str = "pages") -> Column:
    """kind_of as an expression."""
    words = KIND_WORDS[family]
    return F.when(title.rlike(words["change"]), "change").when(title.rlike(words["result"]), "result").otherwise("announcement")


def guid_of(url: str | None) -> str | None:
    try:
        return (parse_qs(urlsplit(url or "").query).get("guid") or [None])[0] or None
    except ValueError:
        return None


def _stamp(match: re.Match | None) -> str | None:
    if not match:
        return None
    y, m, d, h, mi = [g for g in match.groups() if g is not None][:5]
    made = pd.to_datetime(f"{y}-{int(m):02}-{int(d):02} {int(h):02}:{int(mi):02}", errors="coerce")
    return None if pd.isna(made) else made.strftime("%Y-%m-%d %H:%M")


def _amount(number: str | None, unit: str | None) -> Decimal | None:
    found = re.search(r"\d+(?:\.\d+)?", (number or "").replace(",", ""))
    if not found or len(found[0]) > 18:
        return None
    return (Decimal(found[0]) * (10_000 if "万" in (unit or "") else 1)).quantize(Decimal("0.01"))


def files_of(root: Node, url: str | None) -> list[dict]:
    """Links to files, by suffix or by what the link says; of equal URLs the first."""
    files: dict[str, dict] = {}
    for a in (n for n in root.walk() if n.tag == "a" and n.attrs.get("href", "").strip()):
        target, name = absolute_url(url, a.attrs["href"].strip()), a.text()
        if target and (target.split("?")[0].rsplit(".", 1)[-1].lower() in SUFFIXES or any(w in name for w in _WORDS)):
            files.setdefault(normal_url(target) or target, {"name": name, "url": target})
    return list(files.values())


def page(value: str | None, url: str | None, list_title: str | None = None) -> dict | None:
    """What a page says of its notice. The text is that of #content, or of the page where there is none; cells of
    a row are keys and values in turn, empty ones left out; of equal keys the later counts."""
    if not value:
        return None
    root = tree(value)
    nodes = list(root.walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    content = first(lambda n: n.attrs.get("id") == "content")
    parts = (t.strip() for t in (content or root).texts())
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(t for t in parts if t)).strip()
    fields: dict[str, str] = {}
    for row in (n for n in nodes if n.tag == "tr"):
        cells = [c for n in row.walk() if n.tag in ("td", "th") and n.above("tr") is row and (c := n.text())]
        fields |= dict(zip(cells[::2], cells[1::2]))
    named = first(lambda n: n.attrs.get("id") == "title") or first(lambda n: n.tag == "title" and n.text()) or first(lambda n: n.tag == "h1" and n.text())
    title = (named.text() if named else None) or fields.get("采购项目名称") or list_title or url
    paragraph = first(lambda n: n.tag == "p" and n.text())
    budget = _BUDGET.search(text)
    amount = _amount(budget[1], budget[2]) if budget else None
    buyer, area = _BUYER.search(text), _AREA.search(list_title or "")
    return {
        "title": title, "summary": paragraph.text() if paragraph else None, "text": text, "notice_type": kind_of(title), "external_id": guid_of(url), "project_code": fields.get("项目编号"),
        "issuer": fields.get("采购人名称") or (buyer[1].strip() if buyer else None), "region": fields.get("采购项目地点") or (area[1].strip() if area else None),
        "fields": fields, "attachments": files_of(root, url), "deadline": _stamp(_DEADLINE.search(text)),
        "budget": amount if amount is not None else _amount(fields.get("预算金额"), fields.get("预算金额")),
    }


def list_items(value: str | None, url: str | None, marker: str = "") -> list[dict]:
    """Notices that a list page links to by URLs with the marker. The day is that of the row's date, else of the row,
    else of the title; the region stands in 【】."""
    out = []
    for a in (n for n in tree(value or "").walk() if n.tag == "a" and n.attrs.get("href", "").strip() and marker in n.attrs["href"]):
        title, target = a.text(), absolute_url(url, a.attrs["href"].strip())
        if not title or not target:
            continue
        row = a.above("li", "tr", "div") or a.parent
        item = a.above("li")
        dated = next((n.text() for n in item.walk() if n.tag == "span" and "date" in n.attrs.get("class", "")), "") if item else ""
        around = row.text() if row else ""
        days = (pd.to_datetime("-".join(m.groups()), errors="coerce") for t in (dated, around, title) if (m := _LIST_DATE.search(t)))
        day = next((d.strftime("%Y-%m-%d") for d in days if not pd.isna(d)), None)
        area = next((m[1].strip() for t in (title, around) if (m := _AREA.search(t)) and m[1].strip()), None)
        out.append({"url": target, "title": title, "published": day, "region": area, "notice_type": kind_of(title), "guid": guid_of(target)})
    return out


def page_target(said: str | None) -> int | None:
    """The page that pagination(a+b-c) names; null if it is none or not positive."""
    found = _TARGET.search(said or "")
    text = re.sub(r"\s+", "", found[1]) if found else ""
    if not re.fullmatch(r"\d+(?:[+-]\d+)*", text):
        return None
    total = sum(int(x) for x in re.findall(r"[+-]?\d+", text))
    return total if total > 0 else None


def paging(value: str | None) -> dict:
    """The page shown, the last one the page names, and the next one, null if there is none."""
    nodes = list(tree(value or "").walk())
    number = lambda t: int(t) if t and t.strip().isdigit() else None
    inputs = [((n.attrs.get("name") or "").lower(), (n.attrs.get("id") or "").lower(), n.attrs.get("value")) for n in nodes if n.tag == "input"]
    current = next((number(v) or 1 for name, i, v in inputs if {name, i} & {"currentpage", "pageno"}), 1)
    bars = [n for n in nodes if "gcxxfy" in n.attrs.get("class", "").split()]
    links = [n for bar in bars for n in bar.walk() if n.tag in ("a", "span")]
    named = [int(t) for n in links if (t := n.text()).isdigit()] + [k for name, i, v in inputs if any(w in x for w in ("totalpage", "pagecount") for x in (name, i)) and (k := number(v)) is not None]
    following = None
    for a in (n for n in links if n.tag == "a" and "下一页" in n.text()):
        href, click = a.attrs.get("href", "").strip().lower(), a.attrs.get("onclick", "").strip().lower()
        idle = href in ("", "#", "javascript:void(0)", "javascript:;") and not click
        if "disabled" not in a.attrs.get("class", "").lower() and not idle:
            target = page_target(click) or page_target(href)
            following = target if target and target > current else current + 1
        break
    return {"current": current, "last": max(named, default=current), "next": following}


@F.pandas_udf(PAGE)
def page_udf(body: pd.Series, url: pd.Series) -> pd.DataFrame:
    rows = [page(b, u) or {} for b, u in zip(body, url)]
    return pd.DataFrame({f: [r.get(f) for r in rows] for f in PAGE.names})


def list_items_udf(marker: str = ""):
    @F.pandas_udf(T.ArrayType(ITEM))
    def read(body: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([list_items(b, u, marker) for b, u in zip(body, url)], dtype=object)

    return read


@F.pandas_udf(PAGING)
def paging_udf(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([paging(b) for b in body], columns=PAGING.names).astype("Int64")


def rendered(primary: Column, fallback: Column, least: int = 120) -> Column:
    """The primary HTML if it has at least so many characters without the blanks around it, else the fallback."""
    return F.when(F.length(F.trim(F.coalesce(primary, F.lit("")))) >= least, primary).otherwise(F.coalesce(fallback, primary))


def is_json(body: Column) -> Column:
    """Whether a response is JSON: it begins as an object or array, and parses."""
    return F.coalesce(F.trim(body).rlike(r"^[{\[]") & F.try_parse_json(body).isNotNull(), F.lit(False))


def detail_text(value: str | None) -> str | None:
    """The texts of a detail page in normal form, one a line."""
    parts = (plain_text(t) for t in tree(value or "").texts())
    return "\n".join(t for t in parts if t) or None
