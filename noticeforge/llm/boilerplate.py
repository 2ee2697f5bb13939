"""The lines of a page that are the notice itself (problem 5).

Line-block distribution: markup is stripped line by line, the lengths of text are summed over sliding windows
of `WINDOW` lines, and the main block lies between the surge before the highest sum and the dive after it. A line
is as long as its longest piece between menu separators, so a row of menu entries is short.

The block is found twice. The first time, on all lines, it tells where each line stands. A line that recurs, but
for its digits, on a share of `RECURS` of its site's pages (or of all pages), and stands in the block on less than
`WITHIN` of them, is furniture of the site: what all notices say recurs as well, but inside blocks. No list of
words is used. The second time furniture has no length. Lines of text in that block are the notice's, and so are up to
`BEYOND` lines of text on either side (contacts, attachments), which a dive leaves out as they are short. Lines
without any mark of a clause, file or telephone are titles: of these only the headline that names what the block
speaks of is the notice's, so headlines of other notices in the block or around it aren't.

The furniture of a site is bounded: a line of share `RECURS` occurs on so many pages that a site has at most
(lines a page / `RECURS`) of them. It is counted over all pages, then sent to the tasks if it is at most
`MOST_TEMPLATES` lines in all, and joined by site, salted, if it is more.

Defined results: null, blank and JSON values have no lines; a list page, by its role or by having more than
twice as many titles as lines of text, has none either; text on script, style, head and comment lines isn't visible. Lines are
counted at line feeds, in whole values. Each line comes once. Rows without a source are one site.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.session import settle

#: Lines in a window, the share of the highest sum at which a block surges and dives, and how many lines of text,
#: with how many others between, may follow a block.
WINDOW, EDGE, BEYOND, BRIDGE = 3, 0.5, 4, 4
#: Share of pages, at least `TIMES`, that furniture recurs on, and share of these on which it is within the block.
RECURS, TIMES, WITHIN = 0.05, 3, 0.35
#: Lines of furniture that are sent to the tasks, and parts that pages of a site are salted into beyond that.
MOST_TEMPLATES, SALT = 1_000_000, 64

_SEPARATOR = re.compile(r"\s*[|丨·>/»]\s*|\s{2,}|(?<=[一-鿿]) (?=[一-鿿])")
#: What a line of text has and a title or menu hasn't: a mark within or after a clause, a file's name, a telephone.
_CLAUSE = re.compile(r"[。；;！，]|[.,]\s*$|[a-z], [a-z]")
_FILE = re.compile(r"\.(?:pdf|docx?|xlsx?|zip|rar|7z)\s*$", re.I)
_PHONE = re.compile(r"\d{3,4}[- ]?\d{7}")
_DIGITS = re.compile(r"\d+")
_TAG = re.compile(r"<[^>]*>")
_HIDDEN = re.compile(r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>|<title\b.*?</title>|<!DOCTYPE[^>]*>", re.S | re.I)
_OPENED = re.compile(r"<[^<>]*$")
_BLANK = re.compile(r"\s+")


def visible_lines(value: str, markup: bool) -> list[str]:
    """The visible text of each line. What is hidden over several lines leaves its line feeds."""
    if not markup:
        return [line.strip() for line in value.split("\n")]
    if "<" in value:
        value = _HIDDEN.sub(lambda m: "\n" * m.group().count("\n"), value)
        value = _TAG.sub(lambda m: "\n" * m.group().count("\n"), value)
    return [(html.unescape(line) if "&" in line else line).replace("\xa0", " ").strip() for line in value.split("\n")]


def template(line: str) -> int:
    """A line but for its digits, as a number that is equal in every task. A telephone number stays: that of a site
    recurs, that of a notice doesn't."""
    return xxhash.xxh3_64_intdigest((line if _PHONE.search(line) else _DIGITS.sub("0", line)).encode("utf-8", "surrogatepass")) - (1 << 63)


def length_of(line: str) -> float:
    return float(max((len(p) for p in _SEPARATOR.split(line)), default=0))


def main_block(lengths: np.ndarray, window: int = WINDOW, edge: float = EDGE) -> tuple[int, int]:
    """First and end of the block around the highest sum of `window` lengths."""
    sums = np.convolve(lengths, np.ones(window))[window // 2 :][: len(lengths)]
    peak = int(np.argmax(sums))
    low = edge * sums[peak]
    first = end = peak
    while first > 0 and sums[first - 1] >= low:
        first -= 1
    while end + 1 < len(sums) and sums[end + 1] >= low:
        end += 1
    return first, end + 1


def _pairs(text: str) -> set[str]:
    """Pairs of Han characters and fours of others."""
    text = _BLANK.sub("", text).lower()
    return {text[i : i + n] for i in range(len(text) - 1) for n in (2 if text[i] > "\u3400" else 4,)}


_KIND = re.compile(r"(?:招标|采购|中标|成交|变更|更正|澄清|候选人|结果)*(?:公告|公示)$|:[^:]*$")


def _shown(value: str | None, markup: bool, is_list: bool) -> tuple[list[str], list[int]]:
    if not value or is_list or (markup and value.lstrip()[:1] in "{["):
        return [], []
    lines = visible_lines(value, markup)
    return lines, [i for i, t in enumerate(lines) if t]


def places(value: str | None, markup: bool, is_list: bool = False) -> dict[int, bool]:
    """Of each template of a page whether it stands within the first block. Lines that name a file are left out."""
    lines, shown = _shown(value, markup, is_list)
    if not shown:
        return {}
    first, end = main_block(np.array([length_of(lines[i]) for i in shown]))
    out: dict[int, bool] = {}
    for k, i in enumerate(shown):
        if not _FILE.search(lines[i]):
            t = template(lines[i])
            out[t] = out.get(t, False) or first <= k < end
    return out


def notice_lines(value: str | None, markup: bool, is_list: bool = False, furniture: frozenset = frozenset(), block=main_block) -> list[int]:
    """Numbers, from 1, of the lines that are the notice's own. furniture: templates of the site."""
    lines, shown = _shown(value, markup, is_list)
    if not shown:
        return []
    # l: furniture, h: title, b: text
    kind = []
    for i in shown:
        t = lines[i]
        kind.append("b" if _FILE.search(t) else "l" if furniture and template(t) in furniture else "b" if _CLAUSE.search(t) or _PHONE.search(t) else "h")
    if kind.count("h") > max(4, 2 * kind.count("b")):
        return []
    lengths = np.array([length_of(lines[i]) if k == "b" else 0.0 for i, k in zip(shown, kind)])
    first, end = block(lengths)
    own = [k for k in range(first, end) if kind[k] == "b"]
    if own:
        for step in (-1, 1):  # lines of text next to the block
            k, passed, taken = (own[0] if step < 0 else own[-1]) + step, 0, 0
            while 0 <= k < len(shown) and passed <= BRIDGE and taken < BEYOND:
                if kind[k] == "b":
                    own.append(k)
                    passed, taken = 0, taken + 1
                else:
                    passed += 1
                k += step
        own.sort()
    heads = [k for k in range(len(shown)) if kind[k] == "h"]
    if heads:
        said = _pairs("".join(lines[shown[k]] for k in own[:4]))
        best, share = None, 0.0
        for k in heads:
            named = _pairs(_KIND.sub("", lines[shown[k]]))
            agrees = len(named & said) / max(1, len(named))
            if len(named) >= 6 and agrees > share + 1e-9 and (not own or k < own[-1]):
                best, share = k, agrees
        if best is not None and share >= 0.5:
            own.append(best)
    return sorted({shown[k] + 1 for k in own})


def _place_udf(markup: bool):
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("template", T.LongType()), T.StructField("within", T.IntegerType())])))
    def read(value: pd.Series, is_list: pd.Series) -> pd.Series:
        return pd.Series([[(t, int(w)) for t, w in places(v, markup, bool(x)).items()] for v, x in zip(value, is_list)], dtype=object)

    return read


def furniture_of(pages: DataFrame, markup: bool) -> DataFrame:
    """(site, templates) of pages (site, value, is_list); the null site holds what recurs over all sites."""
    seen = pages.select("site", _place_udf(markup)("value", "is_list").alias("p")).filter(F.size("p") > 0)
    counted = settle(seen.select("site", F.explode(F.concat("p", F.array(F.struct(F.lit(None).cast("long").alias("template"), F.lit(0).alias("within"))))).alias("x")).groupBy("site", "x.template").agg(F.count("*").alias("n"), F.sum("x.within").alias("within")))
    every = counted.groupBy("template").agg(F.sum("n").alias("n"), F.sum("within").alias("within")).withColumn("site", F.lit(None).cast("string"))
    both = counted.unionByName(every)
    pages_of = both.filter(F.col("template").isNull()).select(F.col("site").alias("of"), F.col("n").alias("pages"))  # one row a site
    recurs = both.filter(F.col("template").isNotNull() & (F.col("n") >= TIMES) & (F.col("within") < WITHIN * F.col("n")))
    return recurs.join(pages_of, F.col("site").eqNullSafe(F.col("of"))).filter(F.col("n") >= RECURS * F.col("pages")).groupBy("site").agg(F.collect_set("template").alias("templates"))


def _line_rows(field: str, markup: bool, known: dict | None):
    def rows(batches):
        for pdf in batches:
            ids, numbers = [], []
            given = [frozenset(t) if t is not None else frozenset() for t in pdf["templates"]] if known is None else [known.get(site, known.get(None, frozenset())) for site in pdf["site"]]
            for i, value, is_list, furniture in zip(pdf["row_id"].tolist(), pdf["value"].tolist(), pdf["is_list"].tolist(), given):
                found = notice_lines(value, markup, bool(is_list), furniture)
                ids += [i] * len(found)
                numbers += found
            yield pd.DataFrame({"field_name": field, "row_id": np.array(ids, dtype=np.int64), "line_no": np.array(numbers, dtype=np.int32)})

    return rows


def lines_of(rows: DataFrame, field: str, id_col: str, markup: bool, is_list=None) -> DataFrame:
    """(field_name, row_id, line_no) of the notice's lines in a text column."""
    pages = rows.filter(F.col(id_col).isNotNull() & F.col(field).isNotNull()).select(
        F.col(id_col).cast("long").alias("row_id"), F.col(field).alias("value"), (F.coalesce("source_code", F.lit("")) if "source_code" in rows.columns else F.lit("")).alias("site"),
        (F.coalesce(is_list, F.lit(False)) if is_list is not None else F.lit(False)).alias("is_list"))
    sets = settle(furniture_of(pages, markup))
    schema = "field_name string, row_id long, line_no int"
    if (sets.agg(F.sum(F.size("templates"))).first()[0] or 0) <= MOST_TEMPLATES:
        known = {r.site: frozenset(r.templates) for r in sets.toLocalIterator()}
        every = known.get(None, frozenset())
        known = {site: t | every for site, t in known.items()} | {None: every}
        return pages.mapInPandas(_line_rows(field, markup, known), schema)
    every = sets.filter(F.col("site").isNull()).first()  # one row, bounded as that of a site
    sites = pages.select("site").distinct().join(sets, "site", "left")
    none = F.array().cast("array<long>")
    salted = sites.select("site", F.array_union(F.coalesce("templates", none), F.lit([int(x) for x in every.templates]) if every else none).alias("templates"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    return pages.withColumn("salt", F.pmod("row_id", F.lit(SALT)).cast("int")).join(salted, ["site", "salt"], "left").mapInPandas(_line_rows(field, markup, None), schema)


def found(raw_documents: DataFrame, items: DataFrame) -> DataFrame:
    """The notice's lines of both tables. Ids are unique, so each line comes once."""
    role = F.get_json_object("extra_meta", "$.role")
    other = (role == "list") | (F.col("document_type") == "json") | F.col("mime_type").contains("json")
    return lines_of(raw_documents, "raw_body", "raw_id", True, other).unionByName(lines_of(items, "content_text", "item_id", False))
