"""Variant spellings of the names of public bodies and firms (problem 4).

A name is taken apart into place, kind of body, number and, of firms, brand. Places are learned from the names
that spell them out; the rest is what is left. Numbers and brands aren't part of a kind, so differently numbered
bodies and different firms stay apart, whatever their distance.

Typing errors are found by metric-space partitioning. The distinct kinds are assigned to the nearest of some
pivots; a kind is replicated to every pivot that is at most 2 * `RADIUS` farther, so by the triangle inequality
any two kinds within the radius meet in the home cell of either. In a cell all pairs within `RADIUS` under the
Levenshtein distance are found; full cells are cut into blocks, each pair of blocks a group of its own. Of a pair the
kind that is written much more seldom is an error for the other; long kinds that are both seldom are errors for
the one written no less. Two edits that aren't an exchange of neighbours are an error only in kinds of
`LONG_LATIN` characters or more, as shorter kinds two edits apart are mostly different ones.

Short forms are learned, not listed: a kind that leaves out characters or words of another, and at nearly all of its
places stands beside it, is its short form (`shortened`). The lists that remain are of signs around names, of
forms of company, of trades in two notations, of general abbreviations of English words, and of characters
that sound alike, which tell which of several kinds an error is for.

Names of one body are the class; `linked_pairs` expands classes to the pairs asked for.

Defined results: null and blank names belong to no body; a name that stands twice belongs to one; names
without a known place are compared by their whole rest.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.llm.lookalikes import canonical
from noticeforge.llm.notice_text import han_number
from noticeforge.session import settle, skewless

RADIUS = 2
#: A kind written less than this share as often as its neighbour is an error for it.
SELDOM = 0.5
#: Kinds of so many characters, Latin or rarely written, are errors for any neighbour written no less.
LONG_LATIN, LONG_RARE = 8, 5
#: Kinds that a pivot stands for, bounds on pivots, and kinds in a block of a full cell.
PER_PIVOT, PIVOTS, BLOCK = 100, (4, 512), 512
#: Share of a short form's places at which its full form is written too.
TOGETHER = 0.6

# What is written around names.
_BEFORE = re.compile(r"^(?:【[^】]*】|(?:采购人|招标人|采购单位|招标单位|建设单位|业主|单位名称)(?:名称)?\s*[:： ])+\s*")
_AFTER = re.compile(r"(?:[(（](?:盖章|公章|采购人|招标人|采购单位|章)[)）]|采购办(?:公室)?|招标办|[。.])+$")
# Trades of firms, as written in full and in short.
_TRADES = {"环境科技": "环境科技", "环科": "环境科技", "园林绿化": "园林绿化", "园林": "园林绿化", "建筑工程": "建筑工程", "建工": "建筑工程", "信息技术": "信息技术", "信息": "信息技术", "物业服务": "物业服务", "物业": "物业服务", "供热": "供热"}
_COMPANY = ("有限责任公司", "有限公司")
# Characters that sound alike and are typed for each other in names.
_SOUND = str.maketrans("晓苑思玉衣党途搏线工际萎镜居荣煤元急贯空", "小院司育医档图博限公技委境局融媒园疾管控")
_WORDS = {"sch": "school", "gen": "general", "mun": "municipal", "auth": "authority", "comm": "commission", "util": "utility", "mgmt": "management", "proc": "procurement", "eng": "engineering", "dept": "department", "dist": "district", "svc": "service"}

_HAN = re.compile("[㐀-鿿]")
_NUMBER = re.compile(r"第*([一二三四五六七八九十]+|\d+)")
_SEPARATOR = re.compile(r"[\s(（)）\-—·,，]+")

PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "number", "brand")])


def clean(name: str | None) -> str:
    """A name in canonical characters without what is written around it."""
    text = unicodedata.normalize("NFKC", canonical(name) or "").strip()
    while True:
        shorter = _AFTER.sub("", _BEFORE.sub("", text)).strip() if _HAN.search(text) else text
        if shorter == text:
            return text
        text = shorter


def fold(word: str) -> str:
    """A word without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, exchange or transposition of neighbours makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def without_company(text: str) -> tuple[str, bool]:
    """A name without its form of company, also if that has one error; and whether it had one."""
    for form in _COMPANY:
        if text.endswith(form):
            return text[: -len(form)], True
    shorter = [text[:-n] for form in _COMPANY for n in (len(form), len(form) + 1, len(form) - 1) if len(text) > n + 2 and one_edit(text[-n:], form)]
    if shorter:  # of several, one that leaves a trade
        return next((s for s in shorter if s[2:] in _TRADES), shorter[0]), True
    if text.endswith("公司") and (_trade(text[2:-2]) or len(text) == 4):
        return text[:-2], True
    return text, False


def _trade(text: str) -> str | None:
    if text in _TRADES:
        return _TRADES[text]
    if len(text) >= 3:
        for trade in _TRADES.values():
            if len(trade) > 2 and one_edit(text, trade):
                return trade
    return None


def han_parts(name: str, place: str | None, above: str | None) -> tuple[str, str, str]:
    """(kind, number, brand) of a cleaned Chinese name at a place (county) within another (prefecture)."""
    rest = name
    for token in (above, place):
        if token:
            rest = rest.replace(token, "", 1) if token in rest else re.sub(f"^[\\s]*{token[:-1]}(?=.)", "", rest, count=1)
    rest = _SEPARATOR.sub("", rest)
    short, company = without_company(rest)
    if len(short) >= 2 and (company or len(short) <= 6):
        trade = _trade(short[2:])
        if trade:
            return f"firm {trade}", "", short[:2].translate(_SOUND)
        if len(short) == 2 and (company or not _NUMBER.search(short)):
            return "firm", "", short.translate(_SOUND)
    rest = short if company else rest
    number = ""
    if m := _NUMBER.search(rest):
        said = m[1]
        n = han_number(said)
        if n is None or (not said.isdigit() and any(x == y for x, y in zip(said, said[1:]))):  # a numeral typed twice
            n = han_number("".join(c for i, c in enumerate(said) if i == 0 or c != said[i - 1])) or 0
        number = str(n)
        rest = (rest[: m.start()] + "N" + rest[m.end() :]).replace("第", "")
    return rest, number, ""


def english_parts(name: str, place: str | None) -> tuple[str, str, str]:
    """(kind, number, brand) of a name in Latin letters; the place is a folded word."""
    words = re.findall(r"[^\W\d_]+(?:['’][a-z]+)?|\d+", fold(name).replace("co-op", "coop"))
    if place in words:
        at = words.index(place)
        words.pop(at)
        if at and words[at - 1] == "of":
            words.pop(at - 1)
            if at == 2 and words[0] in ("mun", "municipality", "city") and len(words) > 1:
                words.pop(0)
    if words[:1] == ["the"]:
        words.pop(0)
    return " ".join(_WORDS.get(w, w) for w in words), "", ""


@F.pandas_udf(T.StringType())
def _clean_udf(names: pd.Series) -> pd.Series:
    return names.map(clean)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_udf(names: pd.Series) -> pd.Series:
    """What of a cleaned name may be a place: two Han characters, or a folded word."""
    return names.map(lambda s: sorted({s[i : i + 2] for i in range(len(s) - 1)}) if _HAN.search(s) else sorted({fold(w) for w in re.findall(r"[^\W\d_]+", s)}))


@F.pandas_udf(PARTS)
def _parts_udf(name: pd.Series, place: pd.Series, above: pd.Series) -> pd.DataFrame:
    rows = [han_parts(n, p, a) if _HAN.search(n) else english_parts(n, p) for n, p, a in zip(name, place.where(place.notna(), None), above.where(above.notna(), None))]
    return pd.DataFrame(rows, columns=PARTS.names)


def levenshtein(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of all of a to all of b, as one table of the dynamic program over all pairs at once."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    code = lambda xs, n: np.array([[ord(c) for c in x] + [0] * (n - len(x)) for x in xs], dtype=np.int32).reshape(len(xs), n)
    na, nb = int(la.max(initial=0)), int(lb.max(initial=0))
    ca, cb = code(a, na), code(b, nb)
    out = np.zeros((len(a), len(b)), np.int16)
    row = np.broadcast_to(np.arange(nb + 1, dtype=np.int16), (len(a), len(b), nb + 1)).copy()
    at_b = np.broadcast_to(lb, (len(a), len(b)))[..., None].astype(np.int64)
    for i in range(na + 1):
        done = la == i
        if done.any():
            out[done] = np.take_along_axis(row[done], at_b[done], axis=2)[..., 0]
        if i == na:
            break
        new = np.empty_like(row)
        new[..., 0] = i + 1
        change = (ca[:, i, None, None] != cb[None, :, :]).astype(np.int16)
        best = np.minimum(row[..., 1:] + 1, row[..., :-1] + change)
        for j in range(nb):
            new[..., j + 1] = np.minimum(best[..., j], new[..., j] + 1)
        row = new
    return out


def _assign(pivots: list[str], radius: int):
    """Cells of each kind: the nearest pivot's (home), and all at most 2 * radius farther."""

    def rows(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                d = levenshtein(part["kind"].tolist(), pivots)
                k, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius)
                home = d.argmin(axis=1)[k] == cell
                yield pd.DataFrame({"cell": cell.astype(np.int32), "kind": part["kind"].to_numpy()[k], "n": part["n"].to_numpy()[k], "home": home})

    return rows


def _join_blocks(radius: int, seldom: float):
    """Pairs of a block of a cell's homes with a block of all in the cell, within the radius."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        kinds, others = left["kind"].tolist(), right["kind"].tolist()
        if not kinds or not others:
            return pd.DataFrame([], columns=["kind", "right", "n", "alike", "d"])
        n, m = left["n"].to_numpy(), right["n"].to_numpy()
        d = levenshtein(kinds, others)
        free_a, free_b = ([k.isascii() and len(k) >= LONG_LATIN or len(k) >= LONG_RARE and c <= 2 for k, c in zip(ks, cs)] for ks, cs in ((kinds, n), (others, m)))
        order = {k: i for i, k in enumerate(sorted(set(kinds) | set(others)))}
        rank_a, rank_b = np.array([order[k] for k in kinds]), np.array([order[k] for k in others])
        less = (n[:, None] < m[None, :]) | ((n[:, None] == m[None, :]) & (rank_a[:, None] < rank_b[None, :]))
        lesser = (n[:, None] < seldom * m[None, :]) | (np.array(free_a)[:, None] & np.array(free_b)[None, :] & less)
        out = []
        for a, b in zip(*np.nonzero((d > 0) & (d <= radius) & lesser)):
            x, y = kinds[a], others[b]
            # two characters are too few for an error; two edits are one only in a name of some length, unless
            # neighbours changed places
            if min(len(x), len(y)) > 2 and (d[a, b] == 1 or one_edit(x, y) or min(len(x), len(y)) >= LONG_LATIN):
                out.append((x, y, int(m[b]), x.translate(_SOUND) == y.translate(_SOUND), int(d[a, b])))
        return pd.DataFrame(out, columns=["kind", "right", "n", "alike", "d"])

    return pairs


def corrected(kinds: DataFrame, radius: int = RADIUS, seldom: float = SELDOM, block: int = BLOCK) -> DataFrame:
    """(kind, right): of each kind that is an error, the kind it is an error for. kinds: (kind, n).

    Each pair is found in the home cell of its left side. A full cell is cut into blocks of about `block` kinds by
    hash, and each block of homes meets each block of the cell as a group of its own, so no task takes a whole cell."""
    total = kinds.count()
    k = int(min(max(total / PER_PIVOT, PIVOTS[0]), PIVOTS[1]))
    # pivots: a bounded sample, the kinds written most
    pivots = [r.kind for r in kinds.orderBy(F.desc("n"), "kind").limit(k).collect()]
    if not pivots:
        return kinds.select("kind", F.col("kind").alias("right")).limit(0)
    cells = settle(kinds.mapInPandas(_assign(pivots, radius), "cell int, kind string, n long, home boolean"))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # one row a pivot
    parted = cells.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("kind"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = parted.filter("home").select("cell", "kind", "n", F.col("part").alias("i"), every.alias("j"), F.lit(0).alias("side"))
    right = parted.select("cell", "kind", "n", every.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))
    # groups are small in bytes but long in work: as many partitions as the session has, not as few as hold them
    pairs = left.unionByName(right).repartition(skewless(kinds.sparkSession), "cell", "i", "j").groupBy("cell", "i", "j").applyInPandas(_join_blocks(radius, seldom), "kind string, right string, n long, alike boolean, d int")
    step = settle(pairs.groupBy("kind").agg(F.max_by("right", F.struct("alike", -F.col("d"), "n", "right")).alias("right")))
    # an error for an error: each step leads to a kind written more, or as often and later in order, so steps end; each
    # round doubles their length
    while True:
        on = step.select(F.col("kind").alias("right"), F.col("right").alias("further"))
        longer = settle(step.join(on, "right", "left").select("kind", F.coalesce("further", "right").alias("right"), F.col("further").isNotNull().alias("moved")))
        step = longer.select("kind", "right")
        if not longer.filter("moved").limit(1).count():
            return step


def shortens(short: str, full: str) -> bool:
    """Whether a kind leaves out part of another: of Han names characters, their order kept; of others words, or the
    ends of words; or has its words in another order."""
    if _HAN.search(short):
        rest = iter(full)
        return len(short) < len(full) and all(c in rest for c in short)
    words, at = full.split(), 0
    if sorted(w for w in words if w != "of") == sorted(w for w in short.split() if w != "of"):
        return short != full
    for w in short.split():
        while at < len(words) and not (words[at].startswith(w) or (len(w) > 4 and w.endswith("s") and words[at] == w[:-1])):
            at += 1
        if at == len(words):
            return False
        at += 1
    return len(short.split()) < len(words) or len(short) < len(full)


@F.pandas_udf(T.BooleanType())
def _shortens_udf(short: pd.Series, full: pd.Series) -> pd.Series:
    return pd.Series([shortens(a, b) for a, b in zip(short, full)], dtype=bool)


def shortened(written: DataFrame, share: float = TOGETHER) -> DataFrame:
    """(kind, full): of each kind that leaves out part of others the one that stands beside it at most of its places,
    at least at `share` of them. written: (place, kind, n). Bodies are written in full somewhere, so a short form's
    full form is found at nearly all places it is, and a mere likeness isn't."""
    of = settle(written.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("places")))
    edge = lambda k: F.explode(F.array(F.concat(F.lit("^"), F.substring(k, 1, 1)), F.concat(F.lit("$"), F.substring(k, -1, 1)), F.array_join(F.array_sort(F.filter(F.split(k, " "), lambda w: w != "of")), " ")))
    a = of.filter(F.length("kind") >= 2).select("kind", "n", "places", edge("kind").alias("edge"))
    b = of.select(F.col("kind").alias("full"), F.col("n").alias("m"), edge("kind").alias("edge"))
    fit = a.join(b, "edge").filter((F.length("full") > F.length("kind")) & (F.col("m") > F.col("n"))).select("kind", "full", "places", "m").distinct().filter(_shortens_udf("kind", "full"))
    at = written.select("place", "kind")
    met = fit.join(at, "kind").join(at.select("place", F.col("kind").alias("full")), ["place", "full"]).groupBy("kind", "full", "places", "m").agg(F.count("*").alias("both"))
    met = met.filter(F.col("both") >= share * F.col("places"))
    return met.groupBy("kind").agg(F.max_by("full", F.struct(F.col("both"), -F.length("full"), "m", "full")).alias("full"))


def _places(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Learned places: (token, place, above) of counties by their two characters, and folded Latin words."""
    spelled = cleaned.select(F.regexp_extract("name", "^([㐀-鿿]{2}市)([㐀-鿿]{2}[市区县])[㐀-鿿]{2}", 1).alias("above"), F.regexp_extract("name", "^([㐀-鿿]{2}市)([㐀-鿿]{2}[市区县])[㐀-鿿]{2}", 2).alias("place")).filter("place != ''")
    by_region = cleaned.select(F.regexp_extract("region", "([㐀-鿿]{2}市)$", 1).alias("above")).filter("above != ''").groupBy("above").count()
    pairs = spelled.groupBy("above", "place").agg(F.count("*").alias("n")).join(by_region, "above", "left")
    # of the counties of two characters the one spelled most; what is spelled far less than the usual is no place
    best = pairs.groupBy(F.substring("place", 1, 2).alias("token")).agg(F.max_by(F.struct("place", "above"), F.struct("n", "place")).alias("p"), F.sum("n").alias("n"))
    best = settle(best)
    usual = best.agg(F.avg("n")).first()[0] or 0.0
    han = best.filter(F.col("n") >= 0.05 * usual).select("token", "p.place", "p.above")
    latin = cleaned.filter(~F.col("name").rlike("[㐀-鿿]")).select(F.explode(F.array_compact(F.array("region", F.regexp_extract("name", r"^(?i:Mun\.? of) ([^\s,]+),", 1)))).alias("place")).filter("place != '' and place not like '% %'").distinct()
    return han, latin


def bodies(rows: DataFrame, id_col: str = "name_id", name_col: str = "issuer", region_col: str = "region") -> DataFrame:
    """(name_id, body_id, n_spellings) of each name: the smallest id of its body, and how many spell it."""
    named = rows.filter(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).select(F.col(id_col).cast("long").alias("name_id"), _clean_udf(name_col).alias("name"), F.col(region_col).alias("region"))
    named = settle(named.filter("name != ''").dropDuplicates(["name_id"]))
    han, latin = _places(named)
    fold_udf = F.pandas_udf(lambda s: s.map(fold), T.StringType())
    latin = latin.select(fold_udf("place").alias("token")).distinct().select("token", F.col("token").alias("place"), F.lit(None).cast("string").alias("above"))
    places = han.unionByName(latin)
    tokens = named.select("name_id", "name", F.explode(_tokens_udf("name")).alias("token"))
    # the place that the name spells with its suffix, else the first in it
    hit = tokens.join(places, "token").groupBy("name_id").agg(F.max_by(F.struct("place", "above"), F.struct(F.contains("name", "place"), -F.instr("name", F.col("token")), "place")).alias("p"))
    parted = named.join(hit, "name_id", "left").select("name_id", F.col("p.place").alias("place"), _parts_udf("name", F.col("p.place"), F.col("p.above")).alias("x")).select("name_id", F.coalesce("place", F.lit("")).alias("place"), "x.*")
    parted = settle(parted)
    # a firm without its trade is the one firm of its brand at its place, if there is one; else its two characters are
    # a short form of a kind
    firms = parted.filter(F.col("kind").startswith("firm ")).groupBy("place", "brand").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low = high").select("place", "brand", F.col("low").alias("trade"))
    bare = parted.filter("kind = 'firm'").join(firms, ["place", "brand"], "left").withColumn("kind", F.coalesce("trade", "brand")).withColumn("brand", F.when(F.col("trade").isNotNull(), F.col("brand")).otherwise("")).drop("trade")
    parted = settle(parted.filter("kind != 'firm'").unionByName(bare))
    kinds = parted.groupBy("kind").agg(F.count("*").alias("n")).filter(F.length("kind") > 1)
    right = corrected(settle(kinds))
    fixed = parted.join(right, "kind", "left").withColumn("kind", F.coalesce("right", "kind")).drop("right")
    # initials stand for the kind of several words that has them, if one has
    initials = kinds.filter(F.col("kind").contains(" ") & ~F.col("kind").startswith("firm ")).select(F.col("kind").alias("full"), "n", F.array_join(F.transform(F.filter(F.split("kind", " "), lambda w: w != "of"), lambda w: F.substring(w, 1, 1)), "").alias("kind")).filter(F.length("kind") > 2)
    initials = initials.groupBy("kind").agg(F.max_by("full", F.struct("n", "full")).alias("full"))
    fixed = settle(fixed.join(initials, "kind", "left").withColumn("kind", F.coalesce("full", "kind")).drop("full"))
    short = shortened(fixed.groupBy("place", "kind").agg(F.count("*").alias("n")))
    fixed = fixed.join(short, "kind", "left").withColumn("kind", F.coalesce("full", "kind")).drop("full")
    keyed = settle(fixed.select("name_id", F.xxhash64("place", "kind", "number", "brand").alias("body")))
    sizes = keyed.groupBy("body").agg(F.min("name_id").alias("body_id"), F.count("*").alias("n_spellings"))
    return keyed.join(sizes, "body").select("name_id", "body_id", "n_spellings")


def linked_pairs(rows: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b) of all names of one body. A body has as many names as people found spellings."""
    of = bodies(rows).filter("n_spellings > 1").select("name_id", "body_id")
    a, b = of.withColumnRenamed("name_id", "name_id_a"), of.withColumnRenamed("name_id", "name_id_b")
    return a.join(b, "body_id").filter("name_id_a < name_id_b").select("name_id_a", "name_id_b")
