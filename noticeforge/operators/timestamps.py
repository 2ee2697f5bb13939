"""Timestamps typed in many ways, to one instant.

Every value gets the array of all its valid readings (`readings`). Where a value has several, the one
read is chosen by Viterbi over the order of records within the source: a reading costs what it departs
from how the source writes, a step from one record to the next costs a switch of the format and a jump back in
time.

What a departure costs is learned. How a source orders all-digit dates is declared, but its dates with a day
beyond the twelfth show whether it keeps to that: the cost of the other order is the log of the odds against it,
starting from `TRUST` to one for the declaration, and turns negative for a source that writes otherwise. A jump
back costs the log of the odds against one between neighbouring records of the block that are read for sure: much
where a source publishes in order, next to nothing for deadlines, which have no order. So the chain can overrule a
declaration, and does where a source's own records speak against it.

A record with one reading separates the chain, as the state there is known. So the chain is cut into
blocks by record id, of `BLOCK` ids each; a block takes the last sure reading of the blocks before it as
its start. No group is larger than a block, whatever share of the rows one source has.

Defined results: null, blank and filler values, times of day without a date and dates that don't exist
have no reading and give no row. A bare date is the start of that day in the source's zone. A source that
isn't in the table of zones counts as UTC, YMD. Local times that a change to summer time skips are read
with the offset before the change; those that occur twice are read as the first unless the chain says
otherwise. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ids of records in a block.
BLOCK = 1 << 16
#: Years that a reading may have.
YEARS = (1971, 2099)
#: Costs of readings and steps; those of the order that isn't declared and of a jump back hold where nothing was learned.
COSTS = {"undeclared_order": 6.0, "second_fold": 2.5, "switch": 1.0, "back": 0.5}
#: Dates that a declaration is worth.
TRUST = 20
#: A step back by more than so many seconds is a jump; records of one source overlap by hours.
BACK_S = 86_400

READING = T.StructType([T.StructField("sec", T.LongType()), T.StructField("fmt", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("has_time", T.BooleanType())])

# Names of months, digits and parts of the day.
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0}
_PARTS = {"凌晨": "am", "早上": "am", "上午": "am", "中午": "noon", "下午": "pm", "晚上": "pm", "傍晚": "pm"}

_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?"
_ISO = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[T ]*{_CLOCK})?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?$")
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?)?(?P<z>Z|[+-]\d{2}:?\d{2})?$")
_EPOCH = re.compile(r"\d{9,10}$|\d{12,13}$")
_OPEN = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:[T ,]*{_CLOCK})?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?$")
_HAN = re.compile(r"(?P<y>\d{4})年(?P<m>\d{1,2})月(?P<d>\d{1,2})[日号]?\s*(?P<part>凌晨|早上|上午|中午|下午|晚上|傍晚)?\s*(?:(?P<h>\d{1,2})(?:[:时点](?:(?P<mi>\d{1,2})[分]?(?:[::]?(?P<s>\d{1,2})秒?)?|整)?))?$")
_HAN_DIGITS = re.compile(r"(?P<y>[〇零一二三四五六七八九]{4})年(?P<m>[一二三四五六七八九十]{1,3})月(?P<d>[一二三四五六七八九十]{1,3})[日号]")
_DMY_NAME = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[ -](?P<mon>[A-Za-z]{{3,9}})\.?[ -,]+(?P<y>\d{{4}})(?:[ ,]+{_CLOCK})?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?$")
_MDY_NAME = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:[ ,]+{_CLOCK})?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}})?$")
_BEIJING = re.compile(r"[(（]?北京时间[)）]?")
_LEAD = re.compile(r"^(?:(?:截至|截止|于|时间|发布时间|日期|自)\s*[::]?\s*)+")
_EPOCH_DAY = dt.date(1970, 1, 1)


@lru_cache(maxsize=None)
def _zone(name: str | None):
    try:
        return ZoneInfo(name or "UTC")
    except Exception:  # a name that isn't known
        return ZoneInfo("UTC")


@lru_cache(maxsize=4096)
def _abbreviation(zone: str, abbr: str, year: int) -> int | None:
    """Offset in seconds of a zone's abbreviation: as the zone uses it in winter or summer of that year."""
    if abbr in ("UTC", "GMT", "Z"):
        return 0
    for month in (1, 7):
        moment = dt.datetime(year, month, 1, tzinfo=_zone(zone))
        if moment.tzname() == abbr:
            return int(moment.utcoffset().total_seconds())
    return None


@lru_cache(maxsize=200_000)
def _midnight(y: int, m: int, d: int) -> int | None:
    try:
        return (dt.date(y, m, d) - _EPOCH_DAY).days * 86_400
    except ValueError:
        return None


@lru_cache(maxsize=200_000)
def _hour_offsets(zone: str, hour: int) -> tuple[int, int]:
    """Offsets of both folds at the quarter hour (so many since 1970, local time)."""
    local = dt.datetime(1970, 1, 1) + dt.timedelta(minutes=15 * hour)
    z = _zone(zone)
    return tuple(int(local.replace(tzinfo=z, fold=f).utcoffset().total_seconds()) for f in (0, 1))


def _han_number(text: str) -> int:
    if "十" not in text:
        return int("".join(str(_DIGITS[c]) for c in text))
    tens, _, ones = text.partition("十")
    return (_DIGITS[tens] if tens else 1) * 10 + (_DIGITS[ones] if ones else 0)


def _seconds(g: dict) -> int | None:
    """Time of day in seconds; 24:00 is the end of the day."""
    if g.get("h") is None:
        return 0
    h, mi, s = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
    half = _PARTS.get(g.get("part") or "") or (g.get("ap") or "").lower().replace(".", "")
    if half == "pm" and h < 12:
        h += 12
    elif half == "am" and h == 12:
        h = 0
    elif half == "noon" and h < 3:
        h += 12
    if mi > 59 or s > 60 or h > 24 or (h == 24 and (mi or s)):
        return None
    return h * 3600 + mi * 60 + s


def _instants(y: int, m: int, d: int, g: dict, zone: str, fmt: str, cost: float) -> Iterator[tuple]:
    """Readings of a date with what else is in g."""
    day, second = _midnight(y, m, d), _seconds(g)
    if day is None or second is None or not YEARS[0] <= y <= YEARS[1]:
        return
    local, has_time, z = day + second, g.get("h") is not None, g.get("z")
    if z:
        if z[0] in "+-":
            digits = z[1:].replace(":", "")
            offset = (int(digits[:2]) * 3600 + int(digits[2:]) * 60) * (1 if z[0] == "+" else -1)
        else:
            offset = _abbreviation(zone, z, y)
        if offset is not None:
            yield local - offset, fmt + "z", cost, has_time
            return
    first, second = _hour_offsets(zone, local // 900)
    yield local - first, fmt, cost, has_time
    if first > second:  # the local time occurs twice
        yield local - second, fmt, cost + COSTS["second_fold"], has_time


def readings(value: str | None, zone: str | None = None, order: str | None = None) -> list[tuple]:
    """All valid readings of a value: (UTC second, format, cost, whether it names a time of day)."""
    if not value:
        return []
    text = value if value.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", value))
    text, zone = text.strip(), zone or "UTC"
    if len(text) < 8:
        return []
    if not text.isascii():
        if "北京时间" in text:
            text, zone = _BEIJING.sub("", text).strip(), "Asia/Shanghai"
        text = _LEAD.sub("", text).strip()
        if m := _HAN_DIGITS.match(text):
            try:
                text = f"{_han_number(m['y'])}年{_han_number(m['m'])}月{_han_number(m['d'])}日{text[m.end():]}"
            except (KeyError, ValueError):
                return []
        if m := _HAN.match(text):
            return list(_instants(int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), zone, "han", 0.0))
    out: list[tuple] = []
    if text.isdigit():
        if _EPOCH.match(text):
            sec = int(text) if len(text) <= 10 else int(text) // 1000
            if YEARS[0] <= 1970 + sec / 31_556_952 <= YEARS[1]:
                out.append((sec, "epoch", 0.0, True))
        if len(text) in (8, 12, 14) and (m := _BASIC.match(text)):
            out += _instants(int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), zone, "basic", 0.0)
        return out
    for shape, fmt in ((_ISO, "iso"), (_BASIC, "basic")):
        if m := shape.match(text):
            return list(_instants(int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), zone, fmt + (m.groupdict().get("sep") or ""), 0.0))
    if m := _OPEN.match(text):
        g, a, b, y = m.groupdict(), int(m["a"]), int(m["b"]), int(m["y"])
        for kind, (month, day) in {"DMY": (b, a), "MDY": (a, b)}.items():
            out += _instants(y, month, day, g, zone, kind, 0.0 if order == kind or a == b else COSTS["undeclared_order"])
        return out if a != b else out[: len(out) // 2]
    for shape in (_DMY_NAME, _MDY_NAME):
        if (m := shape.match(text)) and (month := _MONTHS.get(m["mon"][:3].lower())):
            return list(_instants(int(m["y"]), month, int(m["d"]), m.groupdict(), zone, "name", 0.0))
    return out


def best_chain(states: list[list[tuple]], start: tuple | None = None, back: float = COSTS["back"]) -> list[int]:
    """Viterbi over records of several readings each: the index of the reading taken for each.
    start is the reading before the first. Ties go to the first reading."""
    chosen: list[int] = [0] * len(states)
    i, previous = 0, start
    while i < len(states):
        if len(states[i]) == 1:
            previous, i = states[i][0], i + 1
            continue
        j = i
        while j < len(states) and len(states[j]) > 1:
            j += 1
        end = states[j][0] if j < len(states) else None
        costs: list[float] | None = None
        links: list[list[int]] = []
        for k in range(i, j + (end is not None)):
            now = states[k]
            if costs is None:
                costs, link = [s[2] + (_step(previous, s, back) if previous else 0.0) for s in now], [-1] * len(now)
            else:
                link, new = [], []
                for s in now:
                    through = [c + _step(p, s, back) for c, p in zip(costs, states[k - 1])]
                    link.append(through.index(min(through)))
                    new.append(min(through) + s[2])
                costs = new
            links.append(link)
        at = costs.index(min(costs))
        for k in range(i + len(links) - 1, i - 1, -1):
            chosen[k] = at
            at = links[k - i][at]
        i = j
    return chosen


def _step(a: tuple, b: tuple, back: float = COSTS["back"]) -> float:
    return (COSTS["switch"] if a[1] != b[1] else 0.0) + (back if b[0] < a[0] - BACK_S else 0.0)


def back_cost(seconds: list[int]) -> float:
    """What a jump back costs among records of these instants, in their order."""
    jumps = sum(y < x - BACK_S for x, y in zip(seconds, seconds[1:]))
    return max(0.0, math.log((len(seconds) - jumps) / (jumps + 1))) if seconds else COSTS["back"]


@F.pandas_udf(T.ArrayType(READING))
def _readings_udf(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    return pd.Series([readings(*x) for x in zip(value, zone, order)], dtype=object)


def _choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    other = pdf["other_order"].iloc[0]
    states = [[(r["sec"], r["fmt"], r["cost"] - COSTS["undeclared_order"] + other if r["cost"] >= COSTS["undeclared_order"] else r["cost"], r["has_time"]) for r in rs] for rs in pdf["readings"]]
    before = pdf["before"].iloc[0]
    start = None if before is None else (before["sec"], before["fmt"])
    taken = [s[i] for s, i in zip(states, best_chain(states, start, back_cost([s[0][0] for s in states if len(s) == 1])))]
    return pd.DataFrame({"id": pdf["id"], "field_name": pdf["field_name"], "utc_second": [t[0] for t in taken], "fmt": [t[1] for t in taken], "has_time": [t[3] for t in taken], "n_readings": [len(s) for s in states]})


def normalise_timestamps(rows: DataFrame, zones: DataFrame, fields: list[str], id_col: str = "item_id", source_col: str = "source_code", block: int = BLOCK) -> DataFrame:
    """(id, field_name, utc_second, fmt, has_time, n_readings) for each usable value of the fields of rows.
    zones: source_code, tz_name, date_order, one row a source; of several the smallest names count."""
    zones = zones.groupBy(F.col("source_code").alias("_zone_source")).agg(F.min(F.struct("tz_name", "date_order")).alias("_z"))
    # one projection of few columns; a value without a digit has no reading, but for Chinese digits
    long = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))).alias("v"),
    ).select("id", "source", "v.*")
    long = long.filter(F.col("value").isNotNull() & (F.length("value") >= 8) & F.col("id").isNotNull())
    zoned = long.join(zones, F.col("source") == F.col("_zone_source"), "left")
    read = zoned.select("id", "source", "field_name", _readings_udf("value", F.col("_z.tz_name"), F.col("_z.date_order")).alias("readings")).filter(F.size("readings") > 0)
    # what is read once needs no chain; only blocks with a value of several readings do
    read = _settle(read.withColumn("block", F.floor(F.col("id") / block)))
    single = F.size("readings") == 1
    blocks = read.groupBy("source", "field_name", "block").agg(
        F.max(~single).alias("open"),
        F.max_by(F.col("readings")[0], F.when(single, F.col("id"))).alias("last_sure"),
    )
    order = Window.partitionBy("source", "field_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "field_name", "block", "open", F.last("last_sure", ignorenulls=True).over(order).alias("before")).filter("open")
    # dates whose order is plain: how many keep to the declaration, and how many don't
    plain = F.col("readings")[0]
    kept = read.filter(single & plain["fmt"].rlike("^(DMY|MDY)")).groupBy("source").agg(F.count_if(plain["cost"] < COSTS["undeclared_order"]).alias("yes"), F.count_if(plain["cost"] >= COSTS["undeclared_order"]).alias("no"))
    blocks = blocks.join(kept, "source", "left").withColumn("other_order", F.log((F.coalesce("yes", F.lit(0)) + TRUST) / (F.coalesce("no", F.lit(0)) + 1.0))).drop("yes", "no")
    sure = read.filter(single).select("id", "field_name", F.col("readings")[0].alias("r")).select("id", "field_name", F.col("r.sec").alias("utc_second"), F.col("r.fmt"), F.col("r.has_time"), F.lit(1).alias("n_readings"))
    chained = (
        read.join(blocks, ["source", "field_name", "block"])
        .groupBy("source", "field_name", "block")
        .applyInPandas(_choose, "id long, field_name string, utc_second long, fmt string, has_time boolean, n_readings int")
        .filter("n_readings > 1")
    )
    return sure.unionByName(chained)


def _settle(df: DataFrame) -> DataFrame:
    from noticeforge.session import settle

    return settle(df)
