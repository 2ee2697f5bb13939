"""Text that looks the same, to the same characters (problem 7).

A value passes a quick check first: characters that no rule below touches are stable. Around each unstable
character the segment up to the next boundary (a stable starter that doesn't compose with what follows) is
brought to the canonical form, and the canonical segments are spliced into the text, which otherwise stays
as it is. So text of stable characters costs one scan and is never copied.

Canonical: compatibility forms by NFKC, but for signs with a meaning of their own (`_SIGNS`) and Chinese
punctuation of either width; invisible characters dropped; blanks of all kinds to a blank; hyphens of all
kinds to a hyphen; letters of other alphabets that look like Latin ones to Latin, where they stand in or
as a Latin word. Greek letters on their own, other than capitals that look Latin, stay.

Defined results: null and blank values aren't cases; a value that is invisible as a whole isn't one
either. Any length is scanned whole. Repeated rows give repeated results in `canonical_values`, one row in
`found`.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like Latin ones.
_CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХавеѕіјкмнорстухһԁԛԝҮүӀ", "ABESIJKMHOPCTYXaвesijкмнopcтyxhdqwYyI", strict=True)) | {"в": "b", "к": "k", "м": "m", "н": "h", "т": "t"}
_CYRILLIC |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃՕՍօսհոց", "ABCDEGHJKLMPRSTVWZOUouhng", strict=True))  # Cherokee and Armenian
_GREEK_CAPITALS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True))
_GREEK_SMALL = dict(zip("αικνορτυχγε", "aikvoptuxye", strict=True))
_HYPHENS = "‐‑‒–−﹣"
#: Compatibility characters with a meaning of their own.
_SIGNS = "℃℉№℡™℠‰Å…‥¨´¸µª²³¹º¼½¾"
_PUNCTUATION = "！＂＃＄％＆＇（）＊＋，－．／：；＜＝＞？＠［＼］＾＿｀｛｜｝～｟｠｡｢｣､･￥￡￠￦"


def _sign(c: str) -> bool:
    o = ord(c)
    return c in _SIGNS or c in _PUNCTUATION or 0x2070 <= o <= 0x209F or 0x2150 <= o <= 0x218F or 0x2460 <= o <= 0x24FF or 0x3200 <= o <= 0x33FF or 0xFE10 <= o <= 0xFE4F


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0)


# Characters of class 0 that the quick check answers "maybe": the second parts of composites, and Hangul jamo.
_MAYBE = {chr(int(d[1], 16)) for o in range(0x110000) if not 0xD800 <= o < 0xE000 and len(d := unicodedata.decomposition(chr(o)).split()) == 2 and d[0][0] != "<"} | {chr(o) for o in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
_MAYBE = {c for c in _MAYBE if c > "\x7f"}


def _unstable(c: str) -> bool:
    """The quick check of one character: no, or maybe."""
    if c < "\x7f":
        return False
    if c in _CYRILLIC or c in _GREEK_CAPITALS or c in _GREEK_SMALL or c in _HYPHENS or c in _MAYBE:
        return True
    if _invisible(c) or (unicodedata.category(c) == "Zs") or unicodedata.combining(c):
        return True
    return not unicodedata.is_normalized("NFC", c) or (not _sign(c) and unicodedata.normalize("NFKC", c) != c)


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}" + (f"-\\U{chars[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


# One class of all unstable characters, computed from the character data; so the quick check is one scan.
_UNSTABLE = _ranges([o for o in [*range(0x7F, 0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD7FC), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)] if not 0xD800 <= o < 0xE000 and _unstable(chr(o))])
QUICK = re.compile(f"[{_UNSTABLE}]")
#: A segment: unstable characters with the starter before them, and words that hold one.
_SEGMENT = re.compile(f"[^\\W\\d_㐀-鿿]*[{_UNSTABLE}](?:[{_UNSTABLE}]|[^\\W\\d_㐀-鿿])*|.[{_UNSTABLE}]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_FORM = {c: "-" for c in _HYPHENS}


def _canonical_segment(segment: str) -> str:
    out = []
    for c in segment:
        if _invisible(c):
            continue
        if c in _FORM:
            out.append(_FORM[c])
        elif c < "\x7f" or _sign(c):
            out.append(c)
        elif unicodedata.category(c) == "Zs":
            out.append(" ")
        else:
            out.append(unicodedata.normalize("NFKC", c) if not unicodedata.combining(c) else c)
    text = unicodedata.normalize("NFC", "".join(out))
    if not any(c in _CYRILLIC or c in _GREEK_CAPITALS or c in _GREEK_SMALL for c in text):
        return text
    # small Greek letters are Latin only in a word that has other Latin (or disguised) letters
    word = bool(_LATIN.search(text)) or any(c in _CYRILLIC or c in _GREEK_CAPITALS for c in text)
    return "".join(_CYRILLIC.get(c) or _GREEK_CAPITALS.get(c) or (_GREEK_SMALL.get(c, c) if word else c) for c in text)


def canonical(value: str | None) -> str | None:
    """The value with its unstable segments in canonical form."""
    if not value or value.isascii() or not QUICK.search(value):
        return value
    parts, last = [], 0
    for m in _SEGMENT.finditer(value):
        parts += [value[last : m.start()], _canonical_segment(m.group())]
        last = m.end()
    return "".join([*parts, value[last:]])


def unstable_share(value: str) -> float:
    """Share of a value's characters that the quick check can't pass."""
    return len(QUICK.findall(value)) / max(len(value), 1)


@F.pandas_udf(T.StringType())
def canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(canonical, na_action="ignore")


def canonical_values(rows: DataFrame, fields: list[str], id_col: str = "item_id") -> DataFrame:
    """(id, field_name, value, canonical_value) for the values of fields that change."""
    long = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("v")).select("id", "v.*")
    # what is ASCII and common Han is stable; the rest is looked at by the exact quick check
    long = long.filter(F.col("value").rlike("[^\\x00-\\x7e\\u4e00-\\u9fff\\u3400-\\u4dbf（）【】：，。、；！？《》“”‘’]"))
    changed = long.withColumn("canonical_value", canonical_udf("value")).filter(F.col("canonical_value") != F.col("value"))
    return changed.filter(F.length(F.trim("canonical_value")) > 0)


def found(rows: DataFrame, fields: list[str], id_col: str = "item_id") -> DataFrame:
    return canonical_values(rows, fields, id_col).select("id", "field_name").distinct()
