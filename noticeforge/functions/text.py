"""Normal forms of texts, URLs and typed values: built-in expressions, and Arrow functions where Spark has none."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from decimal import Decimal
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track.
TRACKING = {"_", "_t", "_ts", "from", "rand", "random", "ref", "referer", "sessionid", "sid", "spm", "timestamp", "track", "tracking"}
# Words that end a title without naming its subject, signs before them, and marks brought to ASCII.
_BUSINESS = "采购|招标|竞争性磋商|竞争性谈判|询价|中标|成交|结果|更正|澄清|终止|废标|流标"
_SIGNS = r"[ \-—_:：,，。；;·]"
_WIDE_MARKS = str.maketrans("，。；：（）【】“”‘’、－", ",.;:()[]\"\"'',-")
_TITLE_END = re.compile(rf"(?:{_SIGNS}|\s)*(?:{_BUSINESS})?(?:公告|公示|通知|信息)\s*$")
_TITLE_TAIL = re.compile(rf"(?:{_SIGNS}*(?:{_BUSINESS}))*{_SIGNS}*$")


def plain_text(value: str | None, lower: bool = False) -> str | None:
    """Stripped, NFKC, runs of blanks as one; null if nothing is left."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value)).strip() if value else ""
    return (text.lower() if lower else text) or None


def compact_title(value: str | None) -> str | None:
    """plain_text in lower case, marks in ASCII, no blanks."""
    text = plain_text(value, lower=True)
    return (re.sub(r"\s+", "", text.translate(_WIDE_MARKS)) or None) if text else None


def subject_title(value: str | None) -> str | None:
    """A title without the words that end it: first closing words with the business word before them, as often as
    there are any, then business words and signs that are left at the end. No blanks, lower case."""
    text = plain_text(value) or ""
    while (shorter := _TITLE_END.sub("", text).strip()) != text:
        text = shorter
    return _TITLE_TAIL.sub("", text).replace(" ", "").lower() or None


def normal_url(value: str | None, drop_tracking: bool = False) -> str | None:
    """Scheme and host in lower case, parameters sorted and encoded alike, no fragment; blank values stay."""
    if not value or not value.strip():
        return None
    try:
        u = urlsplit(value.strip())
        pairs = parse_qsl(u.query, keep_blank_values=True)
    except ValueError:
        return None
    if drop_tracking:
        pairs = [(k, v) for k, v in pairs if k.lower() not in TRACKING and not k.lower().startswith("utm_")]
    return urlunsplit((u.scheme.lower(), u.netloc.lower(), u.path or "/", urlencode(sorted(pairs)), ""))


def absolute_url(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href) if href else None
    except ValueError:
        return None


def canonical_json_hash(value: str | None) -> str | None:
    """SHA-256 of a JSON value with keys sorted and no blanks; null if it isn't JSON."""
    try:
        data = json.loads(value) if value else None
    except ValueError:
        return None
    return None if data is None else hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _arrow(function, **fixed):
    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v, **fixed) if v is not None else None)

    return apply


plain_text_udf, compact_title_udf, subject_title_udf = _arrow(plain_text), _arrow(compact_title), _arrow(subject_title)
normal_url_udf, detail_url_udf, canonical_json_udf = _arrow(normal_url), _arrow(normal_url, drop_tracking=True), _arrow(canonical_json_hash)


@F.pandas_udf(T.StringType())
def absolute_url_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([absolute_url(b, h) for b, h in zip(base, href)], dtype=object)


def seed_hash(*parts: Column) -> Column:
    """SHA-256 of parts joined by |, missing ones as -."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.nullif(F.trim(p.cast("string")), F.lit("")), F.lit("-")) for p in parts)), 256)


def budget_bucket(column: str) -> Column:
    """An amount in yuan rounded half up to whole thousands, as text; 万 counts ten thousand."""
    text = F.regexp_replace(F.translate(F.col(column), "０１２３４５６７８９．，－", "0123456789.,-"), ",", "")
    # thousands by exact factors, so that nothing but the last step rounds
    thousands = F.regexp_extract(text, r"-?\d+(\.\d+)?", 0).try_cast("decimal(28,8)") * F.when(text.contains("万"), Decimal("10")).otherwise(Decimal("0.001"))
    return (F.round(thousands).cast("decimal(24,0)") * 1000).cast("string")


def typed_amount(column: str) -> Column:
    """The first amount of a text as decimal(18,2), in any width; 万, 亿, k and m count, marks of thousands don't."""
    x = F.lower(F.regexp_replace(F.translate(F.col(column), "０１２３４５６７８９．，－　", "0123456789.,- "), r"(?U)[\s\p{Cf}]+", ""))
    number = F.regexp_extract(x, r"-?\d[\d.,]*", 0)
    digits = F.regexp_replace(number, r"[.,]+$", "")
    points = digits.rlike(r"^-?\d{1,3}(\.\d{3})+,\d{1,2}$") | digits.rlike(r"^-?\d{1,3}(\.\d{3}){2,}$") | (digits.rlike(r"^-?\d{1,3}(\.\d{3})+$") & x.rlike("eur|€"))
    comma = points | digits.rlike(r"^-?\d+,\d{1,2}$")
    plain = F.when(comma, F.translate(digits, ",.", ".")).otherwise(F.translate(digits, ",", ""))
    unit = F.when(x.contains("亿"), 100_000_000).when(x.contains("万"), 10_000).when(x.rlike(r"\dk\b"), 1_000).when(x.rlike(r"\d(m|mn|million)\b"), 1_000_000).otherwise(1)
    return (plain.try_cast("decimal(24,6)") * unit).try_cast("decimal(18,2)")


def k_v_map(column: str) -> Column:
    """'a=1; b=2' as a map; of equal keys the later counts."""
    entries = F.filter(F.transform(F.split(column, ";"), lambda e: F.struct(F.trim(F.split(e, "=", 2)[0]).alias("k"), F.trim(F.get(F.split(e, "=", 2), F.lit(1))).alias("v"))), lambda e: e["v"].isNotNull() & (e["k"] != ""))
    later = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])) == 0)
    return F.map_from_entries(later)


def register(spark) -> None:
    """Makes the Arrow functions callable from SQL."""
    for name, f in {"plain_text": plain_text_udf, "compact_title": compact_title_udf, "subject_title": subject_title_udf, "normal_url": normal_url_udf, "detail_url": detail_url_udf, "canonical_json_hash": canonical_json_udf}.items():
        spark.udf.register(name, f)
