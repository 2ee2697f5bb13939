"""What identifies a notice, a page or a file: keys over normal forms, hashed.

Normal forms need NFKC and form-style URLs, which Spark has no built-in for, so one Arrow function brings all texts
of an item to them at once; dates, buckets, types, seeds and hashes are built-in expressions. A seed joins its
parts by |, missing ones as -. All results are null-safe: a missing part never makes a key null.
"""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.functions.text import budget_bucket, compact_title, normal_url, plain_text

# Kinds, stages, and the parameters that name a page, first one first.
NOTICE_TYPES, ATTACHMENT_TYPES, STAGES = ("announcement", "change", "result"), ("notice_file", "bid_file", "other"), ("fetch", "parse", "persist")
LOCATORS = ("guid", "detail_id", "detailid", "id", "notice_id", "noticeid", "article_id", "articleid")

FORMS = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "party", "region", "source", "date_text", "amount", "detail_url", "locator")])


def locator(url: str | None) -> str | None:
    """What names a page: the first parameter of LOCATORS that its URL has, else the normal URL."""
    whole = normal_url(url, drop_tracking=True)
    if whole is None:
        return None
    asked = parse_qs(urlsplit(whole).query)
    said = (plain_text((asked.get(k) or asked.get(k.upper()) or [""])[0], lower=True) for k in LOCATORS)
    return next((v for v in said if v), whole)


@F.pandas_udf(FORMS)
def _forms_udf(title: pd.Series, purchaser: pd.Series, publisher: pd.Series, region: pd.Series, source: pd.Series, published: pd.Series, amount: pd.Series, url: pd.Series, detail_id: pd.Series) -> pd.DataFrame:
    rows = [
        (compact_title(t), compact_title(a) or compact_title(b), plain_text(r, lower=True), plain_text(s, lower=True), plain_text(d), plain_text(m), normal_url(u, drop_tracking=True), plain_text(i, lower=True) or locator(u))
        for t, a, b, r, s, d, m, u, i in zip(*(x.where(x.notna(), None) for x in (title, purchaser, publisher, region, source, published, amount, url, detail_id)))
    ]
    return pd.DataFrame(rows, columns=FORMS.names)


def said(column: str | Column) -> Column:
    """A text without blanks around it; null if nothing is left."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def one_of(column: str | Column, values: tuple, default: str) -> Column:
    """The value if it is one of some, else the default."""
    return F.when(said(column).isin(*values), said(column)).otherwise(default)


def moment(text: Column) -> Column:
    """The instant of a plain text in ISO form, with zone or as UTC, or in one of the ten dated forms; null if it is
    none or names no existing date. Fractions are cut off. Eight digits may lack the day's zero. A zone follows a time of
    day, after a fraction without a blank; after a bare hour or a comma it is less than a day."""
    zone = r"(?:Z|[+-]\d{2}:?\d{2})?"
    near = zone.replace(r"\d{2}", r"(?:[01]\d|2[0-3])", 1)
    shapes = (rf"\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}(?:\s?{near}|:\d{{2}}(?::\d{{2}})?\s?{zone}|:\d{{2}}:\d{{2}}(?:\.\d+{zone}|,\d+{near})))?", r"\d{4}([-/])\d{1,2}\1\d{1,2}(?: +\d{1,2}:\d{1,2}(?::\d{1,2})?)?", r"\d{8}|\d{4}(?:0[1-9]|1[0-2])[1-9]", r"\d{4}年\d{1,2}月\d{1,2}日(?: ?\d{1,2}点\d{1,2}分)?")
    parts = rf"^(\d{{4}})[-/年]?(\d{{1,2}})[-/月]?(\d{{1,2}})日?(?:[T ]*(\d{{1,2}})(?:[:点](\d{{1,2}}))?分?(?::(\d{{1,2}}))?(?:[.,]\d+)?)?\s?{zone}$"
    said_ = F.regexp_replace(text, parts, "$1-$2-$3 0$4:0$5:0$6")
    at = F.try_to_timestamp(F.when(text.rlike("^(?:" + "|".join(shapes) + ")$"), F.regexp_replace(said_, r"\b0(\d\d)\b", "$1")), F.lit("y-M-d H:m:s"))
    ends = F.regexp_extract(text, r"[+-]\d{2}:?\d{2}$", 0)
    offset = F.when((ends != "") & (F.length(text) > 12), (F.substring(ends, 2, 2).try_cast("int") * 3600 + F.substring(ends, -2, 2).try_cast("int") * 60) * F.when(ends.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.timestamp_seconds(F.unix_timestamp(at) - offset)


def day(text: Column) -> Column:
    """The UTC day of a plain text as YYYY-MM-DD: that of its instant, else of the first date in it. 24:00 in ISO form is
    the end of its day, thus the next one's 00:00."""
    shape = r"([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})"
    first = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, shape, 0), shape, "$1-$2-$3"), F.lit("y-M-d"))
    ends = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]24:00(?::00(?:\.0+)?)?(?:Z|[+-]\d{2}:?\d{2})?$")
    at = moment(F.when(ends, F.regexp_replace(text, "(?<=[T ])24:", "00:")).otherwise(text))
    # years of five digits come with a sign
    return F.ltrim(F.date_format(F.date_add(F.to_date(F.coalesce(at, first)), F.when(ends, 1).otherwise(0)), "yyyy-MM-dd"), F.lit("+"))


def seed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.nullif(p, F.lit("")), F.lit("-")) for p in parts)), 256)


def content_hash(given: Column, body: Column) -> Column:
    """The given hash, else that of the body without blanks around it, else null."""
    return F.coalesce(said(given), F.sha2(said(body), 256))


def with_keys(items: DataFrame) -> DataFrame:
    """The items with what identifies them: norm_title, norm_party, norm_region, norm_type, published_day, bucket,
    detail_url, locator, list_fingerprint, built_source_key, built_dedup_key, built_persistence_key, merge_strategy and
    identity_hash, and with dedup_key, source_duplicate_key, dedup_hash and content_hash filled where they were missing.
    Columns that the items lack count as null."""
    # of several columns the first that isn't empty counts, also if it is blank
    has = lambda *names: said(F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names if n in items.columns), F.lit(None).cast("string")))
    url, external = has("detail_page_url", "source_url", "url"), has("external_id", "notice_external_id")
    rows = items.withColumn("_f", _forms_udf(has("title"), has("purchaser"), has("issuer", "publisher"), has("region"), has("source_code"), has("published_at"), has("budget_amount"), url, external))
    f = lambda n: F.col(f"_f.{n}")
    rows = rows.withColumns({"published_day": day(f("date_text")), "bucket": budget_bucket("_f.amount"), "norm_type": one_of(has("notice_type"), NOTICE_TYPES, "announcement")})
    named = [f("title"), F.col("published_day"), f("party"), F.col("bucket"), f("region")]
    signals = sum(F.when(x.isNotNull(), 1).otherwise(0) for x in named[2:])
    whole, bare = seed(*named, f("locator")), seed(*named, F.lit(None).cast("string"))
    # without a locator the key of a source is that of persistence, which then has none either
    source_key = F.when(f("locator").isNotNull(), seed(f("source"), F.col("norm_type"), f("locator"))).otherwise(bare)
    strategy = F.when(external.isNotNull(), "external_id").when(f("detail_url").isNotNull(), "detail_url").when(f("title").isNotNull(), "title").when(has("dedup_hash", "notice_dedup_hash").isNotNull(), "provided").otherwise("fallback")
    named_by = F.coalesce(has("source_code"), F.lit("unknown_source"))
    by = lambda kind, value: F.sha2(F.concat(named_by, F.lit(f"|{kind}|"), value), 256)
    identity = F.when(external.isNotNull(), by("external_id", external)).when(f("detail_url").isNotNull(), by("detail_url", f("detail_url"))).when(f("title").isNotNull(), by("title", f("title"))).otherwise(has("dedup_hash", "notice_dedup_hash"))
    rows = rows.withColumns({
        "norm_title": f("title"), "norm_party": f("party"), "norm_region": f("region"), "detail_url": f("detail_url"), "locator": f("locator"),
        "list_fingerprint": seed(has("source_code"), f("title"), f("detail_url"), F.col("published_day"), F.col("norm_type"), f("region")),
        "built_source_key": source_key, "built_dedup_key": whole, "built_persistence_key": F.when(signals < 2, whole).otherwise(bare),
        "merge_strategy": strategy, "identity_hash": identity,
    }).drop("_f")
    return rows.withColumns({
        "dedup_key": F.coalesce(has("dedup_key"), F.col("built_persistence_key")), "source_duplicate_key": F.coalesce(has("source_duplicate_key"), F.col("built_source_key")),
        "dedup_hash": F.coalesce(has("dedup_hash", "notice_dedup_hash"), F.col("identity_hash")), "external_id": external, "content_hash": content_hash(has("content_hash", "raw_content_hash"), has("content_text")),
    })


def page_keys(pages: DataFrame) -> DataFrame:
    """Pages with normalized_url, url_hash and content_hash as they are stored."""
    from noticeforge.functions.text import detail_url_udf

    url = detail_url_udf(F.coalesce(said("normalized_url"), said("url")))
    return pages.withColumn("normalized_url", url).withColumns({"url_hash": F.sha2(F.col("normalized_url"), 256), "content_hash": content_hash(F.col("content_hash"), F.col("raw_body"))})


def file_keys(files: DataFrame) -> DataFrame:
    """Files with file_url in normal form and its url_hash."""
    from noticeforge.functions.text import detail_url_udf

    return files.withColumn("_u", detail_url_udf("file_url")).withColumns({"file_url": F.coalesce("_u", "file_url"), "url_hash": F.sha2(F.col("_u"), 256)}).drop("_u")
