"""Queries of identity and normal forms, and SQL written apart from them.

DuckDB has no NFKC. The SQL composes it from its NFC and a table of single compatibility characters, which is made
by rule from the character data; so it covers what occurs in these tables, not every text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import identity, text
from noticeforge.functions.text import TRACKING
from noticeforge.sources.tables import table


def _keyed(spark, sf: str) -> DataFrame:
    return identity.with_keys(table(spark, sf, "notice_item"))


def _of(*columns: str):
    return lambda spark, sf: _keyed(spark, sf).selectExpr("item_id", *columns)


def url_normalised(spark, sf: str) -> DataFrame:
    return table(spark, sf, "raw_document_item").select("raw_id", text.detail_url_udf("url").alias("detail_url"))


def page_keys(spark, sf: str) -> DataFrame:
    return identity.page_keys(table(spark, sf, "raw_document_item")).select("raw_id", "normalized_url", "url_hash", "content_hash")


def file_keys(spark, sf: str) -> DataFrame:
    return identity.file_keys(table(spark, sf, "tender_attachment_item")).select("att_id", "url_hash", identity.one_of("attachment_type", identity.ATTACHMENT_TYPES, "notice_file").alias("attachment_type"))


QUERIES = {
    "title_normalised": _of("norm_title"), "region_normalised": _of("norm_region"), "party_normalised": _of("norm_party"), "budget_bucket": _of("bucket"), "published_date": _of("published_day"),
    "detail_locator": _of("locator"), "item_keys": _of("list_fingerprint"), "source_key": _of("built_source_key"), "dedup_key": _of("built_dedup_key"), "persistence_key": _of("built_persistence_key"),
    "identity_priority": _of("merge_strategy", "identity_hash"), "item_normalised": _of("norm_type", "dedup_key", "source_duplicate_key", "dedup_hash", "external_id", "content_hash"),
    "url_normalised": url_normalised, "page_keys": page_keys, "file_keys": file_keys,
}

# ---- SQL

_SINGLE = [chr(c) for c in (*range(0xA0, 0x3400), *range(0xF900, 0xFB00), *range(0xFE10, 0xFE6F), *range(0xFF01, 0xFFEF)) if not unicodedata.combining(chr(c)) and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c) and n != "'"]
_SEVERAL = [chr(c) for c in (0x2026, *range(0x2100, 0x2180), *range(0x3380, 0x33E0)) if len(unicodedata.normalize("NFKC", chr(c))) > 1]


def nfkc(c: str) -> str:
    """NFKC of a column as far as single characters of these ranges go."""
    for x in _SEVERAL:
        c = f"replace({c}, '{x}', '{unicodedata.normalize('NFKC', x)}')"
    return f"nfc_normalize(translate({c}, '{''.join(_SINGLE)}', '{''.join(unicodedata.normalize('NFKC', x) for x in _SINGLE)}'))"


def _plain(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


_MARKS = ("，。；：（）【】“”‘’、－", ",.;:()[]\"\"'',-".replace("'", "''"))
_TIGHT = lambda c: f"nullif(regexp_replace(translate({_plain(f'lower({c})')}, '{_MARKS[0]}', '{_MARKS[1]}'), '\\s+', '', 'g'), '')"
_URL = """(CASE WHEN contains({u}, '?') THEN split_part({u}, '?', 2) ELSE '' END)"""
_NORMAL = f"""lower(regexp_extract(trim(u), '^([^:]+://[^/?#]+)', 1)) || CASE WHEN regexp_extract(trim(u), '^[^:]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim(u), '^[^:]+://[^/?#]+([^?#]*)', 1) END
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END"""
_KEPT = f"""list_filter(string_split(split_part(split_part(trim({{c}}), '#', 1), '?', 2), '&'), lambda x: x <> '' AND NOT lower(split_part(x, '=', 1)) IN ({", ".join(f"'{t}'" for t in sorted(TRACKING))}) AND NOT starts_with(lower(x), 'utm_'))"""


def _urls(column: str, source: str, key: str) -> str:
    return f"(SELECT {key}, CASE WHEN nullif(trim(u), '') IS NULL THEN NULL ELSE {_NORMAL} END AS url FROM (SELECT {key}, {column} AS u, {_KEPT.format(c=column)} AS kept FROM {source}) k)"


_FOUND = " ".join(f"WHEN regexp_extract(url, '[?&]{k}=([^&]+)', 1) <> '' THEN lower(regexp_extract(url, '[?&]{k}=([^&]+)', 1))" for k in identity.LOCATORS)
_NUMBER = "regexp_extract(replace(b, ',', ''), '-?[0-9]+([.][0-9]+)?', 0)"
# half away from zero, by digits
_STEPS = f"CAST(sign(v) * floor(abs(v) + CAST(0.5 AS DECIMAL(3, 1))) AS BIGINT) * 1000"
_ISO = "regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)? ?(Z|[+-][0-9]{2}:?[0-9]{2})?$')"
_ZONED = "CASE WHEN regexp_matches(d, '[+-][0-9]{2}:?[0-9]{2}$') AND length(d) > 16 THEN regexp_replace(d, '([+-][0-9]{2}):?([0-9]{2})$', '\\1:\\2') WHEN d LIKE '%Z' THEN d ELSE d || '+00:00' END"
_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y/%m/%d %H:%M:%S', '%Y/%m/%d %H:%M', '%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y年%m月%d日 %H点%M分', '%Y年%m月%d日%H点%M分', '%Y年%m月%d日']"
_SHAPE = "([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})"
_DAY = f"""CASE WHEN {_ISO} AND length(d) > 10 THEN strftime(try_cast({_ZONED} AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d')
    WHEN try_strptime(d, {_FORMATS}) IS NOT NULL THEN strftime(try_strptime(d, {_FORMATS}), '%Y-%m-%d')
    ELSE strftime(try_strptime(regexp_extract(d, '{_SHAPE}', 1) || '-' || regexp_extract(d, '{_SHAPE}', 2) || '-' || regexp_extract(d, '{_SHAPE}', 3), '%Y-%m-%d'), '%Y-%m-%d') END"""
_ITEM = f"""i AS (SELECT n.*, {_TIGHT(nfkc('title'))} AS t, {_TIGHT(nfkc('issuer'))} AS p, lower({_plain(nfkc('region'))}) AS r, lower({_plain(nfkc('source_code'))}) AS s, {_plain(nfkc('published_at'))} AS d, {_plain(nfkc('budget_amount'))} AS b,
    nullif(trim(regexp_replace(external_id, '\\s+', ' ', 'g')), '') AS ext, lower({_plain(nfkc('external_id'))}) AS ext_plain, w.url FROM notice_item n LEFT JOIN {_urls('detail_page_url', 'notice_item', 'item_id')} w USING (item_id)),
    v AS (SELECT i.*, {_DAY} AS day, CASE WHEN {_NUMBER} = '' THEN NULL ELSE CAST({_NUMBER} AS DECIMAL(24, 6)) * CASE WHEN contains(b, '万') THEN 10 ELSE CAST(0.001 AS DECIMAL(6, 3)) END END AS v,
    CASE WHEN lower(trim(notice_type)) = trim(notice_type) AND trim(notice_type) IN ('announcement', 'change', 'result') THEN trim(notice_type) ELSE 'announcement' END AS kind, coalesce(ext_plain, CASE {_FOUND} ELSE url END) AS loc FROM i),
    x AS (SELECT v.*, CAST({_STEPS} AS VARCHAR(40)) AS bucket FROM v),
    z AS (SELECT x.*, coalesce(t, '-') || '|' || coalesce(day, '-') || '|' || coalesce(p, '-') || '|' || coalesce(bucket, '-') || '|' || coalesce(r, '-') || '|' AS head, (CASE WHEN p IS NULL THEN 0 ELSE 1 END) + (CASE WHEN bucket IS NULL THEN 0 ELSE 1 END) + (CASE WHEN r IS NULL THEN 0 ELSE 1 END) AS signals FROM x)"""
_SOURCE = "CASE WHEN loc IS NULL THEN sha256(head || '-') ELSE sha256(coalesce(s, '-') || '|' || kind || '|' || loc) END"
_PERSIST = "CASE WHEN signals < 2 THEN sha256(head || coalesce(loc, '-')) ELSE sha256(head || '-') END"
_HASH = "CASE WHEN ext IS NOT NULL THEN sha256(trim(source_code) || '|external_id|' || ext) WHEN url IS NOT NULL THEN sha256(trim(source_code) || '|detail_url|' || url) WHEN t IS NOT NULL THEN sha256(trim(source_code) || '|title|' || t) ELSE nullif(trim(dedup_hash), '') END"
_BARE = lambda c: f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


def _select(what: str) -> str:
    return f"WITH {_ITEM} SELECT item_id, {what} FROM z"


ORACLES = {
    "title_normalised": _select("t AS norm_title"), "region_normalised": _select("r AS norm_region"), "party_normalised": _select("p AS norm_party"), "budget_bucket": _select("bucket"), "published_date": _select("day AS published_day"),
    "detail_locator": _select("loc AS locator"), "source_key": _select(f"{_SOURCE} AS built_source_key"), "dedup_key": _select("sha256(head || coalesce(loc, '-')) AS built_dedup_key"), "persistence_key": _select(f"{_PERSIST} AS built_persistence_key"),
    "item_keys": _select("sha256(coalesce(trim(source_code), '-') || '|' || coalesce(t, '-') || '|' || coalesce(url, '-') || '|' || coalesce(day, '-') || '|' || kind || '|' || coalesce(r, '-')) AS list_fingerprint"),
    "identity_priority": _select(f"CASE WHEN ext IS NOT NULL THEN 'external_id' WHEN url IS NOT NULL THEN 'detail_url' WHEN t IS NOT NULL THEN 'title' WHEN {_BARE('dedup_hash')} IS NOT NULL THEN 'provided' ELSE 'fallback' END AS merge_strategy, {_HASH} AS identity_hash"),
    "item_normalised": _select(f"kind AS norm_type, coalesce({_BARE('dedup_key')}, {_PERSIST}) AS dedup_key, coalesce({_BARE('source_duplicate_key')}, {_SOURCE}) AS source_duplicate_key, coalesce({_BARE('dedup_hash')}, {_HASH}) AS dedup_hash, ext AS external_id, coalesce({_BARE('raw_content_hash')}, sha256({_BARE('content_text')})) AS content_hash"),
    "url_normalised": f"SELECT raw_id, url AS detail_url FROM {_urls('url', 'raw_document_item', 'raw_id')} q",
    "page_keys": f"SELECT d.raw_id, q.url AS normalized_url, sha256(q.url) AS url_hash, coalesce({_BARE('d.content_hash')}, sha256({_BARE('d.raw_body')})) AS content_hash FROM raw_document_item d JOIN {_urls('coalesce(normalized_url, url)', 'raw_document_item', 'raw_id')} q USING (raw_id)",
    "file_keys": f"SELECT d.att_id, sha256(q.url) AS url_hash, CASE WHEN trim(d.attachment_type) IN ('notice_file', 'bid_file', 'other') THEN trim(d.attachment_type) ELSE 'notice_file' END AS attachment_type FROM tender_attachment_item d JOIN {_urls('file_url', 'tender_attachment_item', 'att_id')} q USING (att_id)",
}
