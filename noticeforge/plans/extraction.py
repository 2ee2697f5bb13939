"""Queries that take fields out of pages, JSON bodies and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.functions import html, identity, text
from noticeforge.plans.identitybook import _plain, nfkc
from noticeforge.sources.tables import table

_LIST = "struct<code:int,data:struct<current:int,records:array<struct<title:string,titleShow:string,publishTime:string,url:string,detailUrl:string>>>>"


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Title, deadline, budget and number of files of each HTML page."""
    pages = table(spark, sf, "raw_document_item").filter(F.col("document_type") == "html")
    return pages.select("raw_id", html.page_udf("raw_body", "url").alias("p")).select("raw_id", "p.title", "p.deadline", "p.budget", F.size("p.attachments").alias("n_files"), F.size("p.fields").alias("n_fields"))


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files pages link to."""
    pages = table(spark, sf, "raw_document_item").filter(F.col("document_type") == "html")
    return pages.select("raw_id", F.explode(html.page_udf("raw_body", "url")["attachments"]).alias("f")).select("raw_id", "f.name", "f.url")


def list_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of JSON list bodies; without a title there is none."""
    bodies = table(spark, sf, "raw_document_item").filter(F.col("document_type") == "json")
    r = bodies.select("raw_id", F.posexplode(F.from_json("raw_body", _LIST)["data"]["records"]).alias("at", "r"))
    return r.select("raw_id", "at", F.coalesce("r.title", "r.titleShow").alias("title"), F.col("r.publishTime").alias("published")).filter(F.length(F.trim("title")) > 0)


# Names that list services give the fields of a record, the first that says something counts.
ALIASES = {
    "title": ("title", "titleShow"), "url": ("url", "detailUrl", "linkUrl"), "published": ("publishTime", "publishedAt", "publishDate"), "province": ("provinceText", "province"), "platform": ("transactionSourcesPlatformText", "sourcePlatform", "platformName"),
    "issuer": ("issuer", "publisher"), "info": ("informationTypeText", "infoType", "businessTypeText"), "own_id": ("id", "infoId", "infoID", "noticeId", "noticeID", "dealId", "dealID", "guid", "uuid"),
}


def list_identities(pages: DataFrame) -> DataFrame:
    """Records of JSON lists with what identifies them: (raw_id, at, the fields of ALIASES, detail_url, day, subject, kind,
    source_key, fingerprint, content_hash). Without a title there is none; a record without a page is known by where
    and when it was published. pages: raw_id, source_code, url, raw_body."""
    r = pages.select("raw_id", F.coalesce("source_code", F.lit("unknown_source")).alias("source_code"), F.col("url").alias("base"), F.posexplode(F.from_json("raw_body", "struct<data:struct<records:array<map<string,string>>>>")["data"]["records"]).alias("at", "r"))
    r = r.select("raw_id", "at", "source_code", "base", "r", *(F.coalesce(*(identity.said(F.element_at("r", k)) for k in names)).alias(f) for f, names in ALIASES.items())).filter(F.col("title").isNotNull())
    r = r.withColumn("detail_url", text.detail_url_udf(text.absolute_url_udf("base", "url"))).withColumns({"issuer": F.coalesce("issuer", "platform"), "day": identity.day(text.plain_text_udf("published")), "subject": text.subject_title_udf("title"), "kind": html.kind_column(F.concat_ws(" ", "title", "info"), "lists")})
    folded = lambda c: F.coalesce(F.lower(text.plain_text_udf(c)), F.lit("-"))
    where = F.concat_ws("|", "source_code", folded("province"), folded("platform"), F.coalesce("subject", F.lit("-")), F.coalesce("day", F.lit("-")))
    key = lambda kind: F.sha2(F.when(F.col("detail_url").isNotNull(), F.concat_ws("|", "source_code", F.lit(kind), "detail_url")).otherwise(where), 256)
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries("r")))
    return r.select("raw_id", "at", *(f for f in ALIASES if f not in ("url", "info")), "detail_url", "day", "subject", "kind", key("detail_url").alias("source_key"), key("fingerprint").alias("fingerprint"), text.canonical_json_udf(F.to_json(sorted_map)).alias("content_hash"))


def list_record_keys(spark: SparkSession, sf: str) -> DataFrame:
    found = list_identities(table(spark, sf, "raw_document_item").filter(F.col("document_type") == "json"))
    return found.select("raw_id", "at", "day", "subject", "kind", "source_key", "fingerprint", "content_hash")


def title_subject(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notice_item").select("item_id", text.subject_title_udf("title").alias("subject"))


def json_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "notice_version_item").select("snap_id", text.canonical_json_udf("structured_data").alias("json_hash"))


def page_notices(spark: SparkSession, sf: str) -> DataFrame:
    """What detail pages say of their notice: kind, buyer, place, code and the length of the body."""
    pages = table(spark, sf, "raw_document_item").filter(F.col("document_type") == "html")
    return pages.select("raw_id", html.page_udf("raw_body", "url").alias("p")).select("raw_id", "p.title", "p.notice_type", "p.external_id", "p.project_code", "p.issuer", "p.region", F.length("p.text").alias("n_chars"), F.length(F.substring("p.text", 1, html.PREVIEW)).alias("n_preview"))


def page_list_items(spark: SparkSession, sf: str) -> DataFrame:
    """The notices that HTML list pages link to."""
    pages = table(spark, sf, "raw_document_item").filter((F.col("document_type") == "html") & (F.get_json_object("extra_meta", "$.role") == "list"))
    return pages.select("raw_id", F.posexplode(html.list_items_udf("/d/")("raw_body", "url")).alias("at", "x")).select("raw_id", "at", "x.*")


def page_paging(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "raw_document_item").filter((F.col("document_type") == "html") & (F.get_json_object("extra_meta", "$.role") == "list"))
    return pages.select("raw_id", html.paging_udf("raw_body").alias("p")).select("raw_id", "p.*")


def json_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Which bodies are JSON, and how many have enough text not to be fetched again."""
    d = table(spark, sf, "raw_document_item").withColumn("json", html.is_json(F.col("raw_body")))
    return d.select("raw_id", F.col("json").cast("int").alias("json"), F.when(html.rendered(F.col("raw_body"), F.lit("")) != "", 1).otherwise(0).alias("enough"))


QUERIES = {"page_fields": page_fields, "page_files": page_files, "page_notices": page_notices, "page_list_items": page_list_items, "page_paging": page_paging, "json_responses": json_responses, "list_records": list_records, "list_record_keys": list_record_keys, "title_subject": title_subject, "json_hash": json_hash}
# the closing words, taken off as often as a title may have them
_ENDED = _plain(nfkc("title"))
for _ in range(5):
    _ENDED = f"trim(regexp_replace({_ENDED}, '(?:{text._SIGNS}|\\s)*(?:{text._BUSINESS})?(?:公告|公示|通知|信息)\\s*$', ''))"
ORACLES = {
    "list_records": "SELECT raw_id, CAST(i AS INTEGER) AS at, json_extract_string(r, '$.title') AS title, json_extract_string(r, '$.publishTime') AS published FROM (SELECT raw_id, unnest(json_extract(raw_body, '$.data.records[*]')) AS r, generate_subscripts(json_extract(raw_body, '$.data.records[*]'), 1) - 1 AS i FROM raw_document_item WHERE document_type = 'json') WHERE length(trim(json_extract_string(r, '$.title'))) > 0",
    "list_record_keys": f"""WITH r AS (SELECT raw_id, source_code, generate_subscripts(json_extract(raw_body, '$.data.records[*]'), 1) - 1 AS i, unnest(json_extract(raw_body, '$.data.records[*]')) AS r FROM raw_document_item WHERE document_type = 'json'),
        x AS (SELECT raw_id, CAST(i AS INTEGER) AS "at", source_code, trim(json_extract_string(r, '$.title')) AS title, trim(json_extract_string(r, '$.publishTime')) AS day FROM r),
        y AS (SELECT x.*, nullif(lower(replace(regexp_replace({_ENDED}, '(?:{text._SIGNS}*(?:{text._BUSINESS}))*{text._SIGNS}*$', ''), ' ', '')), '') AS subject FROM x WHERE title <> '')
        SELECT raw_id, "at", day, subject, CASE WHEN regexp_matches(title, '更正|变更|澄清|延期|终止|废标|流标') THEN 'change' WHEN regexp_matches(title, '中标|成交|结果|合同') THEN 'result' ELSE 'announcement' END AS kind,
        sha256(source_code || '|-|-|' || coalesce(subject, '-') || '|' || coalesce(day, '-')) AS source_key, sha256(source_code || '|-|-|' || coalesce(subject, '-') || '|' || coalesce(day, '-')) AS fingerprint, sha256('{{"publishTime":"' || day || '","title":"' || title || '"}}') AS content_hash FROM y""",
    "title_subject": f"SELECT item_id, nullif(lower(replace(regexp_replace({_ENDED}, '(?:{text._SIGNS}*(?:{text._BUSINESS}))*{text._SIGNS}*$', ''), ' ', '')), '') AS subject FROM notice_item",
    "json_responses": "SELECT raw_id, CASE WHEN json_valid(raw_body) AND regexp_matches(raw_body, '^\\s*[{\\[]') THEN 1 ELSE 0 END AS json, CASE WHEN length(trim(raw_body)) >= 120 THEN 1 ELSE 0 END AS enough FROM raw_document_item",
}
