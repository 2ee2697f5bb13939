"""Queries of what writing the items does: resolved notices, versions, counters of jobs, pages and new sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import identity, text
from noticeforge.operators import crawl, upsert
from noticeforge.plans import checks, reportbook, sqlbook
from noticeforge.plans.identitybook import _TIGHT, _plain, nfkc
from noticeforge.plans.reports import Tables, current_versions, jobs
from noticeforge.sources.tables import table

#: Codes that sources were known by before.
ALIASES = {"2": "ggzy_gov_cn_deal", "ggzy_gov_cn": "ggzy_gov_cn_deal"}


def _written(spark, sf: str) -> DataFrame:
    return upsert.write_items(upsert.item_stream(table(spark, sf, "notice_item"), table(spark, sf, "notice_version_item")))


def notice_resolution(spark, sf: str) -> DataFrame:
    """What each notice or version item did, and to which notice."""
    return _written(spark, sf).filter("what = 'effect'").select("source_code", "seq", "kind", "notice_seq", "outcome")


def notice_merged(spark, sf: str) -> DataFrame:
    """The notices after all items."""
    return _written(spark, sf).filter("what = 'notice'").select("source_code", "notice_seq", "external_id", "dedup_hash", "title", "notice_type", "issuer", "region", "budget_amount", "published_us", "first_published_us", "latest_published_us", "deadline_us")


def notice_version_state(spark, sf: str) -> DataFrame:
    """The versions after all items; of each notice at most one is current."""
    return _written(spark, sf).filter("what = 'version'").select("source_code", "notice_seq", "version_no", "content_hash", "is_current")


def page_upsert(spark, sf: str) -> DataFrame:
    pages = upsert.page_effects(table(spark, sf, "raw_document_item"))
    return pages.select("raw_id", F.col("is_duplicate_url").cast("int").alias("is_duplicate_url"), F.col("is_duplicate_content").cast("int").alias("is_duplicate_content"))


def job_counters(spark, sf: str) -> DataFrame:
    """What pages add to the counters of their jobs."""
    names = ("pages_fetched", "documents_saved", "deduplicated_count", "list_items_seen", "list_items_unique", "list_items_source_duplicates_skipped", "detail_pages_fetched", "records_inserted", "records_updated")
    return upsert.page_effects(table(spark, sf, "raw_document_item")).filter(F.col("crawl_job_id").isNotNull()).groupBy("crawl_job_id").agg(*(F.sum(n).alias(n) for n in names))


def job_counters_items(spark, sf: str) -> DataFrame:
    """What notice and version items add to the counters of their jobs."""
    return upsert.job_counters(_written(spark, sf))


def attachment_links(t: Tables) -> DataFrame:
    """(source_site_id, url_hash, attachment_id, file_name, version_id, raw_document_id, downloaded_us) of files by URL: the last
    delivery counts, but a time of download stays once known. A file belongs to the version it names, else to the
    one that is current, and to the page of its URL."""
    a = t["tender_attachment"].filter(F.col("url_hash").isNotNull())
    last = a.groupBy("source_site_id", "url_hash").agg(F.max_by(F.struct(F.col("id").alias("attachment_id"), "notice_id", "file_name", F.trim("notice_version_no").try_cast("int").alias("version_no")), "id").alias("x"), F.max_by(F.unix_micros("downloaded_at"), F.when(F.col("downloaded_at").isNotNull(), F.col("id"))).alias("downloaded_us")).select("source_site_id", "url_hash", "x.*", "downloaded_us")
    named = t["notice_version"].groupBy("notice_id", "version_no").agg(F.min("id").alias("named_id"))
    current = current_versions(t).select("notice_id", F.col("version_id").alias("current_id"))
    pages = t["raw_document"].filter(F.col("url_hash").isNotNull()).groupBy("source_site_id", "url_hash").agg(F.min("id").alias("raw_document_id"))
    rows = last.join(named, ["notice_id", "version_no"], "left").join(current, "notice_id", "left").join(pages, ["source_site_id", "url_hash"], "left")
    return rows.select("source_site_id", "url_hash", "attachment_id", "file_name", F.coalesce("named_id", "current_id").alias("version_id"), "raw_document_id", "downloaded_us")


def attachment_link(spark, sf: str) -> DataFrame:
    return attachment_links(Tables(spark, sf))


def constraint_violations(spark, sf: str) -> DataFrame:
    """(relation, rule, n): how many rows or groups break a rule that the surveyed tables enforce. None is missing, rules
    that hold have 0."""
    return checks.violations(Tables(spark, sf))


def source_lookup(spark, sf: str) -> DataFrame:
    """The source that each code in the items means, former codes included; null where it has none."""
    names = reduce(DataFrame.unionByName, (table(spark, sf, t).select("source_code") for t in ("notice_item", "raw_document_item"))).distinct().unionByName(spark.createDataFrame([("2",), ("ggzy_gov_cn",), ("zb_01 ",), ("nowhere",)], "source_code string"))
    sites = table(spark, sf, "source_site").select("id", "code")
    former = F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), F.col("source_code"))
    exact = names.join(sites, names.source_code == sites.code, "left").select("source_code", "id")
    return exact.withColumn("former", former).select("source_code", F.col("id").alias("source_site_id"), "former")


def sources_created(spark, sf: str) -> DataFrame:
    """Sources that items name and the table lacks, as they would be created: (code, name, base_url)."""
    items = table(spark, sf, "notice_item").select(F.concat(F.lit("new_"), F.substring("source_code", 1, 3)).alias("code"), F.coalesce(identity.said("source_site_name"), identity.said("source_code")).alias("name"), identity.said("source_site_url").alias("u"), identity.said("detail_page_url").alias("d"), "item_id")
    items = items.unionByName(table(spark, sf, "notice_item").select(F.col("source_code").alias("code"), F.col("source_code").alias("name"), F.lit(None).cast("string").alias("u"), F.lit(None).cast("string").alias("d"), "item_id"))
    base = lambda c: F.nullif(F.regexp_extract(c, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
    lacking = items.join(table(spark, sf, "source_site").select("code"), "code", "left_anti")
    return lacking.groupBy("code").agg(F.min_by("name", "item_id").alias("name"), F.min_by(F.coalesce(base("u"), base("d"), F.lit("https://example.com")), "item_id").alias("base_url"))


def similar(notices: DataFrame) -> DataFrame:
    """(notice_id, matched_id): the first notice before each of the same source, title and day that agrees in its one
    signal (issuer, region, bucket) or in two of its signals. Each notice is looked up by its signals and pairs of
    signals, of each of which only the first notice is kept, so no pairs within a title are formed."""
    n = notices.withColumns({"t": text.compact_title_udf("title"), "d": F.to_date("published_at"), "p": text.compact_title_udf("issuer"), "r": F.lower(text.plain_text_udf("region")), "b": (F.round(F.col("budget_amount").cast("decimal(24,2)") / 1000) * 1000).cast("bigint").cast("string")})
    n = n.filter(F.col("t").isNotNull() & F.col("d").isNotNull())
    key = lambda *cs: F.when(F.concat(*cs).isNotNull(), F.xxhash64(F.lit("".join(cs)), "source_site_id", "t", "d", *cs))
    one, two = F.array_compact(F.array(*(key(c) for c in "prb"))), F.array_compact(F.array(key("p", "r"), key("p", "b"), key("r", "b")))
    n = n.select("id", one.alias("one"), two.alias("two"))
    first = n.select("id", F.explode(F.concat("one", "two")).alias("k")).groupBy("k").agg(F.min("id").alias("matched_id"))
    asked = n.select("id", F.explode(F.when(F.size("one") == 1, F.col("one")).otherwise(F.col("two"))).alias("k"))
    return asked.join(first, "k").filter("matched_id < id").groupBy(F.col("id").alias("notice_id")).agg(F.min("matched_id").alias("matched_id"))


def similarity_match(spark, sf: str) -> DataFrame:
    return similar(Tables(spark, sf)["tender_notice"])


def raw_doc_upsert(spark, sf: str) -> DataFrame:
    """Pages whose URL, and whose content, their source had before: against the first of each, no windows."""
    d = Tables(spark, sf)["raw_document"]
    first = lambda c, name: d.filter(F.col(c).isNotNull()).groupBy("source_site_id", c).agg(F.min("id").alias(name))
    rows = d.join(first("url_hash", "u"), ["source_site_id", "url_hash"], "left").join(first("content_hash", "c"), ["source_site_id", "content_hash"], "left")
    return rows.select("id", "source_site_id", "url_hash", F.coalesce((F.col("u") < F.col("id")).cast("int"), F.lit(0)).alias("is_duplicate_url"), F.coalesce((F.col("c") < F.col("id")).cast("int"), F.lit(0)).alias("is_duplicate_content"))


def job_mutex_demote(spark, sf: str) -> DataFrame:
    j = Tables(spark, sf)["crawl_job"]
    active = crawl.demoted(j.filter(F.col("status").isin("pending", "running")))
    return active.select("id", "source_site_id", F.col("status").alias("new_status"))


def job_retry_links(spark, sf: str) -> DataFrame:
    return jobs(Tables(spark, sf)).select("id", "retry_of_status", "retried_by_id", "retried_by_status")


QUERIES = {"similarity_match": similarity_match, "raw_doc_upsert": raw_doc_upsert, "job_mutex_demote": job_mutex_demote, "attachment_link": attachment_link, "constraint_violations": constraint_violations, "job_retry_links": job_retry_links, "notice_resolution": notice_resolution, "notice_merged": notice_merged, "notice_version_state": notice_version_state, "page_upsert": page_upsert, "job_counters": job_counters, "job_counters_items": job_counters_items, "source_lookup": source_lookup, "sources_created": sources_created}

_PAGES = """p AS (SELECT *, coalesce(source_code, 'unknown_source') AS src FROM raw_document_item WHERE url_hash IS NOT NULL),
    f AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.url_hash = p.url_hash AND q.raw_id < p.raw_id) THEN 1 ELSE 0 END AS du,
    CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.content_hash = p.content_hash AND q.url_hash <> p.url_hash AND q.raw_id < p.raw_id) THEN 1 ELSE 0 END AS dc, lower(coalesce(json_extract_string(extra_meta, '$.role'), '')) AS role FROM p)"""
_META = lambda n: f"CAST(sum(CASE WHEN role = 'list' THEN greatest(coalesce(try_cast(trim(json_extract_string(extra_meta, '$.{n}')) AS INTEGER), 0), 0) ELSE 0 END) AS BIGINT)"
_ONE = "(CASE WHEN a.{c} = b.{c} THEN 1 ELSE 0 END)"
_HAS = "(CASE WHEN a.{c} IS NULL THEN 0 ELSE 1 END)"
_SUM = lambda x: " + ".join(x.format(c=c) for c in "prb")
SQL = {
    "similarity_match": f"""WITH x AS (SELECT id, source_site_id, {_TIGHT(nfkc('title'))} AS t, CAST(published_at AS DATE) AS d, {_TIGHT(nfkc('issuer'))} AS p, lower({_plain(nfkc('region'))}) AS r, CAST(floor(budget_amount / 1000 + CAST(0.5 AS DECIMAL(2, 1))) AS BIGINT) AS b FROM tender_notice)
        SELECT a.id AS notice_id, min(b.id) AS matched_id FROM x a JOIN x b ON a.source_site_id = b.source_site_id AND a.t = b.t AND a.d = b.d AND b.id < a.id WHERE {_SUM(_HAS)} > 0 AND {_SUM(_ONE)} >= least({_SUM(_HAS)}, 2) GROUP BY a.id""",
    "raw_doc_upsert": """SELECT id, source_site_id, url_hash, CASE WHEN url_hash IS NOT NULL AND row_number() OVER (PARTITION BY source_site_id, url_hash ORDER BY id) > 1 THEN 1 ELSE 0 END AS is_duplicate_url,
        CASE WHEN content_hash IS NOT NULL AND row_number() OVER (PARTITION BY source_site_id, content_hash ORDER BY id) > 1 THEN 1 ELSE 0 END AS is_duplicate_content FROM raw_document""",
    "job_mutex_demote": "SELECT id, source_site_id, CASE WHEN k = 1 THEN status ELSE 'failed' END AS new_status FROM (SELECT j.*, row_number() OVER (PARTITION BY source_site_id ORDER BY id DESC) AS k FROM crawl_job j WHERE status IN ('pending', 'running'))",
    "attachment_link": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY source_site_id, url_hash ORDER BY id DESC) AS k FROM tender_attachment WHERE url_hash IS NOT NULL)
        SELECT a.source_site_id, a.url_hash, a.id AS attachment_id, a.file_name, coalesce((SELECT min(v.id) FROM notice_version v WHERE v.notice_id = a.notice_id AND v.version_no = try_cast(trim(a.notice_version_no) AS INTEGER)),
        (SELECT v.id FROM notice_version v WHERE v.notice_id = a.notice_id ORDER BY v.is_current DESC, v.version_no DESC, v.id DESC LIMIT 1)) AS version_id, (SELECT min(d.id) FROM raw_document d WHERE d.source_site_id = a.source_site_id AND d.url_hash = a.url_hash) AS raw_document_id,
        (SELECT epoch_us(b.downloaded_at) FROM tender_attachment b WHERE b.source_site_id = a.source_site_id AND b.url_hash = a.url_hash AND b.downloaded_at IS NOT NULL ORDER BY b.id DESC LIMIT 1) AS downloaded_us FROM a WHERE k = 1""",
    "constraint_violations": """SELECT 'crawl_job' AS relation, 'one active a source' AS rule, (SELECT count(*) FROM (SELECT source_site_id FROM crawl_job WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1)) AS n
        UNION ALL SELECT 'crawl_job', 'retried once', (SELECT count(*) FROM (SELECT retry_of_job_id FROM crawl_job WHERE retry_of_job_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'crawl_job', 'status', (SELECT count(*) FROM crawl_job WHERE NOT status IN ('pending', 'running', 'succeeded', 'failed', 'partial'))
        UNION ALL SELECT 'crawl_job', 'job_type', (SELECT count(*) FROM crawl_job WHERE NOT job_type IN ('scheduled', 'manual', 'backfill', 'manual_retry')) UNION ALL SELECT 'source', 'code', (SELECT count(*) FROM (SELECT code FROM source GROUP BY 1 HAVING count(*) > 1))
        UNION ALL SELECT 'raw_document', 'url of a source', (SELECT count(*) FROM (SELECT source_site_id, url_hash FROM raw_document WHERE url_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'raw_document', 'document_type', (SELECT count(*) FROM raw_document WHERE NOT document_type IN ('html', 'pdf', 'json', 'other'))
        UNION ALL SELECT 'tender_notice', 'external id of a source', (SELECT count(*) FROM (SELECT source_site_id, external_id FROM tender_notice WHERE external_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'tender_notice', 'hash of a source', (SELECT count(*) FROM (SELECT source_site_id, dedup_hash FROM tender_notice WHERE dedup_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1))
        UNION ALL SELECT 'notice_version', 'number of a notice', (SELECT count(*) FROM (SELECT notice_id, version_no FROM notice_version GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'notice_version', 'content of a notice', (SELECT count(*) FROM (SELECT notice_id, content_hash FROM notice_version WHERE content_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1))
        UNION ALL SELECT 'tender_attachment', 'url of a source', (SELECT count(*) FROM (SELECT source_site_id, url_hash FROM tender_attachment WHERE url_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'tender_attachment', 'attachment_type', (SELECT count(*) FROM tender_attachment WHERE NOT attachment_type IN ('notice_file', 'bid_file', 'other'))
        UNION ALL SELECT 'crawl_error', 'stage', (SELECT count(*) FROM crawl_error WHERE NOT stage IN ('fetch', 'parse', 'persist'))""",
    "job_retry_links": f"""WITH {reportbook._JOB} SELECT j.id, (SELECT o.now_status FROM job o WHERE o.id = j.retry_of_job_id) AS retry_of_status, r.id AS retried_by_id, r.now_status AS retried_by_status FROM job j LEFT JOIN job r ON r.id = (SELECT max(q.id) FROM job q WHERE q.retry_of_job_id = j.id)""",
}
ORACLES = {name: sqlbook.duckdb(words) for name, words in SQL.items()} | {
    "page_upsert": f"WITH {_PAGES} SELECT raw_id, du AS is_duplicate_url, dc AS is_duplicate_content FROM f",
    "job_counters": f"""WITH {_PAGES} SELECT crawl_job_id, count(*) AS pages_fetched, count(*) AS documents_saved, CAST(sum(greatest(du, dc)) AS BIGINT) AS deduplicated_count, {_META('page_item_count')} AS list_items_seen, {_META('new_unique_item_count')} AS list_items_unique, {_META('page_source_duplicates_skipped')} AS list_items_source_duplicates_skipped,
        CAST(sum(CASE WHEN role = 'detail' THEN 1 ELSE 0 END) AS BIGINT) AS detail_pages_fetched, CAST(sum(1 - du) AS BIGINT) AS records_inserted, CAST(sum(du) AS BIGINT) AS records_updated FROM f WHERE crawl_job_id IS NOT NULL GROUP BY crawl_job_id""",
    "source_lookup": "SELECT c.source_code, s.id AS source_site_id, CASE WHEN c.source_code IN ('2', 'ggzy_gov_cn') THEN 'ggzy_gov_cn_deal' END AS former FROM (SELECT DISTINCT source_code FROM (SELECT source_code FROM notice_item UNION ALL SELECT source_code FROM raw_document_item) UNION ALL SELECT unnest(['2', 'ggzy_gov_cn', 'zb_01 ', 'nowhere'])) c LEFT JOIN source_site s ON s.code = c.source_code",
    "sources_created": """SELECT code, name, base_url FROM (SELECT 'new_' || substr(source_code, 1, 3) AS code, coalesce(nullif(trim(source_site_name), ''), trim(source_code)) AS name,
        coalesce(nullif(regexp_extract(trim(source_site_url), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1), ''), nullif(regexp_extract(trim(detail_page_url), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1), ''), 'https://example.com') AS base_url, row_number() OVER (PARTITION BY substr(source_code, 1, 3) ORDER BY item_id) AS k FROM notice_item) WHERE k = 1""",
}
