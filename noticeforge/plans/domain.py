"""Relations of the notice domain over the delivered tables, as SQL both engines read.

Items arrive as untyped strings; the relations cast what is of one plain form and give null otherwise. No job
or error table is delivered, so these two come from orders and events.
"""

from __future__ import annotations

_ISO = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}$'"


def _time(c: str) -> str:
    return f"CASE WHEN regexp_extract({c}, {_ISO}, 0) <> '' THEN try_cast(replace({c}, 'T', ' ') AS TIMESTAMP) END"


#: Instants that reports are made at.
AS_OF, JOBS_AS_OF, ERRORS_AS_OF = "TIMESTAMP '2024-12-01 00:00:00'", "TIMESTAMP '2001-07-01 00:00:00'", "TIMESTAMP '2024-01-28 00:00:00'"

RELATIONS = {
    "tender_notice": f"""SELECT n.item_id AS id, s.id AS source_site_id, n.external_id, n.project_code, n.dedup_hash, n.dedup_key, n.source_duplicate_key, n.title,
        CASE WHEN n.notice_type IN ('announcement', 'change', 'result') THEN n.notice_type ELSE 'announcement' END AS notice_type, n.issuer, n.region,
        {_time('n.published_at')} AS published_at, {_time('n.deadline_at')} AS deadline_at,
        CASE WHEN regexp_extract(n.budget_amount, '^[0-9]{{1,12}}([.][0-9]{{1,2}})?$', 0) <> '' THEN CAST(n.budget_amount AS DECIMAL(18, 2)) END AS budget_amount,
        n.budget_currency, n.summary, CAST(n.crawled_at AS TIMESTAMP) AS created_at, n.detail_page_url, n.crawl_job_id, n.raw_content_hash
        FROM notice_item n JOIN source_site s ON s.code = n.source_code""",
    "notice_version": """SELECT v.snap_id AS id, t.id AS notice_id, v.content_hash, v.title, v.notice_type, v.change_summary, CASE WHEN lower(trim(v.is_current)) IN ('true', '1', 'yes', 'y') THEN 1 ELSE 0 END AS is_current, CAST(v.observed_at AS TIMESTAMP) AS created_at,
        row_number() OVER (PARTITION BY t.id ORDER BY v.observed_at, v.snap_id) AS version_no
        FROM notice_version_item v JOIN (SELECT dedup_hash, min(item_id) AS id FROM notice_item GROUP BY dedup_hash) t ON t.dedup_hash = v.notice_dedup_hash""",
    "raw_document": """SELECT r.raw_id AS id, s.id AS source_site_id, r.crawl_job_id, r.url, r.normalized_url, r.url_hash, r.content_hash, r.document_type, r.title,
        CAST(r.fetched_at AS TIMESTAMP) AS fetched_at, r.http_status, r.content_length, r.extra_meta, get_json_object(r.extra_meta, '$.role') AS role
        FROM raw_document_item r JOIN source_site s ON s.code = r.source_code""",
    "tender_attachment": """SELECT a.att_id AS id, s.id AS source_site_id, t.id AS notice_id, a.file_name, a.attachment_type, a.file_url, a.url_hash, a.file_hash, a.file_ext, a.notice_version_no,
        CASE WHEN regexp_extract(a.file_size_bytes, '^[0-9]{1,15}$', 0) <> '' THEN CAST(a.file_size_bytes AS BIGINT) END AS file_size_bytes, CAST(a.downloaded_at AS TIMESTAMP) AS downloaded_at
        FROM tender_attachment_item a JOIN source_site s ON s.code = a.source_code LEFT JOIN (SELECT dedup_hash, min(item_id) AS id FROM notice_item GROUP BY dedup_hash) t ON t.dedup_hash = a.notice_dedup_hash""",
    "crawl_job": """SELECT o_orderkey AS id, c_nationkey % 48 + 1 AS source_site_id,
        CASE WHEN o_orderkey % 13 = 0 THEN 'pending' WHEN o_orderkey % 11 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'succeeded' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'partial' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'manual_retry' WHEN o_orderkey % 3 = 0 THEN 'scheduled' ELSE 'manual' END AS job_type,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey > 0 THEN o_orderkey - 1 END AS retry_of_job_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR END AS started_at,
        CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' HOUR END AS lease_expires_at,
        CASE WHEN o_orderkey % 17 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '5' MINUTE END AS picked_at,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' MINUTE END AS queued_at,
        CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' HOUR END AS finished_at,
        CASE WHEN o_orderkey % 22 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '4' HOUR END AS timeout_at,
        o_custkey % 50 AS pages_fetched, o_custkey % 9 AS notices_upserted, o_custkey % 4 AS error_count, 'job ' || CAST(o_orderkey AS VARCHAR(20)) AS message,
        o_custkey % 7 AS documents_saved, o_custkey % 5 AS deduplicated_count, CASE WHEN o_custkey % 6 = 0 THEN 0 ELSE o_custkey % 40 END AS list_items_seen, o_custkey % 30 AS list_items_unique,
        o_custkey % 3 AS list_items_source_duplicates_skipped, o_custkey % 8 AS detail_pages_fetched, o_custkey % 10 AS records_inserted, o_custkey % 11 AS records_updated, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 6 END AS source_duplicates_suppressed,
        CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS return_code, CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderstatus = 'F' THEN 'reason ' || CAST(o_orderkey % 10 AS VARCHAR(20)) END AS failure_reason
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "source": """SELECT id, code, name, base_url, official_url, is_active, is_active AND id % 3 <> 0 AS schedule_enabled, CASE id % 4 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS schedule_days FROM source_site""",
    "crawl_error": """SELECT event_id AS id, user_id % 48 + 1 AS source_site_id, user_id AS crawl_job_id,
        CASE CAST(get_json_object(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'parse' ELSE 'persist' END AS stage,
        'E' || get_json_object(props, '$.k') AS error_type, CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) AS occurred_at, props AS message
        FROM events WHERE event_type = 'error'""",
}
#: Tables that a relation is made of.
SOURCES = {
    "tender_notice": ["notice_item", "source_site"], "notice_version": ["notice_version_item", "notice_item"], "raw_document": ["raw_document_item", "source_site"],
    "tender_attachment": ["tender_attachment_item", "source_site", "notice_item"], "crawl_job": ["orders", "customer"], "source": ["source_site"], "crawl_error": ["events"],
}
TABLES = ("source_site", "notice_item", "notice_version_item", "raw_document_item", "tender_attachment_item", "orders", "customer", "events", "lineitem", "documents")
