"""SQL texts for DuckDB over the domain's relations, which plans written as DataFrames are compared with, and the relations
as DataFrames. No query of Spark runs a text of the book; only the relations are one text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from noticeforge.plans.domain import AS_OF, ERRORS_AS_OF, JOBS_AS_OF, RELATIONS, SOURCES, TABLES
from noticeforge.sources.tables import table

#: The key notices are grouped by when a list is asked for: the first key that isn't blank, else what names the notice.
KEY = """coalesce(nullif(trim(n.dedup_key), ''), nullif(trim(n.source_duplicate_key), ''), nullif(trim(n.dedup_hash), ''),
    'fallback:' || CAST(n.source_site_id AS VARCHAR(20)) || '|' || trim(coalesce(n.external_id, '')) || '|' || trim(coalesce(n.project_code, '')) || '|' || trim(coalesce(n.title, '')))"""
RECENT = f"(n.created_at >= {AS_OF} - INTERVAL '24' HOUR OR n.id IN (SELECT v.notice_id FROM notice_version v WHERE v.created_at >= {AS_OF} - INTERVAL '24' HOUR))"
_BASE = f"base AS (SELECT n.*, s.code AS source_code, s.name AS source_name, {KEY} AS group_key, CASE WHEN {RECENT} THEN 1 ELSE 0 END AS is_recent_new FROM tender_notice n JOIN source_site s ON s.id = n.source_site_id)"
_RANKED = "ranked AS (SELECT b.*, row_number() OVER (PARTITION BY group_key ORDER BY is_recent_new DESC, published_at DESC NULLS LAST, id DESC) AS row_rank, count(*) OVER (PARTITION BY group_key) AS duplicate_count FROM base b {where})"
_LIST = "id, source_code, title, notice_type, issuer, region, unix_micros(published_at) AS published_us, unix_micros(deadline_at) AS deadline_us, budget_amount, budget_currency, is_recent_new, duplicate_count"
_SEARCH = "WHERE (title ILIKE '%采购%' OR issuer ILIKE '%采购%' OR region ILIKE '%采购%')"
_OF_SOURCE, _OF_REGION = "WHERE source_code = 'zb_01' AND notice_type = 'change'", "WHERE region = '云岫省'"
_OF_MARCH = "WHERE published_at >= TIMESTAMP '2024-03-01 00:00:00' AND published_at < TIMESTAMP '2024-04-01 00:00:00'"
_SWEPT = f"job AS (SELECT j.*, CASE WHEN j.status = 'running' AND coalesce(j.timeout_at, j.lease_expires_at) <= {JOBS_AS_OF} THEN 'failed' ELSE j.status END AS now_status FROM crawl_job j)"


def _ranked(where: str = "") -> str:
    return f"WITH {_BASE}, {_RANKED.format(where=where)}"


BOOK: dict[str, str] = {
    # lists of notices
    "notice_list_dedup": f"{_ranked(_SEARCH)} SELECT {_LIST} FROM ranked WHERE row_rank = 1",
    "notice_list_all": f"WITH {_BASE} SELECT {_LIST.replace('duplicate_count', '1 AS duplicate_count')} FROM base",
    "notice_filter": f"{_ranked(_OF_SOURCE)} SELECT {_LIST} FROM ranked WHERE row_rank = 1",
    "notice_region": f"{_ranked(_OF_REGION)} SELECT {_LIST} FROM ranked WHERE row_rank = 1",
    "notice_date_range": f"{_ranked(_OF_MARCH)} SELECT {_LIST} FROM ranked WHERE row_rank = 1",
    "notice_wildcard_keyword": f"WITH {_BASE} SELECT id, title FROM base WHERE title ILIKE '%2024%采购_目%' OR issuer ILIKE '%2024%采购_目%' OR region ILIKE '%2024%采购_目%'",
    "notice_dual_totals": f"WITH {_BASE} SELECT count(*) AS raw_total, count(DISTINCT group_key) AS dedup_total FROM base {_SEARCH}",
    "notice_related": f"WITH {_BASE} SELECT a.id AS notice_id, b.id AS related_id, b.source_code FROM base a JOIN base b ON a.group_key = b.group_key WHERE a.id % 100 = 0",
    "notice_versions": "SELECT notice_id, id AS version_id, version_no, content_hash, unix_micros(created_at) AS created_us FROM notice_version",
    "notice_version_owner": "SELECT v.id AS version_id, n.id AS notice_id, s.code AS source_code FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id JOIN source_site s ON s.id = n.source_site_id",
    "notice_group_sizes": f"WITH {_BASE} SELECT group_key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM base GROUP BY group_key HAVING count(*) > 1",
    # scalar functions of identity
    "title_hash": "SELECT id, sha2(lower(trim(title)), 256) AS title_hash FROM tender_notice",
    "file_extension": "SELECT id, lower(regexp_extract(file_name, '[.]([A-Za-z0-9]{1,5})$', 1)) AS ext, lower(file_ext) AS said_ext FROM tender_attachment",
    "blank_to_default": "SELECT id, coalesce(nullif(trim(official_url), ''), base_url) AS effective_url FROM source_site",
    # statistics
    "stats_recent_failures": f"WITH {_SWEPT} SELECT j.id, s.code, j.now_status, unix_micros(j.created_at) AS created_us FROM job j JOIN source_site s ON s.id = j.source_site_id WHERE j.now_status IN ('failed', 'partial') ORDER BY j.created_at DESC, j.id DESC LIMIT 10",
    "stats_recent_errors": "SELECT e.id, s.code, e.stage, unix_micros(e.created_at) AS created_us FROM crawl_error e JOIN source_site s ON s.id = e.source_site_id ORDER BY e.created_at DESC, e.id DESC LIMIT 10",
    "new_notice_union": f"SELECT count(*) AS n FROM (SELECT id AS notice_id FROM tender_notice WHERE created_at >= {AS_OF} - INTERVAL '7' DAY UNION SELECT notice_id FROM notice_version WHERE created_at >= {AS_OF} - INTERVAL '7' DAY)",
    "new_notice_by_source": f"SELECT source_site_id, count(DISTINCT notice_id) AS n FROM (SELECT source_site_id, id AS notice_id FROM tender_notice WHERE created_at >= {AS_OF} - INTERVAL '7' DAY UNION SELECT n.source_site_id, v.notice_id FROM notice_version v JOIN tender_notice n ON n.id = v.notice_id WHERE v.created_at >= {AS_OF} - INTERVAL '7' DAY) GROUP BY source_site_id",
    # operations and health of sources
    "latest_job_per_source": f"WITH {_SWEPT} SELECT source_site_id, max(id) AS job_id, max_by(now_status, id) AS status, max_by(message, id) AS message FROM job GROUP BY source_site_id",
    "failure_streak": f"""WITH {_SWEPT}, last10 AS (SELECT source_site_id, now_status, row_number() OVER (PARTITION BY source_site_id ORDER BY id DESC) AS k FROM job)
        SELECT source_site_id, coalesce(min(CASE WHEN now_status <> 'failed' THEN k END), count(*) + 1) - 1 AS streak FROM last10 WHERE k <= 10 GROUP BY source_site_id""",
    "source_error_latest": "SELECT source_site_id, id AS error_id, message FROM (SELECT e.*, row_number() OVER (PARTITION BY source_site_id ORDER BY created_at DESC, id DESC) AS k FROM crawl_error e) WHERE k = 1",
    "errors_7d_by_source": f"SELECT source_site_id, count(*) AS n FROM crawl_error WHERE occurred_at >= {ERRORS_AS_OF} - INTERVAL '7' DAY GROUP BY source_site_id",
    # jobs
    "job_queue": f"SELECT id, unix_micros(queued_at) AS queued_us FROM crawl_job WHERE status = 'pending' AND (picked_at IS NULL OR coalesce(timeout_at, lease_expires_at) IS NULL OR coalesce(timeout_at, lease_expires_at) <= {JOBS_AS_OF}) ORDER BY queued_at ASC NULLS FIRST, id ASC LIMIT 20",
    "job_expired": f"SELECT id, source_site_id FROM crawl_job WHERE status = 'running' AND coalesce(timeout_at, lease_expires_at) IS NOT NULL AND coalesce(timeout_at, lease_expires_at) <= {JOBS_AS_OF}",
    "job_mutex_violations": "SELECT source_site_id, count(*) AS n_active, max(id) AS kept FROM crawl_job WHERE status IN ('pending', 'running') GROUP BY source_site_id HAVING count(*) > 1",
    # documents and errors
    "raw_doc_owner": "SELECT r.id AS raw_id, min(n.id) AS notice_id FROM raw_document r JOIN tender_notice n ON n.detail_page_url = r.normalized_url GROUP BY r.id",
    "error_by_stage": "SELECT stage, error_type, count(*) AS n FROM crawl_error GROUP BY stage, error_type",
    # merging
    "version_assign": "SELECT notice_id, content_hash, first_id, row_number() OVER (PARTITION BY notice_id ORDER BY first_id) AS version_no, CASE WHEN last_id = max(last_id) OVER (PARTITION BY notice_id) THEN 1 ELSE 0 END AS is_current FROM (SELECT notice_id, content_hash, min(id) AS first_id, max(id) AS last_id FROM notice_version WHERE content_hash IS NOT NULL GROUP BY notice_id, content_hash)",
    "attachment_upsert": "SELECT source_site_id, url_hash, max(id) AS attachment_id, max_by(file_name, id) AS file_name, max(downloaded_at) IS NOT NULL AS is_downloaded, count(*) AS n FROM tender_attachment WHERE url_hash IS NOT NULL GROUP BY source_site_id, url_hash",
    "attachment_list": "SELECT id, notice_id, file_name, attachment_type, file_size_bytes FROM tender_attachment WHERE notice_id IS NOT NULL",
}
def _used(text: str) -> list[str]:
    return [r for r in RELATIONS if re.search(rf"\b{r}\b", text)]


def run(spark: SparkSession, sf: str, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """Runs a text of the book over the tables in a folder; relations that are given aren't made."""
    frames, made = dict(given or {}), [r for r in _used(text) if r not in (given or {})]
    for relation in made:
        for name in SOURCES[relation]:
            frames[name] = table(spark, sf, name)
    for name in TABLES:
        if name not in frames and re.search(rf"\b{name}\b", text):
            frames[name] = table(spark, sf, name)
    # relations and tables go in as named arguments, so nothing is registered in the session
    for relation in made:
        frames[relation] = spark.sql(re.sub(r"\b(" + "|".join(SOURCES[relation]) + r")\b(?=[ )]|$)", r"{\1}", RELATIONS[relation].replace("{", "{{").replace("}", "}}")), **{n: frames[n] for n in SOURCES[relation]})
    names = sorted(frames, key=len, reverse=True)
    escaped = text.replace("{", "{{").replace("}", "}}")
    query = re.sub(r"(?<=FROM )(" + "|".join(names) + r")\b|(?<=JOIN )(" + "|".join(names) + r")\b", lambda m: "{" + (m[1] or m[2]) + "}", escaped)
    return spark.sql(query, **{n: df for n, df in frames.items() if "{" + n + "}" in query})


def duckdb(text: str) -> str:
    """The same text for DuckDB, relations as common table expressions."""
    used = _used(text)
    with_ = ", ".join(f"{r} AS ({RELATIONS[r]})" for r in used)
    if with_:
        text = f"WITH {with_}, {text[5:]}" if text.startswith("WITH ") else f"WITH {with_} {text}"
    for spark_form, duck in (("unix_micros(", "epoch_us("), ("sha2(", "sha256("), (", 256)", ")"), ("get_json_object(", "json_extract_string("), ("LEFT ANTI JOIN", "ANTI JOIN")):
        text = text.replace(spark_form, duck)
    return text
