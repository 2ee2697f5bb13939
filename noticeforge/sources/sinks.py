"""Writers: one JSON file set a type of item, flat exports, a spreadsheet, and a merge by rewrite."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types of items that have a sink of their own.
ITEM_TYPES = ("tender_notice", "notice_version", "raw_document", "tender_attachment", "crawl_error")
#: Rows a spreadsheet can hold.
XLSX_ROWS = 1_048_575


def write_jsonl(items: DataFrame, folder: str) -> None:
    """Appends items to a folder by type; items of unknown type are passed over."""
    items.filter(F.col("item_type").isin(*ITEM_TYPES)).write.mode("append").partitionBy("item_type").option("ignoreNullFields", "false").json(folder)


def write_noop(items: DataFrame, folder: str = "") -> None:
    items.write.format("noop").mode("overwrite").save()


def sink(backend: str):
    """The writer of a backend: noop, jsonl or parquet."""
    writers = {"noop": write_noop, "jsonl": write_jsonl, "parquet": lambda items, folder: items.write.mode("append").partitionBy("item_type").parquet(folder)}
    if backend not in writers:
        raise ValueError(f"unknown backend {backend!r}; one of {sorted(writers)}")
    return writers[backend]


def flat(rows: DataFrame) -> DataFrame:
    """All columns as text: null as '', times in ISO form, decimals without exponent."""
    text = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX") if t == "timestamp" else F.col(c).cast("string") for c, t in rows.dtypes}
    return rows.select(*(F.coalesce(e, F.lit("")).alias(c) for c, e in text.items()))


def write_csv(rows: DataFrame, folder: str, single: bool = False) -> None:
    out = flat(rows)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").option("escape", '"').csv(folder)


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept, decimals as text."""
    safe = rows.select(*(F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes))
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("value"))


def _letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def xlsx_bytes(rows: DataFrame, sheet: str) -> bytes:
    """A spreadsheet of a report. The sheet's own limit of rows is checked before any comes."""
    if rows.limit(XLSX_ROWS + 1).count() > XLSX_ROWS:
        raise ValueError(f"a sheet holds {XLSX_ROWS} rows; export as CSV")
    out, names = [], rows.columns
    table = flat(rows)

    def line(k: int, values) -> str:
        return f'<row r="{k}">' + "".join(f'<c r="{_letters(i)}{k}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(values, 1)) + "</row>"

    out.append(line(1, names))
    for k, row in enumerate(table.toLocalIterator(), 2):
        out.append(line(k, row))
    space = "http://schemas.openxmlformats.org/"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{space}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}package/2006/relationships"><Relationship Id="r1" Type="{space}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}spreadsheetml/2006/main" xmlns:r="{space}officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{space}package/2006/relationships"><Relationship Id="r1" Type="{space}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return buffer.getvalue()


#: Columns of the sheet of sources' operations.
OPS_COLUMNS = ["source_code", "source_name", "official_url", "is_active", "schedule_enabled", "schedule_days", "job_count", "success_count", "failed_count", "partial_count", "new_notice_count", "last_job_status", "last_job_finished_at", "last_error_message", "last_retry_status"]


def source_ops_xlsx(operations: DataFrame) -> bytes:
    """The spreadsheet of a report of operations."""
    return xlsx_bytes(operations.select(*OPS_COLUMNS).orderBy("source_code"), "source_ops")


def merge(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after an upsert: of each key the last row, whose nulls leave what was known before."""
    last = Window.partitionBy(*keys).orderBy("_new", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    kept = [c for c in both.columns if c not in (*keys, "_new")]
    folded = both.select(*keys, *(F.last(c, ignorenulls=True).over(last).alias(c) for c in kept), F.row_number().over(rank).alias("_k"))
    return folded.filter("_k = 1").drop("_k")
