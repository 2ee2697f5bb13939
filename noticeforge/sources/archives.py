"""Bodies and files as they are archived, logs as they are read, tables of a database, and starting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by suffix, and the sources an empty system starts with.
MEDIA = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "zip": "application/zip", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed", "html": "text/html", "json": "application/json", "txt": "text/plain",
}
SEEDS = [("demo_a", "Demo A", "http://a.example"), ("demo_b", "Demo B", "http://b.example"), ("demo_c", "Demo C", "http://c.example"), ("demo_d", "Demo D", "http://d.example"), ("demo_e", "Demo E", "http://e.example")]


def media_type(suffix: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), suffix)


def file_name(url: Column) -> Column:
    """The decoded last part of a URL's path; null if it is empty."""
    return F.nullif(F.trim(F.try_url_decode(F.regexp_extract(url, r"^[^?#]*/([^/?#]*)", 1))), F.lit(""))


def suffix(name: Column, url: Column) -> Column:
    """What follows the last point of the name, else of the URL's last part, in lower case."""
    end = lambda c: F.nullif(F.trim(F.regexp_extract(c, r"\.([^.]*)$", 1)), F.lit(""))
    return F.lower(F.coalesce(end(name), end(file_name(url))))


def raw_archive(pages: DataFrame, base: str) -> DataFrame:
    """(raw_id, storage_uri, content_length) of pages as they are archived: named by time and URL, JSON or HTML; the
    length counts UTF-8 bytes. Pages without a body aren't archived."""
    p = pages.filter(F.col("raw_body").isNotNull())
    kind = F.when(F.col("mime_type").contains("json") | (F.col("document_type") == "json"), "json").otherwise("html")
    name = F.concat(F.date_format("fetched_at", "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(F.sha2("url", 256), 1, 12), F.lit("."), kind)
    return p.select("raw_id", F.concat_ws("/", F.lit(base.rstrip("/")), F.coalesce("source_code", F.lit("unknown_source")), name).alias("storage_uri"), F.octet_length("raw_body").alias("content_length"))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Bodies by source. Files of a table, not one a page."""
    pages.select("raw_id", F.coalesce("source_code", F.lit("unknown_source")).alias("source_code"), "url", "raw_body").write.mode("append").partitionBy("source_code").parquet(folder)


def file_archive(files: DataFrame, base: str) -> DataFrame:
    """(path, file_hash, file_size_bytes, mime_type, storage_uri) of files read by `binaryFile`: by hash, two letters a folder."""
    f = files.withColumn("file_hash", F.sha2("content", 256)).withColumn("suffix", suffix(F.col("path"), F.col("path")))
    return f.select("path", "file_hash", F.col("length").alias("file_size_bytes"), F.coalesce(media_type(F.col("suffix")), F.lit("application/octet-stream")).alias("mime_type"), F.concat_ws("/", F.lit(base.rstrip("/")), F.substring("file_hash", 1, 2), F.concat_ws(".", "file_hash", "suffix")).alias("storage_uri"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a log that are JSON objects, by a schema; other lines are passed over."""
    lines = spark.read.text(path)
    return lines.filter(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("x")).select("x.*")


def read_database(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table of a relational database, read in parts by ranges of a number column if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if column and bounds:
        for k, v in {"partitionColumn": column, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": parts}.items():
            reader = reader.option(k, v)
    return reader.load()


def seeded(sources: DataFrame) -> DataFrame:
    """Sources with the starting rows: those of a known code take name and URL, others are added with the next ids.
    Doing it again changes nothing."""
    spark = sources.sparkSession
    seeds = spark.createDataFrame(SEEDS, "code string, seed_name string, seed_url string")
    known = sources.join(seeds, "code", "left").withColumns({"name": F.coalesce("seed_name", "name"), "base_url": F.coalesce("seed_url", "base_url")}).select(*sources.columns)
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.unionByName(numbered_new(seeds.join(sources.select("code"), "code", "left_anti").select("code", F.col("seed_name").alias("name"), F.col("seed_url").alias("base_url")), "code", top), allowMissingColumns=True)


def numbered_new(rows: DataFrame, order: str, top: int) -> DataFrame:
    """New rows of a dimension with ids after the highest there is. A dimension's new rows are few: one window."""
    from pyspark.sql.window import Window

    return rows.withColumn("id", F.lit(top) + F.row_number().over(Window.orderBy(order)).cast("long"))


def patched(sources: DataFrame, code: str, **fields) -> DataFrame:
    """Sources with some fields of one changed; an unknown code is an error."""
    if not sources.filter(F.col("code") == code).limit(1).count():
        raise KeyError(code)
    return sources.withColumns({c: F.when(F.col("code") == code, F.lit(v)).otherwise(F.col(c)).cast(dict(sources.dtypes)[c]) for c, v in fields.items()})


def created(sources: DataFrame, code: str, **fields) -> DataFrame:
    """Sources with one more; a code that is taken is an error."""
    if sources.filter(F.col("code") == code).limit(1).count():
        raise ValueError(f"{code} exists")
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    types = dict(sources.dtypes)
    row = sources.sparkSession.range(1).select(F.lit(top + 1).cast(types["id"]).alias("id"), F.lit(code).alias("code"), *(F.lit(v).cast(types[c]).alias(c) for c, v in fields.items()))
    return sources.unionByName(row, allowMissingColumns=True)
