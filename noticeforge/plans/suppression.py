"""Suppression of source duplicates by both keys, one item after the other.

An item is suppressed if an accepted item of its source before it has the same content hash and the same dedup_key
(for want of one, the source_duplicate_key) or the same source_duplicate_key. A suppressed item isn't kept, so it
suppresses nothing. A group is the items of one source and content hash; it goes through one task row by row, of which
only the keys are held.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.sources.tables import table


def suppressed(ids: list[int], dedup_keys: list[str | None], source_keys: list[str | None]) -> list[int]:
    """Of the items of one source and content hash those that are suppressed."""
    out, dedup, source = [], set(), set()
    for i, k, s in sorted(zip(ids, dedup_keys, source_keys), key=lambda x: x[0]):
        if k in dedup or s in source:
            out.append(i)
            continue
        dedup |= {k} - {None}
        source |= {s} - {None}
    return out


def _stream(batches):
    """The suppressed items of groups that come one after the other, rows in order; only the keys of one group are held."""
    at, dedup, source = None, set(), set()
    for pdf in batches:
        out = []
        for i, k, s, *here in zip(*(pdf[c].where(pdf[c].notna(), None).tolist() for c in ("item_id", "k", "s", "source_code", "raw_content_hash"))):
            if here != at:
                at, dedup, source = here, set(), set()
            if k in dedup or s in source:
                out.append(i)
            else:
                dedup |= {k} - {None}
                source |= {s} - {None}
        yield pd.DataFrame({"item_id": pd.Series(out, dtype="int64")})


def source_dup_suppress(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda c: F.nullif(F.trim(c), F.lit(""))
    items = table(spark, sf, "notice_item").filter(F.col("raw_content_hash").isNotNull())
    items = items.select("item_id", "source_code", "raw_content_hash", F.coalesce(key("dedup_key"), key("source_duplicate_key")).alias("k"), key("source_duplicate_key").alias("s"))
    # only groups in which some key occurs twice; counted before rows are moved
    twice = lambda c: items.filter(F.col(c).isNotNull()).groupBy("source_code", "raw_content_hash", c).count().filter("count > 1").select("source_code", "raw_content_hash")
    some = items.join(twice("k").unionByName(twice("s")).distinct(), ["source_code", "raw_content_hash"], "left_semi")
    group = ["source_code", "raw_content_hash"]
    return some.repartition(*group).sortWithinPartitions(*group, "item_id").mapInPandas(_stream, "item_id long")


QUERIES = {"source_dup_suppress_keys": source_dup_suppress}
