"""New batches against all accepted notices, by content-defined chunks (problem 1).

A record's text is cut where a rolling hash of `WINDOW` characters is the least among its `SPAN` neighbours on
either side. So an edit moves no cut further than these, and chunks have more than `SPAN` and at most `MOST`
characters. The persistent table maps (chunk, part) to the accepted record that carried the chunk first, or that
was first repeated by one that did, and to the project that record named; part is the lot, call and kind that the record's title states. A new record looks
its chunks up there and among the records before it in its load; the bytes found are totalled by the record they
lead to. A dedup key, source key, page or project code is a chunk too.

A chunk that records of several projects carry under one part (what all notices say) tells nothing and is left
out of all totals. Of what is left, the share that leads to one record is the coverage: from `ALONE` on it
decides by itself, from `COVERAGE` on where both name the same project or share a key. The exact check follows: a
record that names another project is none of the repeated, whatever the coverage.

No pairs within a chunk are formed, as of each (chunk, part) only the first carrier is kept: a record leads to at
most as many records as it has chunks. Chunks carried by more than one ten-thousandth of a load's rows, at most
10,000 of them, are joined by broadcast, so no task takes all carriers of a chunk. Nothing is capped. The chunk
table is bucketed by key: a load reads its keys and numbers, moves only the batch, and never sees an old text.
Chunks that are known, and known to tell nothing or to be of their project, aren't appended again.

Defined results: a record without text is judged by title, code and keys; keys that are blank or stand for
nothing count as missing; repeated ids are one record; records without batch_no come first; of several records
that fit, one of the same project wins, then the one with more shared bytes, then the smallest id; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.llm.folding import folded
from noticeforge.llm.notice_text import CODE, call_of, core_of, kind_of, lot_of, plain_title
from noticeforge.session import settle, shared_dir

#: Characters under the rolling hash, neighbours on either side of a cut, and the longest chunk.
WINDOW, SPAN, MOST = 4, 8, 64
#: Share of a record's telling bytes that shared chunks must cover, with a project or key in common and without.
COVERAGE, ALONE = 0.1, 0.6
#: Bytes that a project code counts for: those of a chunk of average length and some more.
CODE_BYTES = 64
#: Buckets of the chunk table, and loads that a replay of all batches is cut into.
BUCKETS, LOADS = 16, 4
#: A chunk with this share of a load's rows is hot; there are at most so many.
HOT = 10_000

_M = np.uint64(0x9E3779B97F4A7C15)
_POWERS = None
READ = T.StructType([T.StructField("part", T.StringType()), T.StructField("hash", T.ArrayType(T.LongType())), T.StructField("bytes", T.ArrayType(T.IntegerType()))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS is None or len(_POWERS) < n:
        p = np.empty(max(n, 4096), dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(np.full(len(p) - 1, _M), out=p[1:])
        _POWERS = p
    return _POWERS


def chunks_of(texts: list[str], parts: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, or of each so many neighbouring texts, the hashes of the distinct chunks and their bytes. No chunk
    reaches over two texts. Blanks, marks, width and case don't count."""
    codes, lengths = folded(texts)
    if not len(codes):
        return [(np.empty(0, np.int64), np.empty(0, np.int32))] * (len(texts) // parts)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    mixed = _mix(codes * _M + np.uint64(1))
    rolled = mixed.copy()
    for k in range(1, WINDOW):
        rolled[k:] += mixed[:-k] * _powers(WINDOW)[k]
    rolled = _mix(rolled)
    least = np.ones(len(codes), bool)  # positions before which a chunk begins
    for d in range(1, SPAN + 1):
        least[d:] &= rolled[d:] < rolled[:-d]
        least[:-d] &= rolled[:-d] < rolled[d:]
    position = np.arange(len(codes)) - np.repeat(starts, lengths)
    least &= (position >= SPAN + WINDOW) & (np.repeat(lengths, lengths) - position > SPAN)  # all that is looked at lies within the text
    least[starts[lengths > 0]] = True
    begin = np.flatnonzero(least)
    size = np.diff(np.append(begin, len(codes)))
    more = (size - 1) // MOST  # what has no cut for long is cut at equal lengths
    if more.any():
        begin = np.repeat(begin, more + 1) + (np.arange(len(begin) + more.sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)) * MOST
        size = np.diff(np.append(begin, len(codes)))
    place = np.arange(len(codes)) - np.repeat(begin, size)
    hashes = _mix(np.add.reduceat(mixed * _powers(int(size.max()) + 1)[place], begin) + size.astype(np.uint64)).view(np.int64)
    utf8 = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    weight = np.add.reduceat(utf8, begin).astype(np.int32)
    of = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    # each chunk of a text once
    text = np.repeat(np.arange(len(texts)) // parts, of[1] - of[0])
    order = np.lexsort((hashes, text))
    hashes, weight, text = hashes[order], weight[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    stops = np.cumsum(np.bincount(text[new], minlength=len(texts) // parts))[:-1]
    return list(zip(np.split(hashes[new], stops), np.split(weight[new], stops)))


@F.pandas_udf(READ)
def _read_udf(title: pd.Series, notice_type: pd.Series, text: pd.Series) -> pd.DataFrame:
    plain, texts = [plain_title(t) for t in title], text.tolist()
    cut = chunks_of([x for t, p in zip(texts, plain) for x in (t, core_of(p))], 2)
    return pd.DataFrame({
        "part": [f"{kind_of(k, t, x)}|{call_of(t)}|{lot_of(t)}" for k, t, x in zip(notice_type, plain, texts)],
        "hash": pd.Series([h for h, _ in cut], dtype=object), "bytes": pd.Series([b for _, b in cut], dtype=object),
    })


def _key(column: str) -> Column:
    """A hash key as a number, whatever its notation; null where it stands for nothing."""
    text = F.lower(F.regexp_replace(F.col(column), r"(?U)\s+", ""))
    return F.when(F.length(text) >= 8, F.xxhash64(F.lit(column), text))


def _code() -> Column:
    """The project code of the first column that has one; null if none has."""
    found = [F.nullif(F.regexp_extract(c, CODE, 0), F.lit("")) for c in ("project_code", "content_text", "summary")]
    return F.regexp_replace(F.coalesce(*found), r"\s+", "")


def read_records(items: DataFrame) -> DataFrame:
    """(item_id, code, total, chunks) of notice items: chunks are (k, bytes) under the record's part; bytes are
    null for keys."""
    page = F.nullif(F.trim("detail_page_url"), F.lit("")) if "detail_page_url" in items.columns else F.lit(None).cast("string")
    read = items.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), _code().alias("code"), _read_udf("title", "notice_type", "content_text").alias("r"),
        F.array_compact(F.array(_key("dedup_key"), _key("source_duplicate_key"), F.when(page.isNotNull(), F.xxhash64(F.lit("page"), page)))).alias("keys"),
    )
    read = read.withColumn("code", F.when(F.col("code").isNotNull(), F.xxhash64("code")))
    k = lambda x: F.xxhash64(x, F.col("r.part"))
    text = F.transform(F.arrays_zip(F.col("r.hash").alias("hash"), F.col("r.bytes").alias("bytes")), lambda x: F.struct(k(x["hash"]).alias("k"), x["bytes"].alias("bytes")))
    keys = F.transform("keys", lambda x: F.struct(k(x).alias("k"), F.lit(None).cast("int").alias("bytes")))
    code = F.when(F.col("code").isNotNull(), F.array(F.struct(k(F.col("code")).alias("k"), F.lit(CODE_BYTES).alias("bytes")))).otherwise(F.slice(keys, 1, 0))
    total = F.aggregate("r.bytes", F.lit(0), lambda a, x: a + x) + F.when(F.col("code").isNotNull(), CODE_BYTES).otherwise(0)
    return read.select("item_id", "code", total.alias("total"), F.concat(text, keys, code).alias("chunks"))


def _first(records: DataFrame) -> DataFrame:
    """(k, first, first_code, low, high, n) of records by chunk."""
    rows = records.select("item_id", "code", F.explode("chunks.k").alias("k"))
    return rows.groupBy("k").agg(F.min("item_id").alias("first"), F.min_by("code", "item_id").alias("first_code"), F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n"))


def _leads(records: DataFrame, verdict: DataFrame, n_rows: int) -> DataFrame:
    """(item_id, bytes, first, first_code) of chunks with a verdict; hot chunks, at most HOT of them, by broadcast."""
    rows = records.select("item_id", F.explode("chunks").alias("c")).select("item_id", "c.k", "c.bytes")
    hot = F.col("n") * HOT > n_rows
    often = verdict.filter(hot).drop("n")
    seldom = rows.join(F.broadcast(often.select("k")), "k", "left_anti").join(verdict.filter(~hot).drop("n"), "k")
    return seldom.unionByName(rows.join(F.broadcast(often), "k")).drop("k").filter(F.col("first") < F.col("item_id"))


def _decided(leads: DataFrame, records: DataFrame, coverage: float, alone: float) -> DataFrame:
    """(item_id, kept) of records that lead to an earlier one with enough coverage and no other project. leads to
    -1 are chunks that tell nothing."""
    shares = leads.groupBy("item_id", "first", "first_code").agg(F.sum("bytes").alias("shared"), F.max(F.col("bytes").isNull()).alias("by_key"))
    of = shares.groupBy("item_id").agg(
        F.sum(F.when(F.col("first") < 0, F.col("shared")).otherwise(0)).alias("common"),
        F.collect_list(F.when(F.col("first") >= 0, F.struct("first", F.coalesce("shared", F.lit(0)).alias("shared"), "by_key", "first_code"))).alias("candidates"),
    ).filter(F.size("candidates") > 0).join(records.select("item_id", "code", "total"), "item_id")
    telling = F.greatest(F.col("total") - F.col("common"), F.lit(1))

    def judged(c: Column) -> Column:
        same = F.coalesce(c["first_code"] == F.col("code"), F.lit(False))
        other = F.coalesce(c["first_code"] != F.col("code"), F.lit(False))
        share = c["shared"] / telling
        enough = (share >= alone) | ((same | c["by_key"]) & (share >= coverage)) | (c["by_key"] & (telling <= 1))
        return F.when(enough & ~other, F.struct(same.alias("same"), F.when(same, 0).otherwise(c["shared"]).alias("shared"), (-c["first"]).alias("first")))

    best = F.array_max(F.array_compact(F.transform("candidates", judged)))
    return of.select("item_id", (-best["first"]).alias("kept")).filter(F.col("kept").isNotNull())


def _followed(edges: DataFrame) -> DataFrame:
    """edges (item_id, kept) with kept followed to a record that isn't repeated itself; each round doubles the way."""
    while True:
        on = edges.select(F.col("item_id").alias("kept"), F.col("kept").alias("further")).join(edges.select("kept").distinct(), "kept", "left_semi")
        further = edges.join(on, "kept").limit(1).count()
        if not further:
            return edges
        edges = settle(edges.join(on, "kept", "left").select("item_id", F.coalesce("further", "kept").alias("kept")))


class AcceptedHistory:
    """The persistent form: a folder with the chunk table, bucketed by k, that each load is checked against and
    appends to. `chunks`: k, first, first_code, batch_no. `loads`: the repeats of each load, written last; a load
    that was broken off is done again, and rows it appended twice change nothing."""

    def __init__(self, spark: SparkSession, folder: str, coverage: float = COVERAGE, alone: float = ALONE, buckets: int = BUCKETS):
        self.spark, self.folder, self.coverage, self.alone, self.buckets = spark, folder.rstrip("/"), coverage, alone, buckets
        self.name = "accepted_" + hashlib.md5(self.folder.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (k BIGINT, first BIGINT, first_code BIGINT, batch_no INT) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {buckets} BUCKETS LOCATION '{self.folder}/chunks'")

    def _known(self, before: int) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("batch_no") < before).select("k", F.col("first").alias("was"), F.col("first_code").alias("was_code"))

    def _read(self, part: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _loaded(self, batch_no: int) -> DataFrame | None:
        return self._read(f"loads/batch_no={batch_no}", "kept_item_id long, item_id long")

    def _merged(self, records: DataFrame, known: DataFrame, batch_no: int) -> DataFrame:
        """Of each chunk of the load what the load and the history say, written once: (k, first, first_code, low, high,
        n, old_low, old_high, known). The history is bucketed by k, so only the load's chunks move."""
        both = _first(records).join(known, "k", "left").groupBy("k", "first", "first_code", "low", "high", "n").agg(
            F.min("was").alias("was"), F.min_by("was_code", "was").alias("was_code"), F.min("was_code").alias("old_low"), F.max("was_code").alias("old_high"))
        earlier = F.coalesce(F.col("was") < F.col("first"), F.lit(False))
        both = both.select("k", F.when(earlier, F.col("was")).otherwise(F.col("first")).alias("first"), F.when(earlier, F.col("was_code")).otherwise(F.col("first_code")).alias("first_code"), F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high"), "n", "old_low", "old_high", F.col("was").isNotNull().alias("known"))
        both.write.mode("overwrite").parquet(f"{self.folder}/work/batch_no={batch_no}")
        return self.spark.read.schema(both.schema).parquet(f"{self.folder}/work/batch_no={batch_no}")

    def load(self, batch: DataFrame, batch_no: int, since: int | None = None) -> DataFrame:
        """(kept_item_id, item_id) of the batch's records that repeat an accepted one or one before them in the
        load; all others are accepted. since: the first batch_no, if the load holds several batches. Loading the
        same batch again gives the same and adds nothing."""
        if (done := self._loaded(batch_no)) is not None:
            return done
        known = self._known(batch_no if since is None else since)
        records = settle(read_records(batch))
        if records.groupBy("item_id").count().filter("count > 1").limit(1).count():
            records = settle(records.dropDuplicates(["item_id"]))
        n_rows = records.agg(F.sum(F.size("chunks"))).first()[0] or 0
        merged = self._merged(records, known, batch_no)
        telling = F.col("low").isNull() | (F.col("low") == F.col("high"))
        # a chunk seen once leads nowhere
        verdict = merged.filter("known or n > 1").select("k", F.when(telling, F.col("first")).otherwise(-1).alias("first"), F.when(telling, F.col("first_code")).alias("first_code"), "n")
        edges = _followed(settle(_decided(_leads(records, verdict, n_rows), records, self.coverage, self.alone)))
        self._append(merged, edges, batch_no)
        edges.select(F.col("kept").alias("kept_item_id"), "item_id").write.mode("overwrite").parquet(f"{self.folder}/loads/batch_no={batch_no}")
        self._delete(f"work/batch_no={batch_no}")
        return self._loaded(batch_no)

    def _append(self, merged: DataFrame, edges: DataFrame, batch_no: int) -> None:
        """Appends what the table doesn't say yet: a chunk, or a second project that carries it. What a repeat
        carried first leads to the accepted record it repeats."""
        second = F.when(F.col("high") != F.col("first_code"), F.col("high")).when(F.col("low") != F.col("first_code"), F.col("low")).when(F.col("first_code").isNull(), F.col("low"))
        told = F.col("known") & (F.col("low").isNull() | F.coalesce((F.col("old_low") < F.col("old_high")) | ((F.col("low") == F.col("old_low")) & (F.col("high") == F.col("old_high"))), F.lit(False)))
        new = merged.filter(~told).select("k", "first", F.explode(F.array_distinct(F.array_append(F.array("first_code"), F.coalesce(second, F.col("first_code"))))).alias("first_code"))
        new = new.join(edges.select(F.col("item_id").alias("first"), "kept"), "first", "left").withColumn("first", F.coalesce("kept", "first"))
        new.select("k", "first", "first_code", F.lit(batch_no).alias("batch_no")).repartition(self.buckets, "k").sortWithinPartitions("k").write.insertInto(self.name)

    def _delete(self, part: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self) -> None:
        """Removes the table and its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._delete("")


def repeated(items: DataFrame, coverage: float = COVERAGE, alone: float = ALONE, loads: int = LOADS) -> DataFrame:
    """(kept_item_id, item_id) of all records that repeat an earlier one: a history that starts empty takes the
    batches in the order of batch_no, several neighbouring ones a load, and is dropped at the end."""
    spark = items.sparkSession
    items = items.withColumn("batch_no", F.coalesce(F.col("batch_no").cast("int"), F.lit(-1)))
    batches = [r.batch_no for r in items.select("batch_no").distinct().orderBy("batch_no").collect()]  # one row a load of the platform
    history = AcceptedHistory(spark, f"{shared_dir(spark)}/accepted-{uuid.uuid4().hex}", coverage, alone)
    found = None
    for part in np.array_split(batches, min(loads, max(len(batches), 1))):
        low, high = (int(part[0]), int(part[-1])) if len(part) else (-1, -1)
        batch = items.filter(F.col("batch_no").between(low, high))
        found = history.load(batch, high, low) if found is None else found.unionByName(history.load(batch, high, low))
    found = settle(found)
    history.drop()
    return found
