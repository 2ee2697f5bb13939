"""History of changing entities from repeated looks at them.

Every look is a unit interval. Neighbouring runs of intervals are merged pairwise where entity and payload
agree, in a tree: round r joins runs of 2^r looks, so a history of n looks takes log2(n) rounds, and no
task needs to hold a whole history. Looks are first cut by range over (entity, time), which splits an
entity that holds a large share of all rows; the rounds within a cut need no shuffle, and only the seams
of entities that cross a cut go through the rounds over cuts.

A payload is a content hash, or, where it is missing, what a signature of the known attributes says: a
look without a hash belongs to the content before it if the signature agrees, else to that after it, else
it is a content of its own. That rule doesn't depend on the shape of the tree (see `_merge`).

Defined results: looks at one instant count once, as the row of the smallest id (of several of one id the one with
a hash), never as a mixture of rows; without an entity or an instant a
look has no place in a history and is left out; equal payloads that return later are new periods. An empty
table has no periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticeforge.session import settle, skewless

_FIELDS = ("at", "snap", "pid", "known_at", "known_snap", "known_pid", "hash", "first_sig", "last_sig")


def _run(**changes: Column) -> Column:
    return F.struct(*(changes[f].alias(f) for f in _FIELDS))


def _merge(a: Column, b: Column) -> Column:
    """The one or two runs that the neighbours a and b make.

    A run knows where its first look with a hash is. So if a run without hashes was joined to what follows
    it, and what comes before it turns out to agree too, the looks before the first hash go back there:
    the result is the same in whatever order neighbours are merged."""
    both = a["hash"].isNotNull() & b["hash"].isNotNull()
    agree = a["last_sig"] == b["first_sig"]
    one = F.when(both, a["hash"] == b["hash"]).otherwise(agree)
    given = a["hash"].isNotNull()
    joined = _run(
        at=a["at"], snap=a["snap"], pid=a["pid"],
        known_at=F.when(given, a["known_at"]).otherwise(b["known_at"]), known_snap=F.when(given, a["known_snap"]).otherwise(b["known_snap"]), known_pid=F.when(given, a["known_pid"]).otherwise(b["known_pid"]),
        hash=F.coalesce(a["hash"], b["hash"]), first_sig=a["first_sig"], last_sig=b["last_sig"],
    )
    shorter = _run(at=b["known_at"], snap=b["known_snap"], pid=b["known_pid"], known_at=b["known_at"], known_snap=b["known_snap"], known_pid=b["known_pid"], hash=b["hash"], first_sig=b["first_sig"], last_sig=b["last_sig"])
    gives_back = both & agree & (b["known_at"] > b["at"])
    return F.when(one, F.array(joined)).when(gives_back, F.array(a, shorter)).otherwise(F.array(a, b))


def _round(blocks: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Merges blocks 2k and 2k+1. A block holds its outermost runs and, in done, those that are final."""
    pairs = blocks.groupBy(*keys, F.shiftright(index, 1).alias(index)).agg(F.sort_array(F.collect_list(F.struct(F.col(index).bitwiseAND(1).alias("half"), "runs", "done"))).alias("p"))
    x, y = F.col("p")[0], F.col("p")[1]
    xs, ys = x["runs"], y["runs"]
    merged = F.concat(F.slice(xs, 1, F.size(xs) - 1), _merge(F.element_at(xs, -1), F.element_at(ys, 1)), F.slice(ys, 2, F.size(ys)))
    pairs = pairs.select(*keys, index, F.when(F.size("p") == 1, xs).otherwise(merged).alias("m"), F.when(F.size("p") == 1, x["done"]).otherwise(F.concat(x["done"], y["done"])).alias("d"))
    m = F.col("m")
    return pairs.select(
        *keys, index,
        F.when(F.size(m) <= 2, m).otherwise(F.array(F.element_at(m, 1), F.element_at(m, -1))).alias("runs"),
        F.when(F.size(m) <= 2, F.col("d")).otherwise(F.concat("d", F.slice(m, 2, F.size(m) - 2))).alias("done"),
    )


def _rounds(n: int) -> int:
    return max(0, (max(n, 1) - 1).bit_length())


def coalesce_history(looks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, period_no, valid_from, valid_to, first_snap_id, content_hash) of looks
    (*keys, observed_at, snap_id, content_hash, signature). valid_to is null for the period that lasts."""
    # looks at one instant count once, as the whole row that comes first; this also folds repeated deliveries
    # before anything is moved
    first = F.struct("snap_id", F.col("content_hash").isNull().alias("bare"), "content_hash", "signature")
    looks = looks.filter(F.col("observed_at").isNotNull()).dropna(subset=keys).groupBy(*keys, "observed_at").agg(F.min(first).alias("f")).select(*keys, "observed_at", "f.snap_id", "f.content_hash", "f.signature")
    spark = looks.sparkSession
    cut = settle(looks.repartitionByRange(skewless(spark), *keys, "observed_at").withColumn("pid", F.spark_partition_id()))
    index = F.row_number().over(Window.partitionBy(*keys, "pid").orderBy("observed_at")) - 1
    known = F.col("content_hash").isNotNull()
    unit = _run(
        at=F.col("observed_at"), snap=F.col("snap_id"), pid=F.col("pid"),
        known_at=F.when(known, F.col("observed_at")), known_snap=F.when(known, F.col("snap_id")), known_pid=F.when(known, F.col("pid")),
        hash=F.col("content_hash"), first_sig=F.col("signature"), last_sig=F.col("signature"),
    )
    units = cut.withColumn("i", index).select(*keys, "pid", "i", F.array(unit).alias("runs"))
    units = units.withColumn("done", F.slice("runs", 1, 0))
    longest = cut.groupBy(*keys, "pid").count().agg(F.max("count")).first()[0] or 0
    for _ in range(_rounds(longest)):
        units = _round(units, [*keys, "pid"], "i")
    local = settle(units.select(*keys, "pid", "runs", "done"))
    spans = local.groupBy(*keys).agg(F.min("pid").alias("low"), F.max("pid").alias("high"))
    local = local.join(spans, keys)
    whole = local.filter("low = high").select(*keys, "runs", "done")
    crossing = local.filter("low < high").withColumn("i", F.col("pid") - F.col("low")).select(*keys, "i", "runs", "done")
    widest = spans.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 0
    if widest > 1:
        # what is final within a cut needs no further round
        ended = crossing.select(*keys, F.slice("runs", 1, 0).alias("runs"), "done")
        crossing = crossing.withColumn("done", F.slice("runs", 1, 0))
        for _ in range(_rounds(widest)):
            crossing = _round(crossing, keys, "i")
        whole = whole.unionByName(ended).unionByName(crossing.select(*keys, "runs", "done"))
    runs = whole.select(*keys, F.explode(F.concat("runs", "done")).alias("r")).select(*keys, F.col("r.pid").alias("pid"), F.col("r.at").alias("valid_from"), F.col("r.snap").alias("first_snap_id"), F.col("r.hash").alias("content_hash"))
    return _number(runs, keys)


def _number(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers and ends periods. Within a cut by window; between cuts by totals of cuts, a few rows an entity."""
    within = Window.partitionBy(*keys, "pid").orderBy("valid_from")
    between = Window.partitionBy(*keys).orderBy("pid")
    runs = runs.withColumn("n", F.row_number().over(within)).withColumn("next", F.lead("valid_from").over(within))
    cuts = runs.groupBy(*keys, "pid").agg(F.count("*").alias("k"), F.min("valid_from").alias("begin"))
    cuts = cuts.select(
        *keys, "pid",
        F.coalesce(F.sum("k").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("begin").over(between).alias("after"),
    )
    return runs.join(cuts, [*keys, "pid"]).select(*keys, (F.col("before") + F.col("n")).cast("int").alias("period_no"), "valid_from", F.coalesce("next", "after").alias("valid_to"), "first_snap_id", "content_hash")


#: Punctuation and digits in full width, and what they are in ASCII.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def plain(column: str) -> Column:
    """A text without differences of width, case and spacing."""
    return F.lower(F.regexp_replace(F.translate(F.col(column), _WIDE, _ASCII), r"(?U)\s+", ""))


def usable_key(column: str) -> Column:
    """A trimmed key; null where it is blank or stands for nothing."""
    text = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(text).isin("", "-", "null", "none", "n/a"), None).otherwise(text)


def notice_looks(versions: DataFrame) -> DataFrame:
    """Looks at notices from version items: entity (source_code, notice_external_id), content and signature.

    A missing external id is taken from other looks with the same notice hash; if none has one, the
    look's entity is its hash, under a null external id. Hashes are compared without case, padding and
    prefix. The signature covers what the hash covers, but for the body, which isn't kept."""
    sha = F.lower(usable_key("content_hash"))
    amount = F.expr("try_cast(regexp_replace(budget_amount, '[^0-9.]', '') as decimal(20,2))")
    moment = F.expr("try_cast(trim(deadline_at) as timestamp)")
    v = versions.select(
        "source_code", F.col("snap_id").cast("long").alias("snap_id"), F.col("observed_at").cast("timestamp").alias("observed_at"),
        usable_key("notice_external_id").alias("ext"), F.lower(usable_key("notice_dedup_hash")).alias("dh"),
        F.regexp_replace(sha, "^(sha-?256[:=])", "").alias("content_hash"),
        F.xxhash64(
            plain("title"), plain("notice_type"), plain("issuer"), plain("region"),
            F.coalesce(F.unix_seconds(moment).cast("string"), plain("deadline_at")), F.coalesce(amount.cast("string"), plain("budget_amount")),
        ).alias("signature"),
    )
    known = v.filter(F.col("ext").isNotNull() & F.col("dh").isNotNull()).groupBy("source_code", "dh").agg(F.min("ext").alias("known_ext"))
    lacking = v.filter(F.col("ext").isNull()).join(known, ["source_code", "dh"], "left").withColumn("ext", F.col("known_ext")).drop("known_ext")
    v = v.filter(F.col("ext").isNotNull()).unionByName(lacking)
    return v.select(
        F.coalesce("source_code", F.lit("")).alias("source_code"),
        F.when(F.col("ext").isNotNull(), F.concat(F.lit("e:"), "ext")).otherwise(F.concat(F.lit("h:"), "dh")).alias("entity"),
        "observed_at", "snap_id", "content_hash", "signature",
    )


def notice_history(versions: DataFrame) -> DataFrame:
    """(source_code, notice_external_id, notice_hash, period_no, valid_from, valid_to, first_snap_id, content_hash)."""
    periods = coalesce_history(notice_looks(versions), ["source_code", "entity"])
    by_id = F.col("entity").startswith("e:")
    name = F.substring("entity", 3, 1 << 20)
    return periods.select("source_code", F.when(by_id, name).alias("notice_external_id"), F.when(~by_id, name).alias("notice_hash"), "period_no", "valid_from", "valid_to", "first_snap_id", "content_hash")
