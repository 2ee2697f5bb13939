"""One best value a field for each group of records of one notice (problem 3).

Iterative truth discovery: a value's votes are the reliabilities of the sources that claim it; the value
with the highest support is taken as true; a source's reliability is the share of its claims that agree
with what was taken; both are estimated in turn until no reliability moves by more than `TOLERANCE`.

Support is ordered by what a claim can know: its class (exact before approximate, time of day before a
bare date), then how recently it was collected, then votes. So votes decide where claims of one class and
moment differ, and, for names, where all claims are of one moment in effect: there recency says nothing.

Names are claimed by the sources that typed them and by the sources' texts, which are claimants of their own: a
row's text claims each complete name typed in its group that it contains. All claims vote; a short form that most
rows typed can lose to the full name the texts give, and a source that often types short forms counts less
elsewhere. A name is complete if some text contains it as typed with it, and no longer typed name regularly
stands there in its place (`_longer`, learned over all rows). The name of the highest support is given out if it
is complete; where it isn't, the group has no usable name.

Claims are folded to (group, field, value, source) before anything moves, so a group that holds a third of
all rows, or a source that does, is a few rows by then. Reliabilities stay a table.

Defined results: filler and unusable values make no claim; a group of one record, or without a usable
value, gives no row for the field; equal values give the smallest id of those of the winning class. If
reliabilities still move by more than `TOLERANCE` after `ROUNDS`, a warning says so, and the report's `moved` by how much.
"""

from __future__ import annotations

import re
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.llm.lookalikes import canonical_udf
from noticeforge.operators.timestamps import normalise_timestamps
from noticeforge.session import settle

ROUNDS, TOLERANCE, START = 30, 0.005, 0.8
#: Characters that a longer name may have before or after a shorter one, and the share of the shorter one's rows it needs.
MORE, REGULAR = 10, 0.5

# Full-width forms in amounts.
_WIDE, _ASCII = "０１２３４５６７８９．，￥（）　", "0123456789.,¥() "


def amount(column: str) -> tuple[Column, Column]:
    """The amount as decimal, null where there is none or it is zero; and whether it is exact."""
    x = F.lower(F.regexp_replace(F.translate(F.col(column), _WIDE, _ASCII), r"(?U)[\s\p{Cf}]+", ""))
    digits = F.regexp_replace(F.regexp_extract(x, r"(\d[\d.,]*)", 1), r"[.,]+$", "")
    european = digits.rlike(r"^\d{1,3}(\.\d{3})+,\d{1,2}$") | digits.rlike(r"^\d{1,3}(\.\d{3}){2,}$") | (digits.rlike(r"^\d{1,3}(\.\d{3})+$") & x.rlike("eur|€"))
    plain = F.when(european, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(digits.rlike(r"^\d+,\d{1,2}$"), F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    unit = F.when(x.contains("亿"), 100_000_000).when(x.contains("万"), 10_000).when(x.rlike(r"\dk\b|\dk$"), 1_000).when(x.rlike(r"\d(m|mn|million)\b"), 1_000_000).otherwise(1)
    value = (plain.try_cast("decimal(24,6)") * unit).try_cast("decimal(24,2)")
    return F.when(value > 0, value), ~x.rlike("约|左右|预计|大概|上下|approx|about|circa|ca\\.|~")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _extended_udf(texts: pd.Series, names: pd.Series) -> pd.Series:
    """What stands in a text where a name does, with up to MORE characters of its line before it or after it."""

    def forms(text: str, name: str) -> list[str]:
        out = set()
        for m in re.finditer(re.escape(name), text):
            begin = max(text.rfind("\n", 0, m.start()) + 1, m.start() - MORE)
            end = text.find("\n", m.end(), m.end() + MORE)
            out |= {text[k : m.end()] for k in range(begin, m.start())} | {text[m.start() : k] for k in range(m.end() + 1, (m.end() + MORE if end < 0 else end) + 1)}
        return sorted(out)

    return pd.Series([forms(t, n) for t, n in zip(texts, names)], dtype=object)


def _names(items: DataFrame) -> DataFrame:
    """(value, complete) of names that some text contains as typed with it."""
    typed = items.select(F.trim(canonical_udf("issuer")).alias("value"), "content_text").filter(F.length("value") >= 4)
    told = typed.filter(F.contains("content_text", "value"))
    rows = settle(told.groupBy("value").agg(F.count("*").alias("n")))
    extended = told.select("value", F.explode(_extended_udf("content_text", "value")).alias("longer")).groupBy("value", "longer").agg(F.count("*").alias("m"))
    longer = extended.join(rows.select(F.col("value").alias("longer")), "longer", "left_semi").join(rows, "value").filter(F.col("m") >= REGULAR * F.col("n"))
    return rows.join(longer.select("value").distinct().withColumn("part", F.lit(True)), "value", "left").select("value", F.col("part").isNull().alias("complete"))


def _claims(members: DataFrame, items: DataFrame, zones: DataFrame) -> DataFrame:
    """(g, field_name, value, class, source, latest, item_id, complete) of the usable values of records in groups."""
    fields = ["item_id", "source_code", "crawled_at", "budget_amount", "deadline_at", "issuer"]
    of = items.select(*fields, "content_text").join(members, "item_id").withColumn("source_code", F.coalesce("source_code", F.lit("")))
    rows = settle(of.select("g", *fields))
    value, exact = amount("budget_amount")
    budgets = rows.select("g", F.lit("budget_amount").alias("field_name"), value.cast("string").alias("value"), exact.cast("int").alias("class"), "source_code", "crawled_at", "item_id")
    times = normalise_timestamps(rows, zones, ["deadline_at"]).select(F.col("id").alias("item_id"), "utc_second", "has_time").distinct()
    deadlines = rows.select("g", "source_code", "crawled_at", "item_id").join(times, "item_id").select("g", F.lit("deadline_at").alias("field_name"), F.col("utc_second").cast("string").alias("value"), F.col("has_time").cast("int").alias("class"), "source_code", "crawled_at", "item_id")
    names = settle(_names(items))
    typed = settle(rows.select("g", F.trim(canonical_udf("issuer")).alias("value"), "source_code", "item_id").filter(F.length("value") >= 4).join(names, "value", "left"))
    usable = typed.filter("complete").select("g", "value").distinct()
    texts = of.filter(F.col("content_text").isNotNull()).select("g", F.concat(F.lit("text of "), "source_code").alias("source_code"), "content_text").join(usable, "g")
    texts = texts.filter(F.contains("content_text", "value")).select("g", "value", "source_code", F.lit(None).cast("long").alias("item_id"), F.lit(True).alias("complete"))
    said = typed.select("g", "value", "source_code", "item_id", F.coalesce("complete", F.lit(False)).alias("complete")).unionByName(texts)
    said = said.select("g", F.lit("issuer").alias("field_name"), "value", F.lit(1).alias("class"), "source_code", F.lit(None).cast("timestamp").alias("crawled_at"), "item_id", "complete")
    every = budgets.unionByName(deadlines).withColumn("complete", F.lit(True)).unionByName(said).filter(F.col("value").isNotNull())
    return every.groupBy("g", "field_name", "value", "class", F.col("source_code").alias("source")).agg(F.max("crawled_at").alias("latest"), F.min("item_id").alias("item_id"), F.max("complete").alias("complete"))


def _chosen(claims: DataFrame, reliability: DataFrame) -> DataFrame:
    """(g, field_name, value, item_id, votes, complete): the value of the highest support."""
    support = claims.join(reliability, "source").groupBy("g", "field_name", "value", "class").agg(F.max("latest").alias("latest"), F.min("item_id").alias("item_id"), F.round(F.sum("reliability"), 6).alias("votes"), F.max("complete").alias("complete"))
    best = F.max_by(F.struct("value", "item_id", "votes", "complete"), F.struct("class", F.coalesce("latest", F.timestamp_micros(F.lit(0))), "votes", -F.coalesce("item_id", F.lit((1 << 62)))))
    return support.groupBy("g", "field_name").agg(best.alias("b")).select("g", "field_name", "b.*")


def _reliability(claims: DataFrame, chosen: DataFrame) -> DataFrame:
    """Agreement of each source's claims with what was taken, smoothed towards the start."""
    taken = chosen.select("g", "field_name", F.col("value").alias("taken"))
    agree = claims.join(taken, ["g", "field_name"]).groupBy("source").agg(F.count_if(F.col("value") == F.col("taken")).alias("yes"), F.count("*").alias("n"))
    return agree.select("source", F.round((F.col("yes") + 2 * START) / (F.col("n") + 2), 6).alias("reliability"))


def discover(members: DataFrame, items: DataFrame, zones: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, start: float = START) -> tuple[DataFrame, DataFrame]:
    """The best values (g, field_name, value, item_id, votes), by the reliabilities that are returned with them
    (source, reliability, moved). members: (g, item_id) of groups of at least two records. With rounds=0 all
    sources count `start`."""
    claims = settle(_claims(members, items, zones))
    reliability = claims.select("source").distinct().withColumn("reliability", F.lit(float(start)))
    moved: float | None = 0.0 if not rounds else None
    for _ in range(rounds):
        new = settle(_reliability(claims, _chosen(claims, reliability)))
        moved = new.join(reliability.withColumnRenamed("reliability", "old"), "source").agg(F.max(F.abs(F.col("reliability") - F.col("old")))).first()[0] or 0.0
        reliability = new
        if moved <= tolerance:
            break
    if moved is None or moved > tolerance:
        warnings.warn(f"reliabilities still move by {moved} after {rounds} rounds", stacklevel=2)
    best = _chosen(claims, reliability).filter("complete and item_id is not null").drop("complete")
    return best, reliability.withColumn("moved", F.lit(moved))


def members_of(repeats: DataFrame) -> DataFrame:
    """(g, item_id) of all records of notices with several records, from (kept_item_id, item_id)."""
    g = F.col("kept_item_id").alias("g")
    return repeats.select(g, "item_id").unionByName(repeats.select(g).distinct().select("g", F.col("g").alias("item_id")))
