"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import boilerplate, history_dedup, leaks, lookalikes, mixing, names, stuffed_pages, truth
from noticeforge.session import settle
from noticeforge.sources.tables import table

NAMED = ["title", "issuer", "region"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return history_dedup.repeated(table(spark, sf, "notice_item"))


def _truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "notice_item")
    members = settle(truth.members_of(history_dedup.repeated(items)))
    return truth.discover(members, items, table(spark, sf, "source_zone"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf)[0].select(F.col("g").alias("first_item_id"), "field_name", "item_id")


def p3_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """What the sources' claims are worth."""
    return _truth(spark, sf)[1]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.linked_pairs(table(spark, sf, "issuer_name"))


def p4_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling with the smallest id of its body and the number of its spellings."""
    return names.bodies(table(spark, sf, "issuer_name"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.found(table(spark, sf, "raw_document_item"), table(spark, sf, "notice_item"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.found(table(spark, sf, "notice_item"), NAMED).withColumnRenamed("id", "item_id")


def p7_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Each disguised value with its canonical form."""
    return lookalikes.canonical_values(table(spark, sf, "notice_item"), NAMED).withColumnRenamed("id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents, and the longest run."""
    found = leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_item"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("length").alias("longest_run"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_target"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages.found(table(spark, sf, "documents"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages.scored(table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_reliability": p3_reliability, "p4_found": p4_found, "p4_bodies": p4_bodies, "p5_found": p5_found, "p7_found": p7_found, "p7_canonical": p7_canonical, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores}
ORACLES: dict[str, str] = {}
