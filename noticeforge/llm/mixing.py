"""Sources mixed to target weights (problem 9).

Systematic sampling: within a source, documents are put in order, each one's expected copies are summed up
along it, one random offset is added, and a document is emitted once per integer that its stretch of the sum
crosses. All documents of a source expect the same number of copies, the source's target tokens divided by its
tokens, so each is used that number rounded down or up. The order is by size, which keeps the tokens drawn
within about one document of the target.

The size of a plan is the largest at which no source needs more than max_repeats copies of a document (or
`tokens`, if less). A source without documents gets nothing; the others keep their proportions.

The sums are formed in three steps: totals of a source's bands of sizes, totals of buckets (source, size, hash of
the id) within a band, and positions within a bucket. No window holds a source, only a bucket's rows, the totals
of a band's buckets or those of a source's bands.

Defined results: documents without source or of a source in no plan are in no selection; null and empty
texts have no tokens and are drawn like others; a doc_id that occurs twice is two documents of one place.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from noticeforge.session import settle

#: Parts that documents of one source and size are split into.
PARTS = 256
#: Bands of sizes for each doubling of a document's tokens.
BANDS = 16
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a vocabulary file of the public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str | None = None):
    """A column function from text to its number of tokens. path: a vocabulary of ranks, on every machine."""

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        encode = _encoding(path or tokenizer_path()).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return n_tokens


def _rates(sizes: DataFrame, targets: DataFrame, tokens: int | None) -> DataFrame:
    """(plan_name, source, target_share, max_repeats, source_tokens, rate): the copies each document expects."""
    each = targets.join(sizes, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("target_share") > 0)
    room = F.min(F.when(usable, F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")))
    plans = each.groupBy("plan_name").agg((F.least(room, F.lit(float(tokens))) if tokens else room).alias("size"))
    rate = F.when(usable, F.least(F.col("target_share") * F.col("size") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return each.join(plans, "plan_name").withColumn("rate", rate)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42, tokens: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (plan_name, source, doc_id, n_tokens, copies) and the report (plan_name, source,
    target_share, max_repeats, source_tokens, selected_documents, selected_tokens, share)."""
    targets = targets.select("plan_name", "source", "target_share", "max_repeats").dropDuplicates(["plan_name", "source"])
    wanted = targets.select("source").distinct()
    counted = settle(
        documents.filter(F.col("source").isNotNull()).select("doc_id", "source", "text").join(wanted, "source", "left_semi")
        .select("doc_id", "source", token_counter(path)("text").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(PARTS)).alias("part"))
    )
    bucket = ["source", "n_tokens", "part"]
    totals = counted.groupBy(*bucket).agg(F.count("*").alias("n"))
    # sums along a source in two steps: over its bands of sizes, a few hundred, and over buckets within a band
    totals = totals.withColumn("band", F.floor(F.log2(F.col("n_tokens") + 1) * BANDS).cast("int"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bands = totals.groupBy("source", "band").agg(F.sum("n").alias("n")).select("source", "band", F.coalesce(F.sum("n").over(earlier("source").orderBy("band")), F.lit(0)).alias("below"))
    before = totals.withColumn("within", F.coalesce(F.sum("n").over(earlier("source", "band").orderBy("n_tokens", "part")), F.lit(0))).join(bands, ["source", "band"]).select(*bucket, (F.col("below") + F.col("within")).alias("before"))
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("doc_id")) - 1
    placed = counted.withColumn("place", place).join(before, bucket).withColumn("place", F.col("place") + F.col("before")).select("doc_id", "source", "n_tokens", "place")
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rates = settle(_rates(sizes, targets, tokens))
    offset = F.pmod(F.xxhash64("plan_name", "source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    upto = lambda k: F.floor(F.col("rate") * (F.col("place") + k) + offset)
    drawn = placed.join(rates.select("plan_name", "source", "rate"), "source").withColumn("copies", (upto(1) - upto(0)).cast("int")).filter("copies > 0")
    drawn = drawn.select("plan_name", "source", "doc_id", "n_tokens", "copies")
    reached = drawn.groupBy("plan_name", "source").agg(F.sum("copies").alias("selected_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("selected_tokens"))
    report = rates.drop("size", "rate").join(reached, ["plan_name", "source"], "left").fillna(0, ["selected_documents", "selected_tokens"])
    report = report.withColumn("share", F.col("selected_tokens") / F.greatest(F.sum("selected_tokens").over(Window.partitionBy("plan_name")), F.lit(1)))
    return drawn, report
