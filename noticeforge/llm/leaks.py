"""Evaluation passages inside corpus documents (problem 8).

Spaced seeds: fixed masks over token positions, of which only some count, are hashed at every position of the
evaluation items and of the documents, so a hit survives exchanged tokens at the ignored positions. Each hit
names an item and a diagonal; along it the two token rows are compared and the best run is taken, then the best
of what it leaves and so on, a token that agrees counting 1 and one that doesn't `-EXCHANGE`. A run of `MIN_CHARS`
characters or `MIN_WORDS` words leaks, exchanged ones included, if `AGREE` of them agree.

Tokens are letters and digits without width, case and accents, characters for one row and words for another; so
punctuation, spacing and width don't matter. Chinese items are looked up by characters, others by words.

Standard clauses are told by the items themselves: a stretch that two items share, both having other text besides,
is a clause, however often it occurs. One that a single item quotes is told by the corpus: a stretch of an item
with the same bounds, give or take `CLAUSE_EDGE` tokens, in more than `CLAUSE_SHARE` of all texts, and in at least
`CLAUSE_LEAST`, that don't hold the item's other text. What is left of each run without clauses must still be long
enough. Copies are one text, so neither a copied leak nor one of whole items is taken for a clause. Only documents
that are nothing but the stretch count each: they hold no text of their own that could be a copy.

The evaluation items are a stated query set: they are taken in blocks of at most `BLOCK_SEEDS` seeds, and a
block's table is sent to the tasks. More items make more blocks, not a larger table.

Defined results: null and empty texts leak nothing; items shorter than the least run can't leak; each
(document, item) is one row, from its run with the longest remainder.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm.folding import codes_of, folded
from noticeforge.session import settle

MIN_CHARS, MIN_WORDS, EXCHANGE, AGREE = 30, 12, 1.5, 0.8
CLAUSE_SHARE, CLAUSE_LEAST, CLAUSE_EDGE = 0.005, 8, 3
#: Text beside a stretch counts if it has at least the least run divided by this.
REST = 3
BLOCK_SEEDS = 1 << 20
#: Masks: positions that count. Characters and words.
CHAR_MASKS = ("1110110101", "11010010111", "101100110011")
WORD_MASKS = ("11011", "1100101", "101011")

_WORDS = re.compile("[^\\W_㐀-鿿]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_MARKS = re.compile("[\u0300-\u036f]")
_HAN = re.compile("[㐀-鿿]")
RUNS = "doc_id long, item_id long, first int, last int, words boolean, whole int, copy string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, equal in every task, and how many each text has. Han isn't words."""
    rows = [_WORDS.findall(t if t.isascii() or not _MARKS.search(t) else unicodedata.normalize("NFKC", t)) if t else [] for t in texts]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = [w for r in rows for w in r]
    if not flat:
        return np.empty(0, np.uint64), lengths
    place: dict[str, int] = {}
    index = [place.setdefault(w, len(place)) for w in flat]
    distinct = [(w if w.isascii() else unicodedata.normalize("NFKC", w)).casefold() for w in place]
    codes, sizes = codes_of(distinct)
    begin = np.cumsum(sizes) - sizes
    within = np.arange(len(codes)) - np.repeat(begin, sizes)
    hashes = _mix(np.add.reduceat(_mix(codes.astype(np.uint64) + np.uint64(1)) * (within.astype(np.uint64) * _M + np.uint64(0x2545F4914F6CDD1D)), begin))
    return hashes[index], lengths


def seeds(mixed: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position at which it fits. mixed: tokens through _mix."""
    n = len(mixed) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, odd = np.full(n, len(mask), np.uint64), _M
    for k, bit in enumerate(mask):
        if bit == "1":
            h += mixed[k : k + n] * odd
        odd = np.uint64((int(odd) * 0xD6E8FEB86659FD93 + 2) % (1 << 64) | 1)
    return h ^ (h >> np.uint64(29))


def best_runs(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row first and end of the run of the highest score, ends agreeing; of several the first."""
    total = np.zeros((equal.shape[0], equal.shape[1] + 1), np.float32)
    np.cumsum(np.where(equal, np.float32(1), np.float32(-EXCHANGE)), axis=1, out=total[:, 1:])
    low = np.minimum.accumulate(total, axis=1)
    end = np.argmax(total - low, axis=1)
    # the run begins at the last place before its end at which the total was lowest
    place = np.arange(total.shape[1])[None, :]
    at_low = (total == np.take_along_axis(low, end[:, None], axis=1)) & (place <= end[:, None])
    return total.shape[1] - 1 - np.argmax(at_low[:, ::-1], axis=1), end


class _Block:
    """Seeds of some items, to look documents up."""

    def __init__(self, items: list[tuple[int, str]], words: bool):
        self.words, self.masks, self.least = words, WORD_MASKS if words else CHAR_MASKS, MIN_WORDS if words else MIN_CHARS
        tokens, lengths = (words_of if words else folded)([text for _, text in items])
        self.items = [(i, t) for (i, _), t in zip(items, np.split(tokens, np.cumsum(lengths)[:-1])) if len(t) >= self.least]
        parts = [(s, np.full(len(s), k), np.arange(len(s))) for k, (_, t) in enumerate(self.items) for m in self.masks for s in [seeds(_mix(t), m)]]
        hashes, owner, at = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))
        order = np.argsort(hashes, kind="stable")
        self.ids = np.array([i for i, _ in self.items], dtype=np.int64)
        self.sizes = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.padded = np.zeros((len(self.items), max(map(len, (t for _, t in self.items)), default=0)), np.uint64)
        for row, (_, t) in zip(self.padded, self.items):
            row[: len(t)] = t
        self.hashes, self.owner, self.at = hashes[order], owner[order], at[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def runs(self, tokens: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first, end, item's size) of the runs of each pair; documents begin at starts in tokens."""
        parts, mixed = [], _mix(tokens)
        for mask in self.masks:
            h = seeds(mixed, mask)
            hit = np.flatnonzero(self.filter[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            left = np.searchsorted(self.hashes, h[hit], "left")
            n = np.searchsorted(self.hashes, h[hit], "right") - left
            at = np.repeat(hit, n)
            seed = np.repeat(left, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            parts.append(np.stack([self.owner[seed], at - self.at[seed], np.searchsorted(starts, at, "right") - 1]))
        # each diagonal of an item in a document once
        k, shift, d = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), int)
        order = np.lexsort((d, shift, k))
        k, shift, d = k[order], shift[order], d[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (shift[1:] != shift[:-1]) | (d[1:] != d[:-1])
        k, shift, d = k[new], shift[new], d[new]
        ends = np.append(starts[1:], len(tokens))
        lo, hi = np.maximum(shift, starts[d]), np.minimum(shift + self.sizes[k], ends[d])
        some = hi - lo >= self.least
        k, shift, d, lo, hi = k[some], shift[some], d[some], lo[some], hi[some]
        out = []
        step = max(1, (1 << 21) // (self.padded.shape[1] + 1))
        for i in range(0, len(k), step):
            j = slice(i, i + step)
            at = shift[j, None] + np.arange(self.padded.shape[1])[None, :]
            inside = (at >= lo[j, None]) & (at < hi[j, None])
            equal, rows = (tokens[np.clip(at, 0, len(tokens) - 1)] == self.padded[k[j]]) & inside, np.arange(i, min(i + step, len(k)))
            while len(rows):  # what one run leaves of its diagonal may hold another
                first, end = best_runs(equal)
                long = end - first >= self.least
                rows, first, end, equal = rows[long], first[long], end[long], equal[long]
                place = np.arange(equal.shape[1])[None, :]
                run = (place >= first[:, None]) & (place < end[:, None])
                alike = (equal & run).sum(axis=1) >= AGREE * (end - first)
                out.append(np.stack([d[rows], self.ids[k[rows]], first, end, self.sizes[k[rows]]])[:, alike])
                equal &= ~run
        # positions are those in the item
        return list(map(tuple, np.unique(np.concatenate(out, axis=1), axis=1).T.tolist())) if out else []


def item_blocks(items: list[tuple[int, str]], block_seeds: int = BLOCK_SEEDS) -> list[tuple[list, list]]:
    """Items by blocks of at most so many seeds: those looked up by characters, those by words."""
    blocks, size = [([], [])], 0
    for i, text in items:
        n = 3 * len(text or "")
        if size and size + n > block_seeds:
            blocks.append(([], []))
            size = 0
        blocks[-1][0 if _HAN.search(text or "") else 1].append((i, text))
        size += n
    return blocks


def _run_rows(chars: list, words: list):
    def rows(batches):
        tables = [b for b in (_Block(chars, False), _Block(words, True)) if b.items]
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            out = []
            for b in tables:
                tokens, lengths = (words_of if b.words else folded)(pdf["text"].tolist())
                if not len(tokens):
                    continue
                starts = np.cumsum(lengths) - lengths
                kept = lengths > 0
                ids, texts, sizes = pdf["doc_id"].to_numpy()[kept], pdf["text"].to_numpy()[kept], lengths[kept]
                copies: dict[int, str] = {}
                for d, i, f, e, whole in b.runs(tokens, starts[kept]):
                    copy = str(ids[d]) if sizes[d] - (e - f) < b.least // REST else copies.get(d) or copies.setdefault(d, hashlib.md5(texts[d].encode("utf-8", "surrogatepass")).hexdigest())
                    out.append((ids[d], i, f, e, b.words, whole, copy))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "first", "last", "words", "whole", "copy"])

    return rows


def runs(documents: DataFrame, items: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, first, last, words, whole, copy): the runs of items in each document, clauses included; whole
    is the item's size, and copy is equal for documents of the same text."""
    listed = [(r.item_id, r.text) for r in items.filter(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id").toLocalIterator()]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for chars, words in item_blocks(listed, block_seeds):
        part = texts.mapInPandas(_run_rows(chars, words), RUNS)
        result = part if result is None else result.unionByName(part)
    return result


def clause_positions(spans: list[tuple[int, int, int]], limit: float) -> set[int]:
    """Positions of an item in its clauses. spans: first, end, and number of texts with that run and no other text of the item."""
    count: Counter = Counter()
    out: set[int] = set()
    for f, e, n in spans:
        count[f, e] += n
    for f, e in count:
        near = [(a, b, count[a, b]) for a in range(f - CLAUSE_EDGE, f + CLAUSE_EDGE + 1) for b in range(e - CLAUSE_EDGE, e + CLAUSE_EDGE + 1) if (a, b) in count]
        if sum(n for *_, n in near) > limit:
            # of the stretch what is in more texts than the limit
            out.update(at for at in range(f - CLAUSE_EDGE, e + CLAUSE_EDGE) if sum(n for a, b, n in near if a <= at < b) > limit)
    return out


def _clauses(limit: float):
    def rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clause = clause_positions(list(zip(pdf["first"].tolist(), pdf["last"].tolist(), pdf["n"].tolist())), limit)
        return pd.DataFrame({"item_id": [key[0]], "words": [key[1]], "clause": [sorted(clause)]})

    return rows


def shared_positions(items: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(item_id, words, shared): positions of an item in stretches that another item has too. Items that are nothing
    but the stretch are copies of a passage, not witnesses of a clause."""
    among = runs(items.select(F.col("item_id").alias("doc_id"), "text"), items, block_seeds)
    least = F.when(F.col("words"), MIN_WORDS).otherwise(MIN_CHARS)
    clause = among.filter((F.col("doc_id") != F.col("item_id")) & (F.col("copy") != F.col("doc_id").cast("string")) & (F.col("whole") - (F.col("last") - F.col("first")) >= F.floor(least / REST)))
    return clause.groupBy("item_id", "words").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", F.col("last") - 1)))).alias("shared"))


def leaks(documents: DataFrame, items: DataFrame, clause_share: float = CLAUSE_SHARE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, length, words) of the runs that are long enough without standard clauses."""
    found = settle(runs(documents, items, block_seeds).distinct())
    limit = max(CLAUSE_LEAST - 1, clause_share * documents.agg(F.countDistinct(F.xxhash64("text"))).first()[0])
    least = F.when(F.col("words"), MIN_WORDS).otherwise(MIN_CHARS)
    # runs of texts that leave out some of the item's text
    texts = found.groupBy("item_id", "words", "whole", "copy").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    held = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"] - 1)))))
    alone = texts.filter(F.col("whole") - held >= F.floor(least / REST)).select("item_id", "words", F.explode("runs").alias("r")).groupBy("item_id", "words", "r.first", "r.last").agg(F.count("*").alias("n"))
    clauses = alone.groupBy("item_id", "words").applyInPandas(_clauses(limit), "item_id long, words boolean, clause array<int>")
    clauses = clauses.join(shared_positions(items.dropDuplicates(["item_id"]), block_seeds), ["item_id", "words"], "full").select("item_id", "words", F.concat(F.coalesce("clause", F.array().cast("array<int>")), F.coalesce("shared", F.array().cast("array<int>"))).alias("clause"))
    spans = found.select("item_id", "words", "first", "last").distinct().join(clauses, ["item_id", "words"], "left")
    # the longest stretch of a span outside clauses
    longest = F.aggregate(
        F.sequence("first", F.col("last") - 1),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, at: F.struct(F.when(F.array_contains("clause", at), 0).otherwise(s["now"] + 1).alias("now"), F.greatest(s["best"], F.when(F.array_contains("clause", at), 0).otherwise(s["now"] + 1)).alias("best")),
        lambda s: s["best"],
    )
    length = F.when(F.col("clause").isNull(), F.col("last") - F.col("first")).otherwise(longest)
    kept = spans.withColumn("length", length).filter(F.col("length") >= least).select("item_id", "words", "first", "last", "length")
    return found.join(kept, ["item_id", "words", "first", "last"]).groupBy("doc_id", "item_id", "words").agg(F.max("length").alias("length")).select("doc_id", "item_id", "length", "words")
