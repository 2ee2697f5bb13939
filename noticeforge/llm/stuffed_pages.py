"""Pages of stuffed keywords, links or product tags (problem 10).

The suffix automaton of a page's text gives, for each position, the longest suffix ending there that occurs
again elsewhere in the page; the characters under those of at least `MIN_REPEAT` characters are covered by
repeated maximal substrings. Clause structure is what sentences cover: a stretch that ends in a stop, or an
English one that begins with a capital. A page is a case if sentences that aren't themselves repeated or made
of links cover less than `MIN_CLAUSES` of it, and either little of it is new text or much of it is links and
tags. How much new text is little depends on all clauses, repeated ones too: from half the page where there are
none, as tags repeat less on a short page, down to `MAX_NEW` where they cover `BARE`. So lists of goods or telephone numbers, whose lines differ in their figures, aren't cases.

The clauses are found first. Characters covered by repeats of MIN_REPEAT or more are those in a window of
exactly MIN_REPEAT characters that occurs twice, so counting windows bounds the coverage; a page whose
uncovered sentences reach MIN_CLAUSES by that bound can't be a case. The automaton is built for every other
page, over its whole text. With `screen=False` it is built for every page; the result is the same.

Defined results: null and empty texts aren't cases; texts shorter than MIN_REPEAT have no repeats.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeforge.llm.folding import codes_of

MIN_REPEAT = 4
MIN_CLAUSES, MAX_NEW, MIN_LINKS = 0.2, 0.3, 0.4
#: New text that a page without any clause may have, as most of it still repeats; and the share of clauses, repeated
#: or not, from which MAX_NEW holds. Texts around a list of goods have 0.14 and more.
MAX_NEW_BARE, BARE = 0.5, 0.05

# What separates clauses, and what ends one.
_BREAKS, _STOPS = "。！？；!?;\n#|", "。！？；"
_ENGLISH = re.compile(r"[A-Z][^.!?\n#|]{20,}[.!?;](?=\s|$)")
_LINK = re.compile(r"<a\b[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)|https?://\S+|#\S+", re.S)
_M = np.uint64(0x9E3779B97F4A7C15)
_BREAK_CODES, _STOP_CODES = (np.array(sorted(map(ord, x)), dtype=np.uint32) for x in (_BREAKS, _STOPS))

SCORE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("covered", "clauses", "new", "links")] + [T.StructField("is_case", T.BooleanType())])


def windows_covered(codes: np.ndarray, lengths: np.ndarray, m: int = MIN_REPEAT) -> np.ndarray:
    """Marks the characters in windows of m characters that occur more than once in their text."""
    n = len(codes)
    if n < m:
        return np.zeros(n, bool)
    text = np.repeat(np.arange(len(lengths)), lengths)
    a, h = codes.astype(np.uint64), text[: n - m + 1].astype(np.uint64) * _M
    for k in range(m):
        h = (h + a[k : len(h) + k] + np.uint64(1)) * _M
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(text[: n - m + 1] == text[m - 1 :])
    h = h[inside]
    # most windows are alone in their slot; only the others are sorted
    slot = (h >> np.uint64(42)).astype(np.int64)
    shared = (np.bincount(slot, minlength=1 << 22) > 1)[slot]
    h, inside = h[shared], inside[shared]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    at = inside[twice]
    edge[at] += 1
    edge[at + m] -= 1
    return np.cumsum(edge[:-1]) > 0


def automaton_covered(text: str, m: int = MIN_REPEAT) -> np.ndarray:
    """The same by the suffix automaton: marks what repeated substrings of at least m characters cover."""
    length, link, edges, prefixes = [0], [-1], [{}], []
    last = 0
    for c in text:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(edges[q].copy())
                link[q] = link[now] = clone
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        prefixes.append(now)
        last = now
    # a state occurs as often as prefixes lie below it; the longest repeated suffix of a prefix is its
    # nearest state upwards that occurs twice
    count = [0] * len(length)
    for v in prefixes:
        count[v] = 1
    by_length = sorted(range(1, len(length)), key=length.__getitem__)
    for v in reversed(by_length):
        count[link[v]] += count[v]
    repeated = [0] * len(length)
    for v in by_length:
        repeated[v] = length[v] if count[v] > 1 else repeated[link[v]]
    edge = np.zeros(len(text) + 1, np.int32)
    for i, v in enumerate(prefixes):
        if repeated[v] >= m:
            edge[i + 1 - repeated[v]] += 1
            edge[i + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _sentences(texts: list[str], codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks what clauses cover, and what links and tags cover. Where Latin letters outnumber Han, clauses are
    English ones."""
    n = len(codes)
    starts = np.cumsum(lengths) - lengths
    breaks = np.isin(codes, _BREAK_CODES)
    stops = np.flatnonzero(np.isin(codes, _STOP_CODES))
    bounds = np.concatenate([[-1], np.flatnonzero(breaks)])  # a clause begins after a break or with its text
    before = np.maximum(bounds[np.searchsorted(bounds, stops) - 1] + 1, starts[np.searchsorted(starts, stops, "right") - 1])
    long = stops - before >= 8
    edge = np.zeros(n + 1, np.int32)
    edge[before[long]] += 1
    edge[stops[long] + 1] -= 1
    sentence = np.cumsum(edge[:-1]) > 0
    links = np.zeros(n, bool)
    text = np.repeat(np.arange(len(texts)), lengths)
    han = np.bincount(text[(codes >= 0x3400) & (codes <= 0x9FFF)], minlength=len(texts))
    latin = np.bincount(text[((codes | 32) >= 97) & ((codes | 32) <= 122)], minlength=len(texts))
    for k in np.flatnonzero(latin > han):
        sentence[starts[k] : starts[k] + lengths[k]] = False
        for x in _ENGLISH.finditer(texts[k]):
            sentence[starts[k] + x.start() : starts[k] + x.end()] = True
    for k, t in enumerate(texts):
        if t and ("http" in t or "#" in t or "<a" in t or "](" in t):
            for x in _LINK.finditer(t):
                links[starts[k] + x.start() : starts[k] + x.end()] = True
    # a clause around a link isn't one
    touched = np.zeros(n + 1, np.int64)
    np.cumsum(links, out=touched[1:])
    for b, e in zip(before[long], stops[long] + 1):
        if touched[e] > touched[b]:
            sentence[b:e] = False
    return sentence & ~links, links


def _shares(mask: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[starts + lengths] - total[starts]) / np.maximum(lengths, 1)


def scores(texts: list[str | None], screen: bool = True) -> pd.DataFrame:
    """Shares of pages: covered by repeats, in clauses of their own, new text, links; and whether each is a case."""
    texts = [t or "" for t in texts]
    codes, lengths = codes_of(texts)
    starts = np.cumsum(lengths) - lengths
    sentence, links = _sentences(texts, codes, lengths)
    covered = windows_covered(codes, lengths)
    open_ = _shares(sentence & ~covered, starts, lengths) < MIN_CLAUSES if screen else np.ones(len(texts), bool)
    for k in np.flatnonzero(open_ & (lengths > 0)):
        covered[starts[k] : starts[k] + lengths[k]] = automaton_covered(texts[k])
    out = {"covered": covered, "clauses": sentence & ~covered, "new": ~covered & ~links, "links": links}
    out = pd.DataFrame({k: _shares(v, starts, lengths) for k, v in out.items()})
    max_new = MAX_NEW + (MAX_NEW_BARE - MAX_NEW) * np.maximum(0, 1 - _shares(sentence, starts, lengths) / BARE)
    return out.assign(is_case=(lengths > 0) & (out["clauses"] < MIN_CLAUSES) & ((out["new"] < max_new) | (out["links"] > MIN_LINKS)))


@F.pandas_udf(SCORE)
def _score_udf(texts: pd.Series) -> pd.DataFrame:
    return scores(texts.tolist())


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, covered, clauses, new, links, is_case) of each document."""
    return documents.select("doc_id", _score_udf("text").alias("s")).select("doc_id", "s.*")


def found(documents: DataFrame) -> DataFrame:
    return scored(documents).filter("is_case").select("doc_id").distinct()
