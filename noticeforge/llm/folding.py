"""Texts of a batch as rows of character numbers, at once for the whole batch."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

_KEPT = re.compile(r"[^\W_]")


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, one after the other, and the texts' lengths."""
    lengths = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
    joined = "".join(t for t in texts if t)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Of each character of the basic plane: how many it becomes, and which, or which if they are several."""
    count, one, several = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.uint32), {}
    for c in range(1 << 16):
        if 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3:
            count[c], one[c] = 1, c
        elif not 0xD800 <= c < 0xE000:
            out = [ord(x) for x in unicodedata.normalize("NFKD", chr(c)).casefold() if _KEPT.match(x)]
            count[c] = len(out)
            if len(out) == 1:
                one[c] = out[0]
            elif out:
                several[c] = out
    return count, one, several


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of the texts without width, case and accents, and how many each text has.
    Marks, blanks and invisible characters are dropped; characters beyond the basic plane stay as they are."""
    codes, lengths = codes_of(texts)
    if not len(codes):
        return np.empty(0, np.uint64), lengths
    count, one, several = _tables()
    low = codes < (1 << 16)
    index = np.where(low, codes, 0)
    n = np.where(low, count[index], 1).astype(np.int64)
    out = np.repeat(np.where(low, one[index], codes), n)
    ends = np.cumsum(n)
    for at in np.flatnonzero(n > 1):
        out[ends[at] - n[at] : ends[at]] = several[int(codes[at])]
    total = np.concatenate([[0], ends])
    stops = np.cumsum(lengths)
    return out.astype(np.uint64), total[stops] - total[stops - lengths]
