"""All queries of the plans, and their SQL."""

from __future__ import annotations

from noticeforge.plans import crawlbook, extraction, identitybook, reportbook, suppression, typed, writes

BOOKS = (reportbook, identitybook, extraction, typed, suppression, writes, crawlbook)
QUERIES: dict = {name: f for book in BOOKS for name, f in book.QUERIES.items()}
ORACLES: dict = {name: text for book in BOOKS for name, text in getattr(book, "ORACLES", {}).items()}
