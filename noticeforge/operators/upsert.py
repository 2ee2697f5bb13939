"""Items written one after the other: notices resolved by a cascade of keys, merged, versioned and counted.

What an item does depends on all items of its source before it, as keys change while items are merged. But it can
only meet items that share a key with it, directly or through others. So items are cut into components by their
keys (`components`: items contract along keys until no link is left), and each component is folded in the order of
arrival. A fold goes through its partition row by row and keeps only the notices of the component at hand and the
hashes of their versions, never its rows; so a component that holds a large share of all rows costs one task time, as
what is sequential must, but no memory. Texts don't go through it: `summary_seq` names the item that gave the summary.

The cascade: external id, source key, dedup key, dedup hash, then likeness (same title and day, and of issuer,
region and bucket one that agrees if the item has just one, else two), else a new notice, if the item has a title.
Where the surveyed lookup takes any of several rows, the notice created first is taken.

Defined results: items without source, id or time are left out; blank keys are missing; an item that resolves to no
notice, or a version without title or hash, does nothing; replaying a batch on top of itself adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.functions import identity
from noticeforge.session import settle, settle_table

KEYS = ("external_id", "source_duplicate_key", "dedup_key", "dedup_hash")
MERGED = ("project_code", "issuer", "region", "deadline_us", "budget_amount", "budget_currency", "summary_seq")
SIGNALS = ("norm_party", "norm_region", "bucket")
EFFECTS = ("notices_upserted", "deduplicated_count", "source_duplicates_suppressed", "records_inserted", "records_updated")
OUT = (
    "what string, source_code string, seq long, kind string, crawl_job_id long, notice_seq long, outcome string, "
    + ", ".join(f"{e} int" for e in EFFECTS)
    + ", external_id string, source_duplicate_key string, dedup_key string, dedup_hash string, title string, notice_type string, published_us long, first_published_us long, latest_published_us long, "
    + ", ".join(f"{m} {'long' if m.endswith(('_us', '_seq')) else 'string'}" for m in MERGED)
    + ", version_no int, content_hash string, is_current boolean"
)
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def item_stream(notices: DataFrame, versions: DataFrame) -> DataFrame:
    """Notice and version items with their keys and normal forms, numbered as they arrive: (source_code, seq, kind, ...)."""

    def of(df: DataFrame, kind: str, number: str, time: str) -> DataFrame:
        rows = identity.with_keys(df)
        has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        micros = lambda c: F.unix_micros(identity.moment(identity.said(c)))
        amount = F.replace(identity.said("budget_amount"), F.lit(","), F.lit("")).try_cast("decimal(18,2)").cast("string")
        return rows.filter(F.col(number).isNotNull() & F.col("source_code").isNotNull() & F.col(time).isNotNull()).select(
            "source_code", F.col(number).alias("number"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.lit(kind).alias("kind"), "crawl_job_id", *KEYS, identity.said("title").alias("title"), F.col("norm_type").alias("notice_type"),
            "norm_title", *SIGNALS, "published_day", micros("published_at").alias("published_us"), micros("deadline_at").alias("deadline_us"), identity.said(has("project_code")).alias("project_code"), identity.said("issuer").alias("issuer"),
            identity.said("region").alias("region"), amount.alias("budget_amount"), identity.said("budget_currency").alias("budget_currency"), (identity.said(has("summary")).isNotNull() | identity.said(has("content_text")).isNotNull()).alias("summarised"),
            "content_hash", identity.said(has("version_no")).try_cast("int").alias("version_no"), F.coalesce(~F.lower(identity.said(has("is_current"))).isin("0", "false", "no", "n", "off"), F.lit(True)).alias("is_current"))

    both = of(notices, "notice", "item_id", "crawled_at").unionByName(of(versions, "version", "snap_id", "observed_at"))
    # a number that grows with time, and of one time with the table and the row: no sort of everything
    both = both.withColumn("seq", F.col("number") * 2 + (F.col("kind") == "version").cast("long"))
    # texts stay where they are: a notice knows the item that its summary is from
    return both.withColumn("summary_seq", F.when(F.col("summarised"), F.col("seq"))).drop("summarised", "number")


def components(items: DataFrame, keys: dict[str, list]) -> DataFrame:
    """(seq, component) of items that share a key with another: the smallest seq that can be reached along shared keys
    of a source. keys: names and the columns that make each, none of them null. A key links its items to the first
    of them. Each round moves every item to its smallest neighbour and goes on with the links between these, fewer
    than half as many ends as before, until no link is left."""
    known = [F.when(~F.exists(F.array(*(F.col(c).isNull() for c in cs)), lambda x: x), F.xxhash64(F.lit(name), "source_code", *cs)) for name, cs in keys.items()]
    every = items.select("seq", F.explode(F.array_compact(F.array(*known))).alias("key"))
    shared = every.groupBy("key").agg(F.min("seq").alias("a"), F.max("seq").alias("high")).filter("a < high").select("key", "a")
    links = settle(every.join(shared, "key").filter("a < seq").select("a", F.col("seq").alias("b")).distinct())
    labels = links.select(F.col("a").alias("seq")).unionByName(links.select(F.col("b").alias("seq"))).distinct().withColumn("component", F.col("seq"))
    while links.limit(1).count():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("to")))
        labels = settle(labels.join(to, F.col("component") == F.col("v"), "left").select("seq", F.coalesce("to", "component").alias("component")))
        moved = lambda end: to.select(F.col("v").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: E731, B023
        on = links.join(moved("a"), "a").join(moved("b"), "b").filter("to_a != to_b")
        links = settle(on.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    return labels


class Fold:
    """The notices of a component, as they stand after the items so far."""

    def __init__(self):
        self.notices: dict[int, dict] = {}
        self.by: dict[str, dict[str, set[int]]] = {k: {} for k in KEYS}
        self.by_day: dict[tuple, set[int]] = {}
        self.versions: dict[int, list[dict]] = {}
        self.seen: dict[tuple, int] = {}

    def _index(self, table: dict, key, number: int, add: bool) -> None:
        if key is not None:
            entry = table.setdefault(key, set())
            entry.add(number) if add else entry.discard(number)

    def find(self, item: dict) -> int | None:
        for k in KEYS:
            if item[k] is not None and (found := self.by[k].get(item[k])):
                return min(found)
        have = [item[s] for s in SIGNALS]
        n = sum(x is not None for x in have)
        if item["norm_title"] and item["published_day"] and n:
            for number in sorted(self.by_day.get((item["norm_title"], item["published_day"]), ())):
                other = self.notices[number]
                if sum(x is not None and x == other[s] for x, s in zip(have, SIGNALS)) >= min(n, 2):
                    return number
        return None

    def resolve(self, item: dict) -> tuple[int | None, bool]:
        """The item's notice, merged with what the item says, and whether it is new."""
        number = self.find(item)
        created = number is None
        if created:
            if not item["title"]:
                return None, False
            number = item["seq"]
            self.notices[number] = dict.fromkeys((*KEYS, *MERGED, *SIGNALS, "title", "notice_type", "norm_title", "day", "published_us", "first_published_us", "latest_published_us")) | {"budget_currency": "CNY"}
            self.versions[number] = []
        n = self.notices[number]
        for k in KEYS:
            said = item[k] or (item["source_duplicate_key"] if k == "dedup_key" else None)
            if said is not None and said != n[k]:
                self._index(self.by[k], n[k], number, False)
                self._index(self.by[k], said, number, True)
                n[k] = said
        before = (n["norm_title"], n["day"])
        if item["title"]:
            n["title"], n["norm_title"] = item["title"], item["norm_title"]
        n["notice_type"] = item["notice_type"] or n["notice_type"]
        for m in MERGED:
            n[m] = item[m] if item[m] is not None else n[m]
        for s, m in zip(SIGNALS, ("issuer", "region", "budget_amount")):
            n[s] = item[s] if item[m] is not None else n[s]
        self._published(n, item["published_us"])
        if item["published_us"] is not None:
            n["published_us"], n["day"] = item["published_us"], item["published_day"]
        if before != (n["norm_title"], n["day"]):
            self._index(self.by_day, before, number, False)
            self._index(self.by_day, (n["norm_title"], n["day"]) if n["day"] else None, number, True)
        return number, created

    @staticmethod
    def _published(n: dict, at: int | None) -> None:
        if at is not None:
            n["first_published_us"] = at if n["first_published_us"] is None else min(at, n["first_published_us"])
            n["latest_published_us"] = at if n["latest_published_us"] is None else max(at, n["latest_published_us"])

    def _pairs(self, v: dict) -> list[tuple]:
        return [(k, v[k], v["content_hash"]) for k in ("dedup_key", "source_duplicate_key") if v[k] is not None]

    def _stand(self, v: dict, step: int) -> None:
        for p in self._pairs(v):
            self.seen[p] = self.seen.get(p, 0) + step

    def notice(self, item: dict) -> tuple[int | None, str, tuple]:
        """A notice item: (notice, outcome, effects)."""
        asked = {"dedup_key": item["dedup_key"] or item["source_duplicate_key"], "source_duplicate_key": item["source_duplicate_key"], "content_hash": item["content_hash"]}
        if item["content_hash"] and any(self.seen.get(p) for p in self._pairs(asked)):
            return None, "suppressed", (0, 1, 1, 0, 0)
        number, created = self.resolve(item)
        if number is None:
            return None, "dropped", (0, 0, 0, 0, 0)
        return number, "created" if created else "merged", (1, 0, 0, 1, 0) if created else (1, 1, 0, 0, 1)

    def version(self, item: dict) -> tuple[int | None, str, tuple]:
        """A version item. Content seen before is that version again; a free number is taken, else the next one."""
        known = self.find(item)
        versions = self.versions.get(known, []) if known is not None else []
        wanted = item["version_no"] or 1
        h = item["content_hash"]
        v = next((x for x in versions if h and x["content_hash"] == h), None) or next((x for x in versions if x["version_no"] == wanted and (not h or x["content_hash"] == h)), None)
        if v is None and not (item["title"] and h):
            return None, "dropped", (0, 0, 0, 0, 0)  # and with it what the item would have merged
        number, _ = self.resolve(item)
        if number is None:
            return None, "dropped", (0, 0, 0, 0, 0)
        versions, created = self.versions[number], v is None
        if created:
            taken = {x["version_no"] for x in versions}
            v = {"version_no": wanted if wanted not in taken else max(taken) + 1, "content_hash": h, "dedup_key": None, "source_duplicate_key": None, "is_current": True}
            versions.append(v)
        else:
            self._stand(v, -1)
        v["content_hash"] = h or v["content_hash"]
        v["dedup_key"] = item["dedup_key"] or item["source_duplicate_key"] or v["dedup_key"]
        v["source_duplicate_key"] = item["source_duplicate_key"] or v["source_duplicate_key"]
        v["is_current"] = bool(item["is_current"])
        self._stand(v, 1)
        if v["is_current"]:
            for x in versions:
                x["is_current"] = x is v
        self._published(self.notices[number], item["published_us"])
        return number, "version" if created else "version again", (0, 0, 0, 1, 0) if created else (0, 1, 0, 0, 1)

    def rows(self, source: str) -> Iterator[dict]:
        for number, n in self.notices.items():
            yield {"what": "notice", "source_code": source, "notice_seq": number} | {k: v for k, v in n.items() if k in _COLUMNS}
            for v in self.versions[number]:
                yield {"what": "version", "source_code": source, "notice_seq": number} | v


def _frame(rows: list[dict]) -> pd.DataFrame:
    whole = {c.split()[0] for c in OUT.split(", ") if c.split()[1] in ("long", "int")}
    df = pd.DataFrame(rows, columns=_COLUMNS)
    return df.astype({c: "Int64" for c in whole} | {"is_current": "boolean"}).astype({c: "object" for c in _COLUMNS if c not in whole and c != "is_current"})


def _folded(batches):
    fold, at, out = Fold(), None, []
    for pdf in batches:
        for item in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            here = (item["source_code"], item["component"])
            if here != at:
                if at is not None:
                    out += fold.rows(at[0])
                fold, at = Fold(), here
            number, outcome, effects = fold.notice(item) if item["kind"] == "notice" else fold.version(item)
            out.append({"what": "effect", "source_code": here[0], "seq": item["seq"], "kind": item["kind"], "crawl_job_id": item["crawl_job_id"], "notice_seq": number, "outcome": outcome} | dict(zip(EFFECTS, effects)))
            if len(out) >= 5000:
                yield _frame(out)
                out = []
    if at is not None:
        out += fold.rows(at[0])
    if out:
        yield _frame(out)


def write_items(items: DataFrame) -> DataFrame:
    """What is in the tables after all items: rows of what = effect (one an item), notice and version."""
    items = settle_table(items)  # read once: keys are costly, and every round begins with them
    keys = {k: [k] for k in KEYS} | {"likeness": ["norm_title", "published_day"]}
    of = components(items, keys)
    # the dedup key of an item without one is its source key, so both are one key space
    both = items.join(of, "seq", "left").withColumn("component", F.coalesce("component", "seq"))
    return both.repartition("source_code", "component").sortWithinPartitions("source_code", "component", "at", "seq").mapInPandas(_folded, OUT)


def job_counters(effects: DataFrame) -> DataFrame:
    """(crawl_job_id, the counters) that items add to their jobs."""
    return effects.filter((F.col("what") == "effect") & F.col("crawl_job_id").isNotNull()).groupBy("crawl_job_id").agg(*(F.sum(e).alias(e) for e in EFFECTS))


def page_effects(pages: DataFrame) -> DataFrame:
    """(raw_id, crawl_job_id, is_duplicate_url, is_duplicate_content and what the page adds to its job) of pages in their
    order, by aggregates: a URL or content that holds a third of all rows is folded before it moves."""
    p = pages.filter(F.col("url_hash").isNotNull() & F.col("raw_id").isNotNull()).withColumn("source_code", F.coalesce("source_code", F.lit("unknown_source")))
    first = p.groupBy("source_code", "url_hash").agg(F.min("raw_id").alias("first_id"))
    by_content = p.filter(identity.said("content_hash").isNotNull()).groupBy("source_code", "content_hash", "url_hash").agg(F.min("raw_id").alias("since"))
    one = by_content.groupBy("source_code", "content_hash").agg(F.min("since").alias("one_since"), F.min_by("url_hash", "since").alias("one_url"))
    two = by_content.join(one, ["source_code", "content_hash"]).filter("url_hash != one_url").groupBy("source_code", "content_hash").agg(F.min("since").alias("two_since"))
    seen = one.join(two, ["source_code", "content_hash"], "left")
    rows = p.join(first, ["source_code", "url_hash"]).join(seen, ["source_code", "content_hash"], "left")
    again = F.col("first_id") < F.col("raw_id")
    other = F.when(F.col("url_hash") == F.col("one_url"), F.col("two_since")).otherwise(F.col("one_since"))
    copied = F.coalesce(other < F.col("raw_id"), F.lit(False))
    role = F.lower(F.coalesce(F.get_json_object("extra_meta", "$.role"), F.lit("")))
    count = lambda name: F.when(role == "list", F.greatest(F.coalesce(F.trim(F.get_json_object("extra_meta", f"$.{name}")).try_cast("int"), F.lit(0)), F.lit(0))).otherwise(0)
    return rows.select(
        "raw_id", "crawl_job_id", again.alias("is_duplicate_url"), copied.alias("is_duplicate_content"), F.lit(1).alias("pages_fetched"), F.lit(1).alias("documents_saved"), (again | copied).cast("int").alias("deduplicated_count"),
        count("page_item_count").alias("list_items_seen"), count("new_unique_item_count").alias("list_items_unique"), count("page_source_duplicates_skipped").alias("list_items_source_duplicates_skipped"),
        F.when(role == "detail", 1).otherwise(0).alias("detail_pages_fetched"), (~again).cast("int").alias("records_inserted"), again.cast("int").alias("records_updated"))
