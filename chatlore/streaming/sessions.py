"""Live searches over a published archive: subscribe, get more, post metadata, reindex.

An archive is a folder with ``logs`` (the record of everything), ``index`` (published versions) and
``palettes``. A subscription holds only its plan, its cursor and what it displays; every answer is a
query. ``maintain`` builds the next index at its interval and moves the subscriptions over to it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.operators import facts, paging, policy
from chatlore.operators.index import Index, current_version, publish
from chatlore.plans import postings_plan
from chatlore.plans.parser import QuerySyntaxError, parse
from chatlore.streaming.ingest import EstimateWatcher, notify_metadata

REINDEX_SECONDS = 600
UNLOGGED_DAYS = 7


@dataclass
class Tables:
    """What a live archive answers from: current messages, and the metadata logs."""

    zgrams: DataFrame
    reactions_log: DataFrame
    revisions_log: DataFrame
    refers_log: DataFrame
    zmojis_log: DataFrame

    def current(self) -> DataFrame:
        return facts.current_text(self.zgrams, self.revisions_log)


@dataclass
class Subscription:
    sub_id: str
    user_id: str
    plan: object
    page_size: int
    margin: int
    cursor: paging.Cursor
    hits: DataFrame


@dataclass
class Page:
    """Rows of one side with everything that is shown with them."""

    rows: DataFrame
    metadata: DataFrame
    karma: DataFrame
    estimates: DataFrame
    ids: list[int] = field(default_factory=list)


class Sessions:
    def __init__(self, spark: SparkSession, root: str, tables: Tables):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self.subscriptions: dict[str, Subscription] = {}
        self.watcher = EstimateWatcher()
        self.built: dt.datetime | None = None
        self.index: Index | None = None

    # -- index -------------------------------------------------------------------------------------
    def reindex(self, now: dt.datetime) -> str:
        """Build and publish an index of all logged messages and the unlogged ones of the last days; then reset."""
        kept = policy.retained(self.tables.current(), F.lit(now.date()), UNLOGGED_DAYS)
        version = f"v{now:%Y%m%d%H%M%S}"
        Index.build(kept, f"{self.root}/index/{version}", facts.reaction_counts(self.tables.reactions_log))
        publish(self.spark, f"{self.root}/index", version)
        self.built = now
        self.reset()
        return version

    def maintain(self, now: dt.datetime) -> str | None:
        """Reindex if the last index is older than the interval; the new version, or None if it isn't due."""
        if self.built is not None and (now - self.built).total_seconds() < REINDEX_SECONDS:
            return None
        return self.reindex(now)

    def reset(self) -> None:
        """Take the published index, and rebuild each cursor from what its subscription displays."""
        self.index = Index.open(self.spark, f"{self.root}/index/{current_version(self.spark, self.root + '/index')}")
        for s in self.subscriptions.values():
            s.hits = self._hits(s.plan)
            if s.cursor.low is not None:
                s.cursor = paging.Cursor(s.cursor.high, s.cursor.low, s.cursor.low, s.cursor.high)

    def _hits(self, plan) -> DataFrame:
        return postings_plan.search(plan, self.index)

    # -- searches ----------------------------------------------------------------------------------
    def subscribe(self, sub_id: str, user_id: str, query: str, at: str = "end", value: int | None = None,
                  page_size: int = paging.PAGE_SIZE, margin: int = paging.MARGIN) -> tuple[bool, object, DataFrame | None]:
        """(True, estimates, the user's palette), or (False, message, None) if the query doesn't parse."""
        try:
            plan = parse(query)
        except QuerySyntaxError as e:
            return False, str(e), None
        hits = self._hits(plan)
        cursor = paging.start(self.index.docs, at, value)
        self.subscriptions[sub_id] = Subscription(sub_id, user_id, plan, page_size, margin, cursor, hits)
        palette = facts.current_zmojis(self.tables.zmojis_log).filter(F.col("user_id") == user_id).select("user_id", "zmojis")
        return True, paging.estimates(hits, cursor, margin), palette

    def unsubscribe(self, sub_id: str) -> None:
        self.subscriptions.pop(sub_id, None)

    def get_more(self, sub_id: str, side: str, count: int) -> Page:
        """At most a page of rows of a side with their metadata and karma, then what is left; the cursor moves on."""
        s = self.subscriptions[sub_id]
        rows = paging.page(s.hits, s.cursor, side, min(count, s.page_size))
        ids = [r[0] for r in rows.select("zgram_id").collect()]  # at most a page
        s.cursor = paging.advance(s.cursor, side, ids)
        return page_of(self.tables, rows, ids, s, self.index.docs)

    def estimates_changed(self) -> dict[str, list[tuple]]:
        """New estimates of the subscriptions for which they have changed."""
        out = {}
        for s in self.subscriptions.values():
            new = self.watcher.changed(s.sub_id, paging.estimates(s.hits, s.cursor, s.margin))
            if new:
                out[s.sub_id] = new
        return out

    # -- posting -----------------------------------------------------------------------------------
    def post_metadata(self, sub_id: str, records: DataFrame, append) -> DataFrame:
        """Sanitise, append, apply, notify: (sub_id, kind, seq) of who is told what.

        records: kind, seq, zgram_id, creator, user_id and the columns of the logs (nulls where a kind has
        none). ``append`` writes the allowed ones, and returns the logs as they are now.
        """
        user = self.subscriptions[sub_id].user_id
        allowed = policy.sanitize(records, facts.messages(self.tables.zgrams), F.lit(user))
        self.tables = append(allowed)
        shown = [(s.sub_id, s.user_id, s.cursor.low or 0, s.cursor.high or 0) for s in self.subscriptions.values()]
        subs = self.spark.createDataFrame(shown, "sub_id string, user_id string, lo long, hi long")
        return notify_metadata(allowed.select("kind", "seq", "zgram_id", "user_id"), subs).select("sub_id", "kind", "seq")


def page_of(tables: Tables, rows: DataFrame, ids: list[int], s: Subscription, docs: DataFrame) -> Page:
    wanted = docs.filter(F.col("zgram_id").isin(*ids)).select("zgram_id") if ids else docs.limit(0).select("zgram_id")
    logs = [t.filter(F.col("zgram_id").isin(*ids)) if ids else t.limit(0) for t in (tables.reactions_log, tables.revisions_log, tables.refers_log)]
    metadata = facts.metadata_for(wanted, *logs)
    shown = docs.join(wanted, "zgram_id", "left_semi")
    keys = facts.karma_deltas(shown).select("key", "zgram_id")
    running = facts.karma_running(facts.karma_deltas(docs).join(keys.select("key").distinct(), "key", "left_semi"))
    karma = running.join(keys, ["key", "zgram_id"], "left_semi").select("key", "zgram_id", "karma")
    return Page(rows, metadata, karma, paging.estimates(s.hits, s.cursor, s.margin), ids)
