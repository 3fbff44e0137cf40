"""Two-sided keyset paging over a search result."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.operators.facts import end_id, lower_bound

PAGE_SIZE, MARGIN, INITIAL = 50, 20, 20


@dataclass(frozen=True)
class Cursor:
    """Back: next id from which to go up. Front: id below which to go down. Displayed: [low, high)."""

    back: int
    front: int
    low: int | None = None
    high: int | None = None


def origin(docs: DataFrame, at: str = "end", value: int | None = None) -> int:
    """Id to start from: ``end``, ``timestamp`` (first message from then on) or ``zgram`` (that id)."""
    if at == "zgram":
        return value
    return end_id(docs) if at == "end" else lower_bound(docs, timesecs=value)


def start(docs: DataFrame, at: str = "end", value: int | None = None) -> Cursor:
    o = origin(docs, at, value)
    return Cursor(o, o)


def page(hits: DataFrame, cursor: Cursor, side: str, count: int = PAGE_SIZE) -> DataFrame:
    """Next rows of a side: ``back`` is ids from the cursor on, ascending; ``front`` below it, descending."""
    if side == "back":
        return hits.filter(F.col("zgram_id") >= cursor.back).orderBy("zgram_id").limit(count)
    return hits.filter(F.col("zgram_id") < cursor.front).orderBy(F.desc("zgram_id")).limit(count)


def advance(cursor: Cursor, side: str, rows: list[int]) -> Cursor:
    """Cursor after a page with these ids."""
    if not rows:
        return cursor
    lo, hi = min(rows), max(rows)
    cursor = replace(cursor, low=lo if cursor.low is None else min(lo, cursor.low), high=hi + 1 if cursor.high is None else max(hi + 1, cursor.high))
    return replace(cursor, back=hi + 1) if side == "back" else replace(cursor, front=lo)


def estimates(hits: DataFrame, cursor: Cursor, margin: int = MARGIN) -> DataFrame:
    """(side, count, exact): rows left on each side, counted up to ``margin``."""
    def side(name: str, rows: DataFrame) -> DataFrame:
        n = rows.select("zgram_id").limit(margin).agg(F.count("*").alias("count"))
        return n.select(F.lit(name).alias("side"), "count", (F.col("count") < margin).alias("exact"))
    return side("back", hits.filter(F.col("zgram_id") >= cursor.back)).unionByName(side("front", hits.filter(F.col("zgram_id") < cursor.front)))


def specific(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of some ids; unknown ones are skipped."""
    return docs.filter(F.col("zgram_id").isin(*ids)) if ids else docs.limit(0)
