"""Retention, authorisation, mute filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.functions.text import RETENTION_DAYS


def retained(rows: DataFrame, today: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Logged rows for good, unlogged ones of the last ``days`` days (partition pruning on log_date)."""
    return rows.filter(F.col("is_logged") | (F.col("log_date") >= F.date_sub(today, days)))


def sanitize(records: DataFrame, messages: DataFrame, user: Column) -> DataFrame:
    """Metadata a user may post: own reactions, revisions and references of own messages, any palette.

    records: kind (rx, zgrev, ref, zmojis), zgram_id, creator, ...; unknown messages are refused.
    """
    owner = messages.select(F.col("zgram_id").alias("_id"), F.col("sender").alias("_owner"))
    known = records.join(owner, records["zgram_id"] == owner["_id"], "left")
    ok = (
        F.when(F.col("kind") == "zmojis", True)
        .when(F.col("kind") == "rx", F.col("creator") == user)
        .otherwise(F.col("_owner") == user)
    )
    return known.filter(F.coalesce(ok, F.lit(False))).drop("_id", "_owner")


def filter_match(f: str = "f") -> Column:
    """Whether a mute filter matches a message: all criteria that it has must hold."""
    return (
        (F.col(f"{f}.f_sender").isNull() | (F.col(f"{f}.f_sender") == F.col("sender")))
        & (F.col(f"{f}.instance_exact").isNull() | (F.col(f"{f}.instance_exact") == F.col("instance")))
        & (F.col(f"{f}.instance_prefix").isNull() | F.col("instance").startswith(F.col(f"{f}.instance_prefix")))
    )


def with_filters(rows: DataFrame, filters: list[dict]) -> DataFrame:
    """Flags weakly_hidden (any filter) and strongly_hidden (a strong one). A user's filters are a short
    literal list: sender, instance_exact, instance_prefix, strong."""
    weak, strong = F.lit(False), F.lit(False)
    for f in filters:
        hit = F.lit(True)
        if f.get("sender") is not None:
            hit = hit & (F.col("sender") == f["sender"])
        if f.get("instance_exact") is not None:
            hit = hit & (F.col("instance") == f["instance_exact"])
        if f.get("instance_prefix") is not None:
            hit = hit & F.col("instance").startswith(f["instance_prefix"])
        hit = F.coalesce(hit, F.lit(False))
        weak = weak | hit
        if f.get("strong"):
            strong = strong | hit
    return rows.withColumns({"weakly_hidden": weak, "strongly_hidden": strong})


def latest_filters(proposals: DataFrame) -> DataFrame:
    """(user_id, version, filters): last writer wins by version."""
    return proposals.groupBy("user_id").agg(F.max_by(F.struct("version", "filters"), "version").alias("p")).select("user_id", "p.*")


def unread(rows: DataFrame, last_read: int) -> DataFrame:
    return rows.agg(F.count_if(F.col("zgram_id") > last_read).alias("n_unread"))
