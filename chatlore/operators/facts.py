"""Facts about messages: current text, metadata state, counts, karma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlore.functions import text as T
from chatlore.shared import cut


# -- sorted-stream operators -----------------------------------------------------------------------
def last_keeper(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key group. A partial aggregate: no group is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*rows.columns)


def true_keeper(rows: DataFrame, flag: str) -> DataFrame:
    return rows.filter(F.coalesce(F.col(flag), F.lit(False)))


def prefix_grabber(rows: DataFrame, n: int) -> DataFrame:
    return rows.select(*rows.columns[:n])


def counter(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def accumulator(rows: DataFrame, keys: list[str], value: str, name: str = "total") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias(name))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running", block: Column | None = None) -> DataFrame:
    """Cumulative sum within a key. With ``block`` (a non-decreasing function of the order) the sum is
    taken in blocks and then over block totals, so that a hot key isn't one task."""
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(w))
    rows = rows.withColumn("_block", block)
    total = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(w)).join(total, [*keys, "_block"])
    return rows.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_block", "_before")


def dictionary(columns: list[tuple[DataFrame, str]]) -> DataFrame:
    """(value) distinct strings of some columns, in ranges of values and sorted within each."""
    out = None
    for rows, c in columns:
        part = rows.select(F.col(c).alias("value")).filter(F.col(c).isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.distinct().repartitionByRange("value").sortWithinPartitions("value")


def string_codes(pool: DataFrame) -> DataFrame:
    """(value, code): codes from 0 in order of the strings. Numbered within ranges, then over the ranges' sizes."""
    ranged = cut(pool.withColumn("_range", F.spark_partition_id()), "pool")
    size = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    # one row a range
    sizes = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select("_range", F.coalesce(F.sum("n").over(sizes), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("value"))
    return ranged.withColumn("rank", rank).join(before, "_range").select("value", (F.col("before") + F.col("rank") - 1).alias("code"))


def freeze(rows: DataFrame, columns: list[str], codes: DataFrame) -> DataFrame:
    """``rows`` with codes in place of strings. A string that has no code stops the query; null stays null."""
    for c in columns:
        coded = codes.select(F.col("value").alias(c), F.col("code").alias("_code"))
        missing = F.raise_error(F.concat(F.lit("not in the pool: "), F.col(c)))
        rows = rows.join(coded, c, "left").withColumn(c, F.when(F.col(c).isNull(), F.lit(None)).when(F.col("_code").isNull(), missing.cast("long")).otherwise(F.col("_code"))).drop("_code")
    return rows


def nested_sizes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(level, group, n): for the groups of each nesting level, how many distinct members of the next level they hold."""
    out = None
    for level in range(len(columns)):
        members = rows.select(*columns[: level + 1]).distinct()
        group = F.array(*[F.col(c).cast("string") for c in columns[:level]]) if level else F.array().cast("array<string>")
        one = members.groupBy(group.alias("group")).agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "group", "n")
        out = one if out is None else out.unionByName(one)
    return out


def inflate(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Flat rows to outer key -> map of inner key -> sorted set of values."""
    sets = rows.groupBy(outer, inner).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return sets.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "values")))).alias("nested"))


# -- messages --------------------------------------------------------------------------------------
def messages(zgrams: DataFrame) -> DataFrame:
    """Every message once, however often it was delivered."""
    return zgrams.filter("zgram_id is not null").dropDuplicates(["zgram_id"]).drop("delivered_at")


def merge_kinds(logged: DataFrame, unlogged: DataFrame) -> DataFrame:
    """Logged and unlogged messages as one table. An id that both have stops the query."""
    both = logged.select("zgram_id").join(unlogged.select("zgram_id"), "zgram_id", "left_semi").distinct().withColumn("_both", F.lit(True))
    rows = logged.unionByName(unlogged).join(both, "zgram_id", "left")
    stop = F.raise_error(F.concat(F.lit("logged and unlogged: "), F.col("zgram_id").cast("string"))).cast("boolean")
    return rows.filter(F.when(F.col("_both"), stop).otherwise(True)).drop("_both")


def latest_revisions(revisions_log: DataFrame) -> DataFrame:
    rows = revisions_log.filter("zgram_id is not null").select("seq", "zgram_id", "instance", "body", "render_style")
    last = last_keeper(rows, ["zgram_id"], "seq")
    return last.filter("instance is not null or body is not null or render_style is not null")


def current_text(zgrams: DataFrame, revisions_log: DataFrame | None) -> DataFrame:
    """Messages with instance, body and style of their latest revision (the original if none)."""
    m = messages(zgrams)
    if revisions_log is None:
        return m
    r = latest_revisions(revisions_log).select("zgram_id", F.struct("instance", "body", "render_style").alias("_rev"))
    m = m.join(r, "zgram_id", "left")
    for c in ("instance", "body", "render_style"):
        m = m.withColumn(c, F.when(F.col("_rev").isNotNull(), F.col("_rev")[c]).otherwise(F.col(c)))
    return m.drop("_rev")


def revision_history(revisions_log: DataFrame) -> DataFrame:
    """(zgram_id, nth, seq, body) of all revisions in order."""
    rows = revisions_log.filter("zgram_id is not null").dropDuplicates(["seq"])
    w = Window.partitionBy("zgram_id").orderBy("seq")
    return rows.select("zgram_id", F.row_number().over(w).cast("long").alias("nth"), "seq", "body")


# -- reactions, edges, palettes --------------------------------------------------------------------
def current_reactions(reactions_log: DataFrame) -> DataFrame:
    rows = reactions_log.filter("zgram_id is not null and reaction is not null and creator is not null and value is not null")
    return true_keeper(last_keeper(rows.select("zgram_id", "reaction", "creator", "value", "seq"), ["zgram_id", "reaction", "creator"], "seq"), "value")


def reaction_counts(reactions_log: DataFrame) -> DataFrame:
    return counter(current_reactions(reactions_log), ["reaction", "zgram_id"], "n")


def reaction_count(reactions_log: DataFrame, reaction: str, zgram_id: int) -> int:
    row = reaction_counts(reactions_log).filter((F.col("reaction") == reaction) & (F.col("zgram_id") == zgram_id)).first()
    return row["n"] if row else 0


def current_refers(refers_log: DataFrame) -> DataFrame:
    rows = refers_log.filter("zgram_id is not null and refers_to is not null and value is not null")
    return true_keeper(last_keeper(rows.select("zgram_id", "refers_to", "value", "seq"), ["zgram_id", "refers_to"], "seq"), "value")


def reply_parents(refers_log: DataFrame, current: DataFrame) -> DataFrame:
    """Each reply with the sender and abbreviated body of what it refers to (null if unknown)."""
    parent = current.select(F.col("zgram_id").alias("refers_to"), F.col("sender").alias("parent_sender"),
                            T.abbreviate(F.col("body")).alias("parent_body"))
    return current_refers(refers_log).select("zgram_id", "refers_to").join(parent, "refers_to", "left").select(
        "zgram_id", "refers_to", "parent_sender", "parent_body")


def current_zmojis(zmojis_log: DataFrame) -> DataFrame:
    rows = zmojis_log.filter("user_id is not null").select("user_id", "zmojis", "seq")
    return last_keeper(rows, ["user_id"], "seq").filter("zmojis is not null")


def metadata_for(ids: DataFrame, reactions_log: DataFrame, revisions_log: DataFrame, refers_log: DataFrame) -> DataFrame:
    """All metadata of some messages: reactions, then revisions, then references."""
    kinds = ["kind", "zgram_id", "reaction", "creator", "seq", "body", "refers_to"]
    parts = [
        current_reactions(reactions_log).select(F.lit("rx").alias("kind"), "zgram_id", "reaction", "creator"),
        revision_history(revisions_log).select(F.lit("zgrev").alias("kind"), "zgram_id", "seq", "body"),
        current_refers(refers_log).select(F.lit("ref").alias("kind"), "zgram_id", "refers_to"),
    ]
    out = None
    for p in parts:
        p = p.join(ids, "zgram_id", "left_semi")
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.select(*kinds)


# -- karma -----------------------------------------------------------------------------------------
def karma_deltas(current: DataFrame, text: str = "body") -> DataFrame:
    """(key, zgram_id, delta): net change of every key a message mentions, zero ones included."""
    hits = current.filter(F.col(text).isNotNull()).select("zgram_id", F.explode(T.karma(F.col(text))).alias("p"))
    return hits.groupBy(F.col("p.key").alias("key"), "zgram_id").agg(F.sum("p.delta").alias("delta"))


def karma_running(deltas: DataFrame, block_ids: int = 1 << 16) -> DataFrame:
    """(key, zgram_id, delta, karma): the key's karma right after the message."""
    return running_sum(deltas, ["key"], ["zgram_id"], "delta", "karma", block=F.floor(F.col("zgram_id") / block_ids))


def karma_after(deltas: DataFrame, zgram_id: int) -> DataFrame:
    """(key, karma) after a message, inclusive."""
    return deltas.filter(F.col("zgram_id") <= zgram_id).groupBy("key").agg(F.sum("delta").alias("karma"))


def karma_of_revisions(zgrams: DataFrame, revisions_log: DataFrame) -> DataFrame:
    """(zgram_id, seq, key, delta) of each revision against the text before it."""
    texts = revision_history(revisions_log).select("zgram_id", "seq", "body").unionByName(
        messages(zgrams).join(revisions_log.select("zgram_id").distinct(), "zgram_id", "left_semi").select("zgram_id", F.lit(-1).cast("long").alias("seq"), "body"))
    w = Window.partitionBy("zgram_id").orderBy("seq")
    pairs = texts.withColumn("before", F.lag("body").over(w)).filter("seq >= 0")

    def scan(c: str, sign: int) -> DataFrame:
        return pairs.filter(F.col(c).isNotNull()).select("zgram_id", "seq", F.explode(T.karma(F.col(c))).alias("p")).select(
            "zgram_id", "seq", "p.key", (F.col("p.delta") * sign).alias("delta"))
    return scan("body", 1).unionByName(scan("before", -1)).groupBy("zgram_id", "seq", "key").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


# -- bounds ----------------------------------------------------------------------------------------
def lower_bound(current: DataFrame, zgram_id: int | None = None, timesecs: int | None = None) -> int:
    """First id from an id or a time on; the end id if none."""
    cond = F.col("zgram_id") >= zgram_id if zgram_id is not None else F.col("timesecs") >= timesecs
    row = current.agg(F.min(F.when(cond, F.col("zgram_id"))).alias("lo"), F.max("zgram_id").alias("hi")).first()
    return row["lo"] if row["lo"] is not None else (row["hi"] + 1 if row["hi"] is not None else 0)


def end_id(current: DataFrame) -> int:
    hi = current.agg(F.max("zgram_id")).first()[0]
    return 0 if hi is None else hi + 1
