"""References to records that do not exist, tracked as incremental keyed state.

The state is kept in buckets of the parent id (``state``): ``parents`` (id, first arrival), ``gone``
(deleted ids), ``held`` (references that found their parent), ``waiting`` (orphans whose parent has not
come) and ``opened`` (what else was an orphan once: its parent came late or was deleted). One ``advance``
takes the arrivals of a period: its new references probe the parent index; parents that arrive
resolve waiting orphans, which leave ``waiting`` and stay on record as ``late``; deletions reopen
what was held or late. Each step ends with a snapshot of the counts, so that there is one for each
period.

Defined cases: null references are no references; a reference or parent delivered again keeps its
earliest arrival; a null arrival counts as later than any other; a parent that arrives at the same
instant as the reference is in time; a step that runs again changes nothing; empty tables give an
empty report.

Scale: a step reads only the buckets of the ids that arrive in it, and of ``waiting`` and ``held`` only
those of new parents and new deletions. Both sides are one row for each reference and parent before
they meet, so a hot parent is one row of the index; the reference side may be skewed, which adaptive
execution splits (left joins split on the reference side). Buckets spread over many steps are
rewritten (``COMPACT``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.operators.state import BUCKET, STEP, State, together
from chatlore.shared import shared_dir

NEVER = "9999-12-31"
BUCKETS = 16
COMPACT = 8
KEY = ["feed", "ref_field", "seq"]
REFS = T.StructType([
    T.StructField("feed", T.StringType()), T.StructField("ref_field", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("parent_id", T.LongType()),
    T.StructField("period", T.DateType()), T.StructField("arrived", T.TimestampType()),
])
OPENED = T.StructType([*REFS.fields, T.StructField("status", T.StringType())])
PARENTS = T.StructType([T.StructField("parent_id", T.LongType()), T.StructField("first_seen", T.TimestampType())])
GONE = T.StructType([T.StructField("parent_id", T.LongType())])
TABLES = {"parents": PARENTS, "gone": GONE, "held": REFS, "waiting": REFS, "opened": OPENED}


class OrphanTracker:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path or shared_dir(spark, "orphans")
        self.state = State(spark, self.path, buckets)

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.state.read(name, TABLES[name], buckets).drop(STEP)

    def advance(self, refs: DataFrame, parents: DataFrame, deleted: DataFrame, step: int | str | None = None) -> None:
        """Take what arrived in one period.

        refs: feed, ref_field, seq, parent_id, period, arrived; parents: parent_id, first_seen;
        deleted: parent_id. Periods must come in order of arrival; ``step`` names the period.
        """
        state = self.state
        step = len(state.manifest["steps"]) if step is None else step
        if state.done(step):
            return
        never = F.lit(NEVER).cast("timestamp")
        known = F.col("parent_id").isNotNull()
        bucket = state.bucket("parent_id").alias(BUCKET)
        first = (
            refs.filter(known & F.col("seq").isNotNull()).groupBy(*KEY)
            .agg(F.min(F.struct(F.coalesce("arrived", never).alias("arrived"), "parent_id", "period")).alias("r"))
            .select(*KEY, "r.parent_id", "r.period", "r.arrived")
        )
        came = parents.filter(known).groupBy("parent_id").agg(F.min(F.coalesce("first_seen", never)).alias("first_seen")).select("*", bucket)
        left = deleted.filter(known).select("parent_id").distinct().select("*", bucket)

        # what is new of parents and deletions, in the buckets that they touch
        first = first.select("*", bucket)
        at_came, at_left, at_refs = together([lambda x=x: state.touched(x) for x in (came, left, first)])
        had = self._read("parents", at_came)
        new_parents = came.join(had.select("parent_id"), "parent_id", "left_anti") if state.read_buckets["parents"] else came
        was = self._read("gone", at_left)
        new_gone = left.join(was.select("parent_id"), "parent_id", "left_anti") if state.read_buckets["gone"] else left
        state.write_all([("parents", new_parents, None), ("gone", new_gone, None)])
        new_parents = state.read("parents", PARENTS, at_came).filter(F.col(STEP) == state.next)
        new_gone = state.read("gone", GONE, at_left).filter(F.col(STEP) == state.next).select("parent_id")

        # new references probe the parent index; ``now`` holds them, written once with what they are
        index = self._read("parents", at_refs).select("parent_id", "first_seen")
        gone = self._read("gone", at_refs).select("parent_id", F.lit(True).alias("is_gone"))
        status = (F.when(F.col("is_gone"), "deleted").when(F.col("first_seen").isNull(), "missing")
                  .when(F.col("first_seen") > F.col("arrived"), "late").otherwise("held"))
        probed = first.join(index, "parent_id", "left").join(gone, "parent_id", "left").select(*REFS.names, BUCKET, status.alias("status"))
        state.write("now", probed, replace=list(range(state.buckets)))
        now = state.read("now", OPENED).drop(STEP)

        # parents that arrive resolve waiting orphans, deletions reopen what was held, late or waiting
        before = self._read("waiting", sorted({*at_came, *at_left}))
        stirred = list(state.read_buckets["waiting"])
        opened = now.filter("status in ('late', 'deleted')")
        if stirred:
            seen = before.join(new_parents.select("parent_id", F.lit(True).alias("came")), "parent_id", "left").join(
                new_gone.select("parent_id", F.lit(True).alias("left")), "parent_id", "left")
            opened = opened.unionByName(seen.filter("left or came").select(*REFS.names, BUCKET, F.when(F.col("left"), "deleted").otherwise("late").alias("status")))
            still = seen.filter("left is null and came is null").select(*REFS.names, BUCKET)
            waiting = now.filter("status = 'missing'").drop("status").unionByName(still)
        else:
            waiting = now.filter("status = 'missing'").drop("status")
        if at_left:
            for name in ("held", "opened"):
                rows = self._read(name, at_left)
                if state.read_buckets[name]:
                    rows = rows.join(new_gone, "parent_id", "left_semi").select(*REFS.names, BUCKET, F.lit("deleted").alias("status"))
                    opened = opened.unionByName(rows)
        state.write_all([("opened", opened.select(*OPENED.names, BUCKET), None), ("waiting", waiting.select(*REFS.names, BUCKET), stirred),
                         ("held", now.filter("status = 'held'").drop("status").select(*REFS.names, BUCKET), None)])
        state.write("snapshots", self.snapshot().select("*", F.lit(str(step)).alias("step"), F.lit(0).alias(BUCKET)))
        for name, schema in TABLES.items():
            state.compact(name, schema, COMPACT)
        state.commit(step)

    def report(self) -> DataFrame:
        """One row for each reference that was ever open, with what it is now."""
        rows = self._read("opened").drop(BUCKET).unionByName(self._read("waiting").drop(BUCKET).withColumn("status", F.lit("missing")))
        # deleted is for good, and what is late is missing no more; the earliest arrival counts
        rank = F.when(F.col("status") == "deleted", 0).when(F.col("status") == "late", 1).otherwise(2)
        one = rows.groupBy(*KEY).agg(F.min(rank).alias("rank"), F.min(F.struct("arrived", "parent_id", "period")).alias("r"))
        status = F.when(F.col("rank") == 0, "deleted").when(F.col("rank") == 1, "late").otherwise("missing")
        return one.select(*KEY, "r.parent_id", "r.period", "r.arrived", status.alias("status"))

    def snapshot(self) -> DataFrame:
        """Counts per feed, field, period and status, as of the last advance."""
        return self.report().groupBy("feed", "ref_field", "period", "status").agg(F.count("*").alias("n_refs"))

    def snapshots(self) -> DataFrame:
        """The snapshot after each step."""
        schema = T.StructType([OPENED["feed"], OPENED["ref_field"], OPENED["period"], OPENED["status"],
                               T.StructField("n_refs", T.LongType()), T.StructField("step", T.StringType())])
        return self.state.read("snapshots", schema).drop(BUCKET, STEP)


def references(feeds: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Reference rows of several logs: name -> (log, its reference columns)."""
    out = None
    for name, (df, fields) in feeds.items():
        for f in fields:
            rows = df.select(
                F.lit(name).alias("feed"), F.lit(f).alias("ref_field"), "seq", F.col(f).alias("parent_id"),
                F.trunc("log_date", "month").alias("period"), F.col("delivered_at").alias("arrived"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out


def track(refs: DataFrame, parents: DataFrame, deleted: DataFrame, periods: int = 2) -> OrphanTracker:
    """Replay whole tables through a tracker in ``periods`` slices of arrival time."""
    spark = refs.sparkSession
    lo, hi = refs.agg(F.min("arrived"), F.max("arrived")).first()
    tracker = OrphanTracker(spark)
    cuts = [] if lo is None or periods < 2 else [lo + (hi - lo) * k / periods for k in range(1, periods)]
    bounds = [None, *cuts, None]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        def within(df: DataFrame, c: str) -> DataFrame:
            df = df if a is None else df.filter((F.col(c) >= F.lit(a)) | (F.col(c).isNull() if b is None else F.lit(False)))
            return df if b is None else df.filter(F.col(c) < F.lit(b))
        d = within(deleted, "deleted_at") if "deleted_at" in deleted.columns else deleted
        tracker.advance(within(refs, "arrived"), within(parents, "first_seen"), d, n)
    return tracker
