"""Structured Streaming: ingestion by micro-batches, posting, notifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlore.functions import text as T
from chatlore.operators import facts
from chatlore.shared import shared_dir


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Feed all that is available through ``each(batch, batch_id)`` and wait."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or shared_dir(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that is idempotent on the batch id: a batch that runs again overwrites its own folder."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return each


def post(batch: DataFrame, next_id: int, now: Column) -> DataFrame:
    """Ids, time and logging flag for new messages (sender, signature, instance, body, render_style, nth).

    Ids follow the order of ``nth`` without gaps. A batch is one client's post, so it is small.
    """
    w = Window.orderBy("nth")
    core = batch.withColumn("instance", F.trim("instance"))
    return core.select(
        (F.lit(next_id) + F.row_number().over(w) - 1).cast("long").alias("zgram_id"), now.cast("long").alias("timesecs"), "sender", "signature",
        T.is_logged(F.col("instance")).alias("is_logged"), "instance", "body", "render_style")


def notify_metadata(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(sub_id, event columns): events in a subscriber's displayed range [lo, hi) or of the own user.

    Ranges are cut into blocks of ids so that the join is an equi join.
    """
    block = 4096
    s = subscribers.select("sub_id", "user_id", "lo", "hi", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(
        F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)))).alias("_b"))
    e = events.withColumn("_b", F.floor(F.col("zgram_id") / block))
    ranged = e.join(s.drop("user_id"), "_b").filter((F.col("zgram_id") >= F.col("lo")) & (F.col("zgram_id") < F.col("hi")))
    own = events.join(subscribers.select("sub_id", "user_id"), "user_id")
    cols = ["sub_id", *events.columns]
    return ranged.select(*cols).unionByName(own.select(*cols)).distinct()


def notify_karma(deltas: DataFrame, changed: DataFrame, lo: int, hi: int) -> DataFrame:
    """(key, zgram_id, karma) of displayed messages that mention a changed key, from its first change on.

    changed: (key, zgram_id)."""
    first = changed.groupBy("key").agg(F.min("zgram_id").alias("since"))
    now = facts.karma_running(deltas.join(first.select("key"), "key", "left_semi"))
    return now.join(first, "key").filter((F.col("zgram_id") >= F.col("since")) & (F.col("zgram_id") >= lo) & (F.col("zgram_id") < hi)).select("key", "zgram_id", "karma")


class EstimateWatcher:
    """Emits the estimates of a subscription only when they change."""

    def __init__(self):
        self.last: dict[str, tuple] = {}

    def changed(self, sub_id: str, estimates: DataFrame) -> list[tuple]:
        now = tuple(sorted(map(tuple, estimates.collect())))
        if self.last.get(sub_id) == now:
            return []
        self.last[sub_id] = now
        return list(now)
