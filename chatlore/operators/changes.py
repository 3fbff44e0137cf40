"""Change feeds kept as merge-on-read tables with delete vectors.

Every change is an image that is appended to a file of its batch and never rewritten; its place is
the file as written and its row there. A stored index, in buckets of the key, leads from each key to
the place of its newest image. A batch looks its keys up in the buckets it touches; images that are
superseded, be it old ones or late arrivals of the batch, become bits in the bitmap of their file,
and the touched buckets are written anew. A read looks each place up in its file's bitmaps and skips
the set ones. Order of delivery doesn't matter; a batch that is applied again changes nothing, and
the table can be opened again from its folder alone.

Defined cases: rows with a null in the key or in ``order_col`` change nothing; a tie in
``order_col`` is one change delivered several times (the earliest delivery stays, and across batches
the one that came first); an empty feed gives an empty state; columns beyond the named ones are
carried through unread.

Scale: no group of a key is ever gathered: the newest place is a partial aggregate. A batch costs what
it holds and the index buckets it touches. Bitmaps are of rows of a file, so they are as small as the
file is, however sparse ``order_col`` is; a bitmap holds 32,768 bits, longer files have several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlore.operators.state import BUCKET, STEP, State
from chatlore.shared import shared_dir

BUCKETS = 16
PLACE = ["_file", "_pos"]


class ChangeTable:
    """A table of changes in a folder, fed batch by batch (for ``foreachBatch`` or a scheduler)."""

    def __init__(self, spark: SparkSession, keys: Sequence[str], order_col: str = "seq", path: str | None = None,
                 deleted: Column | None = None, changes: Column | None = None, delivered_col: str | None = "delivered_at", buckets: int = BUCKETS):
        self.spark, self.keys, self.order_col = spark, list(keys), order_col
        self.path = path or shared_dir(spark, "changes")
        self.deleted, self.changes, self.delivered_col = deleted, changes, delivered_col
        self.state = State(spark, self.path, buckets)

    def _images(self, schema: T.StructType) -> DataFrame:
        """Images of all batches that count, with their places."""
        root = f"{self.path}/images"
        full = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
        rows = self.spark.read.schema(full).parquet(root).filter(F.col("_batch").isin(*self.state.manifest["images"]))
        return rows.select("*", F.concat_ws("/", "_batch", "_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_pos"))

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(self.state.manifest["schema"])

    def _renamed(self, df: DataFrame) -> DataFrame:
        """Columns of the feed under numbered names, so that none can clash with those of the table."""
        return df.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(df.columns)])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        state = self.state
        if state.done(batch_id):
            return
        manifest = state.manifest
        if "columns" not in manifest:
            manifest["columns"] = batch.columns
        names = {c: f"c{n}" for n, c in enumerate(manifest["columns"])}
        valid = F.col(self.order_col).isNotNull()
        for k in self.keys:
            valid &= F.col(k).isNotNull()
        if self.changes is not None:
            valid &= self.changes
        rows = self._renamed(batch.select(*manifest["columns"]).filter(valid))
        manifest.setdefault("schema", rows.schema.jsonValue())
        manifest["images"] = [*manifest.get("images", []), state.next]
        folder = f"{self.path}/images/_batch={state.next}"
        rows.write.mode("overwrite").parquet(folder)

        # places of the new images, and of the newest ones so far of the buckets they touch
        keys, order = [names[k] for k in self.keys], names[self.order_col]
        given = self.delivered_col is not None and self.delivered_col in names
        late = F.coalesce(F.unix_micros(F.col(names[self.delivered_col]).cast("timestamp")), F.lit(2**62)) if given else F.lit(0).cast("long")
        new = self._images(self._schema()).filter(F.col("_batch") == state.next).select(
            *keys, F.col(order).alias("_order"), late.alias("_late"), *PLACE, state.bucket(*keys).alias(BUCKET))
        touched = state.touched(new)
        index = T.StructType([f for f in new.schema.fields if f.name != BUCKET])
        old = state.read("index", index, touched).drop(STEP).withColumn("_late", F.lit(-1).cast("long"))  # came first
        places = new.unionByName(old)
        first = F.struct("_order", (-F.col("_late")).alias("_early"), F.col("_file"), F.col("_pos"))
        newest = places.groupBy(*keys, BUCKET).agg(F.max(first).alias("_n"))
        state.write("index", newest.select(*keys, "_n._order", F.lit(-1).cast("long").alias("_late"), "_n._file", "_n._pos", BUCKET), replace=touched)
        now = state.read("index", index, touched).select(*PLACE)
        gone = places.select(*PLACE).join(now, PLACE, "left_anti")
        bits = gone.groupBy("_file", F.floor(F.col("_pos") / 32768).alias("_chunk")).agg(F.bitmap_construct_agg(F.col("_pos") % 32768).alias("_bits"))
        bits.write.mode("overwrite").parquet(f"{self.path}/vectors/_batch={state.next}")
        state.commit(batch_id)

    def read(self) -> DataFrame:
        """The newest image of each key that isn't a delete, with the columns of the feed."""
        manifest = self.state.manifest
        if not manifest["steps"]:
            raise ValueError("no batch was applied yet")
        vectors = self.spark.read.schema("_file string, _chunk long, _bits binary, _batch int").parquet(f"{self.path}/vectors")
        vectors = vectors.filter(F.col("_batch").isin(*manifest["images"])).groupBy("_file", "_chunk").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        rows = self._images(self._schema()).withColumn("_chunk", F.floor(F.col("_pos") / 32768)).join(vectors, ["_file", "_chunk"], "left")
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(_pos % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
        marked = F.expr("shiftleft(1, cast(_pos % 8 as int))").bitwiseAND(byte) != 0
        rows = rows.filter(F.col("_bits").isNull() | ~marked)
        rows = rows.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(manifest["columns"])])
        return rows if self.deleted is None else rows.filter(~F.coalesce(self.deleted, F.lit(False)))


def current_state(
    feed: DataFrame,
    keys: Sequence[str],
    order_col: str = "seq",
    deleted: Column | None = None,
    changes: Column | None = None,
    delivered_col: str | None = "delivered_at",
    batches: int = 2,
) -> DataFrame:
    """Latest image of each key, without the keys whose latest image is a delete.

    The feed goes through a change table in ``batches`` slices of delivery. ``changes`` tells which
    rows are changes at all, ``deleted`` which of them are deletes.
    """
    table = ChangeTable(feed.sparkSession, keys, order_col, None, deleted, changes, delivered_col)
    cuts = []
    if batches > 1 and delivered_col and delivered_col in feed.columns:
        lo, hi = feed.agg(F.min(delivered_col), F.max(delivered_col)).first()
        cuts = [] if lo is None else [lo + (hi - lo) * k / batches for k in range(1, batches)]
    at = F.coalesce(F.size(F.filter(F.array(*[F.col(delivered_col) >= F.lit(c) for c in cuts]), lambda x: x)), F.lit(0)) if cuts else F.lit(0)
    for n in range(len(cuts) + 1):
        table.apply(feed.filter(at == n) if cuts else feed, n)
    return table.read()
