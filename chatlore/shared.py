"""Helpers that every operator may use: table access, and tables in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 1 << 30
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the one that all executors share, named by ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a temporary folder; a cluster has no folder that all
    executors would see, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chatlore-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders that were named since then (all by default); their results can't be read any more."""
    jvm = spark.sparkContext._jvm
    for p in _written[since:]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder within is deleted at the end: ``with scratch(spark): query().write...``."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that its lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def size_in_bytes(df: DataFrame) -> int:
    """What the optimizer expects ``df`` to hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A small input that fills fewer splits than there are cores, over all cores; any other as it is.

    At most ``SPREAD_BYTES`` are moved, whatever the size of the cluster: large inputs get their
    parallelism from ``spark.sql.files.maxPartitionBytes``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size_in_bytes(df) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
