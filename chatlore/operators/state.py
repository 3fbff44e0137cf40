"""Keyed state in the shared folder: tables in buckets of their key, with a manifest for each step.

A table is a folder with one folder for each step and bucket below it. A step adds rows to tables or
replaces some buckets of them; it counts only once its manifest is there, which is put in place by
one rename. So a step that fails halfway, or runs again, leaves no trace, and whoever opens the
folder later finds the last complete state. Reads name the buckets that they need.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP, BUCKET = "_step", "_bucket"


def together(jobs: list[Callable[[], object]]) -> list:
    """Results of some jobs that don't depend on each other, run at the same time."""
    if len(jobs) == 1:
        return [jobs[0]()]
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda job: job(), jobs))


class State:
    """Manifest: ``steps`` (what was applied) and, for each table, bucket -> steps whose rows count, and its schema."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._manifests()
        if found:
            self.manifest = json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/manifest-{max(found)}").first()[0])
        else:
            self.manifest = {"buckets": buckets, "steps": [], "tables": {}}
        self.next = max(found, default=-1) + 1
        self.buckets = self.manifest["buckets"]
        self.read_buckets: dict[str, list[int]] = {}  # of the last reads, by table

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        path, fs = self._fs(f"{self.path}/manifest-*")
        return [int(s.getPath().getName().partition("-")[2]) for s in fs.globStatus(path) or [] if s.getPath().getName().partition("-")[2].isdigit()]

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, *rows: Column | DataFrame) -> list[int]:
        """The distinct buckets (at most ``buckets`` numbers) of data frames with a ``_bucket`` column."""
        every = None
        for r in rows:
            r = r.select(BUCKET)
            every = r if every is None else every.unionByName(r)
        return sorted(r[0] for r in every.distinct().collect())

    def read(self, name: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets (all by default), with ``_bucket`` and ``_step``."""
        full = T.StructType([*schema.fields, T.StructField(STEP, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())])
        live = self.manifest["tables"].get(name, {})
        wanted = [b for b in (range(self.buckets) if buckets is None else buckets) if live.get(str(b))]
        self.read_buckets[name] = wanted
        if not wanted:
            return self.spark.createDataFrame([], full)
        # buckets with the same steps are one condition
        by_steps: dict[tuple, list[int]] = {}
        for b in wanted:
            by_steps.setdefault(tuple(live[str(b)]), []).append(b)
        keep = F.lit(False)
        for steps, some in by_steps.items():
            keep = keep | (F.col(STEP).isin(*steps) & F.col(BUCKET).isin(*some))
        return self.spark.read.schema(full).parquet(f"{self.path}/{name}").filter(keep)

    def write(self, name: str, rows: DataFrame, replace: list[int] | None = None) -> None:
        """Add rows (with ``_bucket``) to a table; ``replace``: buckets whose earlier rows no longer count."""
        self.write_all([(name, rows, replace)])

    def write_all(self, tables: list[tuple[str, DataFrame, list[int] | None]]) -> None:
        """Write several tables, side by side."""
        together([lambda n=n, r=r: self._put(n, r) for n, r, _ in tables])
        for name, _, replace in tables:
            path, fs = self._fs(f"{self.path}/{name}/{STEP}={self.next}/{BUCKET}=*")
            live = self.manifest["tables"].setdefault(name, {})
            for b in replace or ():
                live[str(b)] = []
            for b in sorted(int(s.getPath().getName().partition("=")[2]) for s in fs.globStatus(path) or []):
                live[str(b)] = [*live.get(str(b), []), self.next]

    def _put(self, name: str, rows: DataFrame) -> None:
        # one file a bucket, written by as many tasks as there are cores
        tasks = min(self.buckets, self.spark.sparkContext.defaultParallelism)
        rows.repartition(tasks, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{name}/{STEP}={self.next}")

    def done(self, step: int | str) -> bool:
        return step in self.manifest["steps"]

    def commit(self, step: int | str) -> None:
        """Make this step count."""
        self.manifest["steps"].append(step)
        new, fs = self._fs(f"{self.path}/.manifest-{self.next}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        if not fs.rename(new, self._fs(f"{self.path}/manifest-{self.next}")[0]):
            raise RuntimeError(f"step {step} was applied by another writer")
        self.next += 1

    def compact(self, name: str, schema: T.StructType, most: int) -> None:
        """Rewrite the buckets that are spread over more than ``most`` steps."""
        live = self.manifest["tables"].get(name, {})
        many = [int(b) for b, steps in live.items() if len(steps) > most]
        if many:
            self.write(name, self.read(name, schema, many).drop(STEP), replace=many)
