"""Positional inverted index: documents with word arrays, postings, vocabulary; build and publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.functions.text import tokens
from chatlore.plans.nodes import FIELDS


def with_tokens(current: DataFrame, fields=FIELDS) -> DataFrame:
    """Messages with the words of their fields as ``tok_<field>``."""
    return current.withColumns({f"tok_{f}": tokens(F.col(f)) for f in fields})


def postings(docs: DataFrame, fields=FIELDS) -> DataFrame:
    """(token, zgram_id, field, pos, field_len) of every word."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"tok_{f}").alias("words")) for f in fields])
    rows = docs.select("zgram_id", F.explode(each).alias("f")).select("zgram_id", "f.field", F.size("f.words").alias("field_len"), F.posexplode("f.words"))
    return rows.select(F.col("col").alias("token"), "zgram_id", "field", "pos", "field_len")


def vocabulary(post: DataFrame) -> DataFrame:
    """(token, n_words, n_zgrams)."""
    return post.groupBy("token", "zgram_id").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.sum("c").alias("n_words"), F.count("*").alias("n_zgrams"))


class Index:
    """An index kept as Parquet tables, or as plain DataFrames if ``path`` is None."""

    def __init__(self, spark: SparkSession, docs: DataFrame, post: DataFrame, vocab: DataFrame, reactions: DataFrame | None = None):
        self.spark, self.docs, self.postings, self.vocab, self.reactions = spark, docs, post, vocab, reactions

    @classmethod
    def of(cls, current: DataFrame, reactions: DataFrame | None = None) -> "Index":
        docs = with_tokens(current)
        post = postings(docs)
        return cls(current.sparkSession, docs, post, post.select("token").distinct(), reactions)

    @classmethod
    def build(cls, current: DataFrame, path: str, reactions: DataFrame | None = None, files: int | None = None) -> "Index":
        """Write the tables below ``path``: documents by id range, postings by token range."""
        spark = current.sparkSession
        n = files or spark.sparkContext.defaultParallelism
        docs = with_tokens(current).repartitionByRange(n, "zgram_id").sortWithinPartitions("zgram_id")
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        postings(docs).repartitionByRange(n, "token", "zgram_id").sortWithinPartitions("token", "zgram_id", "field", "pos").write.mode("overwrite").parquet(f"{path}/postings")
        post = spark.read.parquet(f"{path}/postings")
        vocabulary(post).write.mode("overwrite").parquet(f"{path}/vocab")
        if reactions is not None:
            reactions.write.mode("overwrite").parquet(f"{path}/reactions")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Index":
        folder, fs = _pointer(spark, path, "reactions")
        reactions = spark.read.parquet(f"{path}/reactions") if fs.exists(folder) else None
        return cls(spark, *[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "vocab")], reactions)

    def with_delta(self, newer: "Index") -> "Index":
        """Base and newer rows as one; ids of the newer ones win."""
        fresh = newer.docs.select("zgram_id")
        return Index(self.spark, self.docs.join(fresh, "zgram_id", "left_anti").unionByName(newer.docs),
                     self.postings.join(fresh, "zgram_id", "left_anti").unionByName(newer.postings),
                     self.vocab.select("token").unionByName(newer.vocab.select("token")).distinct(), newer.reactions or self.reactions)


POINTER = "CURRENT"


def _pointer(spark: SparkSession, root: str, name: str = POINTER):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` (a folder below ``root``) the current one, by a new numbered pointer that is put in place
    with one rename. A reader always finds a pointer: the one before stays until the new one is there."""
    old = _pointers(spark, root)
    n = max(old, default=-1) + 1
    (new, fs), (now, _) = _pointer(spark, root, f".{POINTER}-{n}.new"), _pointer(spark, root, f"{POINTER}-{n}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(new, now):
        raise RuntimeError(f"{root}: another index was published at the same time")
    for k in sorted(old)[:-1]:  # the last one may just be read
        fs.delete(_pointer(spark, root, f"{POINTER}-{k}")[0], False)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    path, fs = _pointer(spark, root, f"{POINTER}-*")
    return [int(s.getPath().getName().rpartition("-")[2]) for s in fs.globStatus(path) or []]


def current_version(spark: SparkSession, root: str) -> str | None:
    found = _pointers(spark, root)
    return spark.read.text(f"{root}/{POINTER}-{max(found)}").first()[0] if found else None
