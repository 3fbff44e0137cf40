"""Log directories: one JSON record a line in ``logged/yyyy/mm/yyyymmdd.logged`` (or ``unlogged``).

A day's log may also be in numbered parts (``yyyymmdd.logged.000`` and on), which are its pieces in
order: appending adds a part, compacting makes them one file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlore.functions import text as T
from chatlore.operators.decode import decode_lines

_PATH = r"/(logged|unlogged)/(\d{4})/(\d{2})/(\d{4})(\d{2})(\d{2})\.(logged|unlogged)(?:\.(\d{3,}))?$"
Position = tuple[str, int]  # day (yyyymmdd) and byte in that day's log
MESSAGE = ["zgram_id", "timesecs", "sender", "signature", "is_logged", "instance", "body", "render_style"]


def plaintext_path(day: str, logged: bool) -> str:
    """Path of a day (yyyymmdd) below the root."""
    kind = "logged" if logged else "unlogged"
    return f"{kind}/{day[:4]}/{day[4:6]}/{day}.{kind}"


def read(spark: SparkSession, root: str, since: str | None = None, logged: tuple[Position, Position] | None = None,
         unlogged: tuple[Position, Position] | None = None) -> DataFrame:
    """(line_id, log_date, is_logged_file, line_no, begin, line) of all log files with a valid path.

    ``line_id`` is in log order: by day, then kind, then place in the log; ``begin`` is the byte at which
    a line starts. ``since`` (yyyy-mm-dd) skips older days before their lines are read. ``logged`` and
    ``unlogged`` clip each kind to the lines that lie within [from, to).
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*logged*").text(root)
    path = F.col("_metadata.file_path")
    rows = rows.select(F.col("value").alias("line"), path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    part = [F.regexp_extract("path", _PATH, n) for n in range(1, 9)]
    good = F.col("path").rlike(_PATH) & (part[0] == part[6]) & (part[1] == part[3]) & (part[2] == part[4])
    day = F.try_to_date(F.concat_ws("-", part[3], part[4], part[5]), "yyyy-MM-dd")
    rows = rows.filter(good).withColumns({"log_date": day, "is_logged_file": part[0] == "logged", "part": F.coalesce(part[7].try_cast("int"), F.lit(-1))}).filter("log_date is not null")
    if since:
        rows = rows.filter(F.col("log_date") >= since)
    for kind, span in ((True, logged), (False, unlogged)):
        if span:  # whole days first, which spares their files
            ymd = F.date_format("log_date", "yyyyMMdd")
            rows = rows.filter((F.col("is_logged_file") != kind) | ymd.between(span[0][0], span[1][0]))
    # lines are numbered in their block of a file, and blocks in the log: no task holds a whole log
    log = ["log_date", "is_logged_file"]
    block = [*log, "part", "block"]
    size = F.octet_length("line") + 1
    blocks = rows.groupBy(*block).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    before = Window.partitionBy(*log).orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*block, "first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("n", "bytes")])
    within = Window.partitionBy(*block).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(size).over(within), F.lit(0))).join(blocks, block)
    rows = rows.withColumns({"line_no": F.col("before_n") + F.col("at") - F.col("first") + 1, "begin": F.col("before_bytes") + F.col("within")})
    for kind, span in ((True, logged), (False, unlogged)):
        if span:
            ymd = F.date_format("log_date", "yyyyMMdd")
            inside = (F.struct(ymd.alias("d"), F.col("begin").alias("b")) >= F.struct(F.lit(span[0][0]).alias("d"), F.lit(span[0][1]).cast("long").alias("b"))) & (
                F.struct(ymd.alias("d"), (F.col("begin") + size).cast("long").alias("b")) <= F.struct(F.lit(span[1][0]).alias("d"), F.lit(span[1][1]).cast("long").alias("b")))
            rows = rows.filter((F.col("is_logged_file") != kind) | inside)
    key = T.day_key(F.col("log_date"), F.col("is_logged_file"))
    return rows.select((key * 10_000_000_000 + F.col("line_no")).alias("line_id"), "log_date", "is_logged_file", "line_no", "begin", "line")


def load(lines: DataFrame, fail_fast: bool = True) -> dict[str, DataFrame]:
    """Typed tables of log lines: zgrams, reactions_log, revisions_log, refers_log, zmojis_log.

    A line that doesn't decode raises unless ``fail_fast`` is off (then it is left out).
    """
    decoded = decode_lines(lines)
    typed = decoded.valid() if not fail_fast else decoded._typed
    if fail_fast:
        bad = decoded.failures.limit(1).collect()
        if bad:
            raise ValueError(f"line {bad[0]['row_id']} doesn't decode: {bad[0]['reason']}")
    rows = typed.join(lines.select("line_id", "log_date"), "line_id").withColumnRenamed("line_id", "seq")
    one = lambda layout, *c: rows.filter(F.col("layout") == layout).select(*c)
    return {
        "zgrams": one("z", *MESSAGE, "log_date"),
        "reactions_log": one("rx", "seq", "zgram_id", "reaction", "creator", "value", "log_date"),
        "revisions_log": one("zgrev", "seq", "zgram_id", "instance", "body", "render_style", "log_date"),
        "refers_log": one("ref", "seq", "zgram_id", "refers_to", "value", "log_date"),
        "zmojis_log": one("zmojis", "seq", "user_id", "zmojis", "log_date"),
    }


def out_of_order(zgrams: DataFrame, block_rows: int = 1 << 20) -> DataFrame:
    """Messages whose id isn't above the highest one before them in their log (by ``seq``), within each day.

    In blocks of ``seq``, and then over block maxima, so that a day isn't one task."""
    log = ["log_date", "is_logged"]
    rows = zgrams.withColumn("_block", F.floor(F.col("seq") / block_rows))
    top = rows.groupBy(*log, "_block").agg(F.max("zgram_id").alias("_top"))
    w = Window.partitionBy(*log).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    top = top.select(*log, "_block", F.max("_top").over(w).alias("_above"))
    inner = Window.partitionBy(*log, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.max("zgram_id").over(inner)).join(top, [*log, "_block"])
    return rows.filter(F.col("zgram_id") <= F.greatest("_before", "_above")).drop("_before", "_above", "_block")


def wrong_kind(lines: DataFrame, zgrams: DataFrame) -> DataFrame:
    """Messages (with ``seq`` of their line) that say another kind than the log they stand in."""
    kind = lines.select(F.col("line_id").alias("seq"), "is_logged_file")
    return zgrams.join(kind, "seq").filter("is_logged <> is_logged_file").drop("is_logged_file")


def _hadoop(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, root: str, kind: str, day: str = "*") -> list[tuple[str, int, int]]:
    """(day, part, bytes) of the log files of a kind, a whole file being part -1."""
    path, fs = _hadoop(spark, f"{root}/{kind}/*/*/{day}.{kind}*")
    out = []
    for s in fs.globStatus(path) or []:
        name = s.getPath().getName().split(".")
        if len(name) == 2 or len(name) == 3 and name[2].isdigit():
            out.append((name[0], int(name[2]) if len(name) == 3 else -1, s.getLen()))
    return sorted(out)


def append(lines: DataFrame, root: str) -> None:
    """Append (log_date, is_logged, line) rows to the logs of their day and kind, as new parts in order of ``nth`` if there is such a column.

    What is written is moved into place file by file; ``read`` sees it at once.
    """
    spark = lines.sparkSession
    folder = f"{root}/.incoming-{uuid.uuid4().hex}"
    order = ["nth"] if "nth" in lines.columns else []
    rows = lines.select(F.when(F.col("is_logged"), "logged").otherwise("unlogged").alias("kind"), F.date_format("log_date", "yyyyMMdd").alias("day"), "line", *order)
    rows = rows.repartitionByRange("kind", "day", *order).sortWithinPartitions("kind", "day", *order) if order else rows
    rows.drop(*order).write.partitionBy("kind", "day").text(folder)
    path, fs = _hadoop(spark, f"{folder}/kind=*/day=*/part-*")
    next_part: dict[tuple[str, str], int] = {}
    for s in sorted(fs.globStatus(path) or [], key=lambda s: s.getPath().getName()):
        day, kind = (s.getPath().getParent().getName(), s.getPath().getParent().getParent().getName())
        day, kind = day.partition("=")[2], kind.partition("=")[2]
        if (kind, day) not in next_part:
            next_part[kind, day] = max([p for _, p, _ in _parts(spark, root, kind, day)], default=-1) + 1
        to, _ = _hadoop(spark, f"{root}/{plaintext_path(day, kind == 'logged')}.{next_part[kind, day]:03d}")
        fs.mkdirs(to.getParent())
        if not fs.rename(s.getPath(), to):
            raise RuntimeError(f"{to} is there already")
        next_part[kind, day] += 1
    fs.delete(_hadoop(spark, folder)[0], True)


def next_position(spark: SparkSession, root: str, today: str, logged: bool) -> Position:
    """Where the next record of a kind goes: the start of today's log, or the end of the logs if that is later."""
    parts = _parts(spark, root, "logged" if logged else "unlogged")
    last = max([d for d, _, _ in parts], default="")
    return (today, 0) if last < today else (last, sum(n for d, _, n in parts if d == last))


def compact(spark: SparkSession, root: str, day: str, logged: bool) -> None:
    """Make one file of a day's parts, in their order, by concatenating them where they are stored."""
    kind = "logged" if logged else "unlogged"
    parts = _parts(spark, root, kind, day)
    if len(parts) < 2:
        return
    base = f"{root}/{plaintext_path(day, logged)}"
    new, fs = _hadoop(spark, f"{base.rpartition('/')[0]}/.{day}.{kind}.new")
    out = fs.create(new, True)
    names = [base if p < 0 else f"{base}.{p:03d}" for _, p, _ in parts]
    jvm = spark.sparkContext._jvm
    for n in names:
        source = fs.open(_hadoop(spark, n)[0])
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
    for n in names:
        fs.delete(_hadoop(spark, n)[0], False)
    fs.rename(new, _hadoop(spark, base)[0])


def encode(tables: dict[str, DataFrame], *also: str) -> DataFrame:
    """(layout, seq, line, also): records of typed tables as log lines."""
    parts = []
    for name, kind, cells in (("zgrams", "z", MESSAGE), ("reactions_log", "rx", ["zgram_id", "reaction", "creator", "value"]),
                              ("revisions_log", "zgrev", ["zgram_id", "instance", "body", "render_style"]),
                              ("refers_log", "ref", ["zgram_id", "refers_to", "value"]), ("zmojis_log", "zmojis", ["user_id", "zmojis"])):
        if name in tables:
            columns = [F.col(c) for c in cells]
            line = T.encode_message(*columns) if kind == "z" else T.encode_metadata(kind, *columns)
            parts.append(tables[name].select(F.lit(kind).alias("layout"), F.col("zgram_id" if kind == "z" else "seq").alias("seq"), line.alias("line"), *also))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
