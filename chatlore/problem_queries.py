"""Queries of the general data problems: change feeds, records that fail, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.operators.changes import current_state
from chatlore.operators.decode import decode_lines, decode_tuples
from chatlore.operators.orphans import references, track
from chatlore.operators.state import together
from chatlore.shared import table


def feed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Current state of a change feed."""
    log = table(spark, d, name)
    if name == "reactions_log":
        return current_state(log, ["zgram_id", "reaction", "creator"], deleted=~F.col("value"), changes=F.col("value").isNotNull())
    if name == "revisions_log":
        return current_state(log, ["zgram_id"], deleted=F.col("instance").isNull() & F.col("body").isNull() & F.col("render_style").isNull())
    return current_state(log, ["user_id"], deleted=F.col("zmojis").isNull())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    names = ("reactions_log", "revisions_log", "zmojis_log")
    states = together([lambda n=n: feed(spark, d, n) for n in names])
    out = None
    for name, state in zip(names, states):
        rows = state.select(F.lit(name).alias("feed"), "seq")
        out = rows if out is None else out.unionByName(rows)
    return out


def p4_reactions(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d, "reactions_log").select("zgram_id", "reaction", "creator", "seq")


def p4_revisions(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d, "revisions_log").select("zgram_id", "instance", "body", "render_style", "seq")


def p4_zmojis(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d, "zmojis_log").select("user_id", "zmojis", "seq")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    lines = decode_lines(table(spark, d, "raw_lines")).failures
    tuples = decode_tuples(table(spark, d, "raw_tuples")).failures
    return lines.select(F.lit("raw_lines").alias("source_table"), "row_id", "reason").unionByName(
        tuples.select(F.lit("raw_tuples").alias("source_table"), "row_id", "reason"))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    return decode_lines(table(spark, d, "raw_lines")).valid()


def p5_tuples(spark: SparkSession, d: str) -> DataFrame:
    return decode_tuples(table(spark, d, "raw_tuples")).valid()


def _tracker(spark: SparkSession, d: str):
    refs = references({
        "reactions_log": (table(spark, d, "reactions_log"), ["zgram_id"]),
        "revisions_log": (table(spark, d, "revisions_log"), ["zgram_id"]),
        "refers_log": (table(spark, d, "refers_log"), ["zgram_id", "refers_to"]),
    })
    parents = table(spark, d, "zgrams").select(F.col("zgram_id").alias("parent_id"),
                                               F.col("delivered_at").alias("first_seen"))
    deleted = table(spark, d, "purged_zgrams").select(F.col("zgram_id").alias("parent_id"),
                                                      F.col("purged_at").alias("deleted_at"))
    return track(refs, parents, deleted)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _tracker(spark, d).report().select("feed", "ref_field", "seq")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per log, column and month of ``log_date``: the last snapshot of the tracker."""
    tracker = _tracker(spark, d)
    last = tracker.snapshots().filter(F.col("step") == str(tracker.state.manifest["steps"][-1]))
    return last.groupBy("feed", "ref_field", F.date_format("period", "yyyy-MM").alias("month")).agg(F.sum("n_refs").alias("n_refs"))


QUERIES = {f.__name__: f for f in (p4_found, p4_reactions, p4_revisions, p4_zmojis, p5_found, p5_lines, p5_tuples,
                                   p7_found, p7_counts)}

_LATEST = """SELECT * FROM {t} WHERE {valid} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC, delivered_at) = 1"""
_RX = _LATEST.format(t="reactions_log", keys="zgram_id, reaction, creator",
                     valid="value IS NOT NULL AND zgram_id IS NOT NULL AND reaction IS NOT NULL AND creator IS NOT NULL")
_REV = _LATEST.format(t="revisions_log", keys="zgram_id", valid="zgram_id IS NOT NULL")
_ZM = _LATEST.format(t="zmojis_log", keys="user_id", valid="user_id IS NOT NULL")
_KEPT_REV = "(instance IS NOT NULL OR body IS NOT NULL OR render_style IS NOT NULL)"

_P7 = """
WITH refs AS (
  SELECT 'reactions_log' AS feed, 'zgram_id' AS ref_field, seq, zgram_id AS id, log_date, delivered_at FROM reactions_log
  UNION ALL SELECT 'revisions_log', 'zgram_id', seq, zgram_id, log_date, delivered_at FROM revisions_log
  UNION ALL SELECT 'refers_log', 'zgram_id', seq, zgram_id, log_date, delivered_at FROM refers_log
  UNION ALL SELECT 'refers_log', 'refers_to', seq, refers_to, log_date, delivered_at FROM refers_log),
r AS (SELECT feed, ref_field, seq, min(id) AS id, min(log_date) AS log_date, min(delivered_at) AS at
      FROM refs WHERE id IS NOT NULL GROUP BY ALL),
z AS (SELECT zgram_id AS id, min(delivered_at) AS at FROM zgrams GROUP BY ALL)
SELECT {out} FROM r LEFT JOIN z USING (id)
WHERE z.at IS NULL OR z.at > r.at OR r.id IN (SELECT zgram_id FROM purged_zgrams) {tail}"""



def _array(path: str, n: int) -> str:
    return f"coalesce(json_type(j, '{path}') = 'ARRAY' AND json_array_length(j, '{path}') = {n}, false)"


def _is(path: str, kind: str) -> str:
    text = f"json_extract_string(j, '{path}')"
    return {
        "int": f"coalesce(json_type(j, '{path}') = 'UBIGINT' AND TRY_CAST({text} AS BIGINT) IS NOT NULL, false)",
        "string": f"coalesce(json_type(j, '{path}') = 'VARCHAR', false)", "flag": f"coalesce(json_type(j, '{path}') = 'BOOLEAN', false)",
        "style": f"coalesce(json_type(j, '{path}') = 'VARCHAR' AND {text} IN ('d', 'x'), false)",
    }[kind]


_P = "$[0][1][0][1]"  # where the cells of a metadata record are
_LINE_SHAPE = {
    "z": [("$", 1), ("$[0]", 2), ("$[0][1]", 6), ("$[0][1][0]", 1), ("$[0][1][5]", 3)],
    "rx": [(_P, 4), (f"{_P}[0]", 1)], "zgrev": [(_P, 2), (f"{_P}[0]", 1), (f"{_P}[1]", 3)], "ref": [(_P, 3), (f"{_P}[0]", 1), (f"{_P}[1]", 1)], "zmojis": [(_P, 2)],
}
_LINE_VALUES = {
    "z": [("$[0][1][0][0]", "int"), ("$[0][1][1]", "int"), ("$[0][1][2]", "string"), ("$[0][1][3]", "string"), ("$[0][1][4]", "flag"), ("$[0][1][5][0]", "string"), ("$[0][1][5][1]", "string"), ("$[0][1][5][2]", "style")],
    "rx": [(f"{_P}[0][0]", "int"), (f"{_P}[1]", "string"), (f"{_P}[2]", "string"), (f"{_P}[3]", "flag")],
    "zgrev": [(f"{_P}[0][0]", "int"), (f"{_P}[1][0]", "string"), (f"{_P}[1][1]", "string"), (f"{_P}[1][2]", "style")],
    "ref": [(f"{_P}[0][0]", "int"), (f"{_P}[1][0]", "int"), (f"{_P}[2]", "flag")], "zmojis": [(f"{_P}[0]", "string"), (f"{_P}[1]", "string")],
}
_META_SHAPE = [("$", 1), ("$[0]", 2), ("$[0][1]", 1), ("$[0][1][0]", 2)]
_WHEN = " ".join(
    f"WHEN '{k}' THEN CASE WHEN NOT ({' AND '.join(_array(*x) for x in ([] if k == 'z' else _META_SHAPE) + _LINE_SHAPE[k])}) THEN 'shape' "
    f"WHEN NOT ({' AND '.join(_is(*x) for x in _LINE_VALUES[k])}) THEN 'value' END" for k in _LINE_SHAPE)


def _tuple(i: int, kind: str) -> str:
    x = f"x[{i}]"
    below = {"i": "9223372036854775807", "u": "4294967295"}
    return f"{x} IN ('T', 'F')" if kind == "b" else "true" if kind == "s" else (
        f"(regexp_full_match({x}, '[0-9]+') AND (length(ltrim({x}, '0')) < {len(below[kind])} OR length(ltrim({x}, '0')) = {len(below[kind])} AND ltrim({x}, '0') <= '{below[kind]}'))")


_TUPLES = {"reactions_by_id": "issb", "revisions": "issu", "refers_to": "iib", "zmojis": "ss", "zgram": "iissbssuuu"}
_TUPLE_WHEN = " ".join(f"WHEN '{k}' THEN CASE WHEN len(x) <> {len(v)} THEN 'shape' WHEN NOT ({' AND '.join(_tuple(i, c) for i, c in enumerate(v, 1))}) THEN 'value' END" for k, v in _TUPLES.items())
# what is outside strings: the SQL engine's parser lets surplus commas, NaN and Infinity pass
_BARE = """regexp_replace(line, '"(?:[^"\\\\]|\\\\.)*"', '""', 'gs')"""
_P5 = f"""WITH l AS (SELECT line_id, CASE WHEN json_valid(line) AND NOT regexp_matches({_BARE}, ',\\s*[\\]}}]|(?i:nan|inf)') THEN CAST(line AS JSON) END AS j FROM raw_lines),
k AS (SELECT line_id, j, CASE WHEN json_type(j, '$[0][0]') = 'VARCHAR' AND json_extract_string(j, '$[0][0]') = 'z' THEN 'z'
  WHEN json_type(j, '$[0][0]') = 'VARCHAR' AND json_extract_string(j, '$[0][0]') = 'm' AND json_type(j, '$[0][1][0][0]') = 'VARCHAR' THEN json_extract_string(j, '$[0][1][0][0]') END AS kind FROM l),
r AS (SELECT 'raw_lines' AS source_table, line_id AS row_id, CASE WHEN j IS NULL THEN 'syntax' WHEN coalesce(kind, '') NOT IN ('z', 'rx', 'zgrev', 'ref', 'zmojis') THEN 'shape' ELSE CASE kind {_WHEN} END END AS reason FROM k),
t AS (SELECT 'raw_tuples' AS source_table, tuple_id AS row_id, CASE WHEN x IS NULL OR coalesce(layout, '') NOT IN ({', '.join(f"'{k}'" for k in _TUPLES)}) THEN 'shape' ELSE CASE layout {_TUPLE_WHEN} END END AS reason
  FROM (SELECT tuple_id, layout, string_split(record, 'ÿ') AS x FROM raw_tuples))
SELECT * FROM r WHERE reason IS NOT NULL UNION ALL SELECT * FROM t WHERE reason IS NOT NULL"""

ORACLE = {
    "p5_found": _P5,
    "p4_found": f"SELECT 'reactions_log' AS feed, seq FROM ({_RX}) WHERE value "
                f"UNION ALL SELECT 'revisions_log', seq FROM ({_REV}) WHERE {_KEPT_REV} "
                f"UNION ALL SELECT 'zmojis_log', seq FROM ({_ZM}) WHERE zmojis IS NOT NULL",
    "p4_reactions": f"SELECT zgram_id, reaction, creator, seq FROM ({_RX}) WHERE value",
    "p4_revisions": f"SELECT zgram_id, instance, body, render_style, seq FROM ({_REV}) WHERE {_KEPT_REV}",
    "p4_zmojis": f"SELECT user_id, zmojis, seq FROM ({_ZM}) WHERE zmojis IS NOT NULL",
    "p7_found": _P7.format(out="feed, ref_field, seq", tail=""),
    "p7_counts": _P7.format(out="feed, ref_field, strftime(log_date, '%Y-%m') AS month, count(*) AS n_refs",
                            tail="GROUP BY ALL"),
}
