"""Rows that fail to parse: records to typed rows, failures with their reason.

A record is parsed into cells (row, column, value); the cells are joined to a rule table, the rules
are evaluated, errors are aggregated to one reason for each row, and the valid rows are what an
anti join with the failures leaves. The first reason that applies wins: ``syntax``, ``shape``,
``value``.

Defined cases: a null or empty line is no JSON text (``syntax``); a null tuple or an unknown or null
layout is ``shape``; repeated rows give repeated results; other columns pass through.

Scale: everything is a JVM expression. Cells of a row are made in one task, so the aggregate is
reduced to a row each before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules: layout -> (column, place, kind of value). Fixed by the wire format.
LINE_LAYOUTS: dict[str, list[tuple[str, str, str]]] = {
    "z": [
        ("root", "$", "array 1"), ("record", "$[0]", "array 2"), ("message", "$[0][1]", "array 6"),
        ("id", "$[0][1][0]", "array 1"), ("core", "$[0][1][5]", "array 3"),
        ("zgram_id", "$[0][1][0][0]", "int"), ("timesecs", "$[0][1][1]", "int"), ("sender", "$[0][1][2]", "string"),
        ("signature", "$[0][1][3]", "string"), ("is_logged", "$[0][1][4]", "flag"),
        ("instance", "$[0][1][5][0]", "string"), ("body", "$[0][1][5][1]", "string"),
        ("render_style", "$[0][1][5][2]", "style"),
    ],
    "rx": [
        ("payload", "$[0][1][0][1]", "array 4"), ("id", "$[0][1][0][1][0]", "array 1"),
        ("zgram_id", "$[0][1][0][1][0][0]", "int"), ("reaction", "$[0][1][0][1][1]", "string"),
        ("creator", "$[0][1][0][1][2]", "string"), ("value", "$[0][1][0][1][3]", "flag"),
    ],
    "zgrev": [
        ("payload", "$[0][1][0][1]", "array 2"), ("id", "$[0][1][0][1][0]", "array 1"),
        ("core", "$[0][1][0][1][1]", "array 3"), ("zgram_id", "$[0][1][0][1][0][0]", "int"),
        ("instance", "$[0][1][0][1][1][0]", "string"), ("body", "$[0][1][0][1][1][1]", "string"),
        ("render_style", "$[0][1][0][1][1][2]", "style"),
    ],
    "ref": [
        ("payload", "$[0][1][0][1]", "array 3"), ("id", "$[0][1][0][1][0]", "array 1"),
        ("parent", "$[0][1][0][1][1]", "array 1"), ("zgram_id", "$[0][1][0][1][0][0]", "int"),
        ("refers_to", "$[0][1][0][1][1][0]", "int"), ("value", "$[0][1][0][1][2]", "flag"),
    ],
    "zmojis": [
        ("payload", "$[0][1][0][1]", "array 2"), ("user_id", "$[0][1][0][1][0]", "string"),
        ("zmojis", "$[0][1][0][1][1]", "string"),
    ],
}
META = [("root", "$", "array 1"), ("record", "$[0]", "array 2"), ("metas", "$[0][1]", "array 1"),
        ("meta", "$[0][1][0]", "array 2")]
for _kind in ("rx", "zgrev", "ref", "zmojis"):
    LINE_LAYOUTS[_kind] = META + LINE_LAYOUTS[_kind]

TUPLE_LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "reactions_by_id": [("zgram_id", "i"), ("reaction", "s"), ("creator", "s"), ("value", "b")],
    "revisions": [("zgram_id", "i"), ("instance", "s"), ("body", "s"), ("style", "u")],
    "refers_to": [("zgram_id", "i"), ("refers_to", "i"), ("value", "b")],
    "zmojis": [("user_id", "s"), ("zmojis", "s")],
    "zgram": [("zgram_id", "i"), ("timesecs", "i"), ("sender", "s"), ("signature", "s"), ("is_logged", "b"),
              ("instance", "s"), ("body", "s"), ("style", "u"), ("offset", "u"), ("size", "u")],
}
ITEM_SEPARATOR = "ÿ"
TYPES = {"zgram_id": "bigint", "timesecs": "bigint", "is_logged": "boolean", "value": "boolean",
         "refers_to": "bigint", "style": "bigint", "offset": "bigint", "size": "bigint"}


def strict_json(line: Column) -> Column:
    """``[line]`` as a variant, or null where the line isn't exactly one JSON text.

    The built-in parser is strict but stops after the first value. What follows it is caught by
    parsing the line twice, as the only element of an array and as the only member of an object: a
    surplus bracket can close one of them, never both. Numbers beyond the parser's length limit are
    shortened for a second attempt; they are out of every range anyway.
    """
    def once(text: Column) -> Column:
        v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        w = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))
        return F.when(w.isNotNull(), v)
    return F.coalesce(once(line), once(F.regexp_replace(line, r"(\d{64})\d{800,}", "$1")))


def _with_duplicate_keys(spark: SparkSession, build):
    """Build expressions that accept repeated member names, which the JSON grammar allows."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return build()
    finally:
        spark.conf.set(name, before)


class Decoded:
    """Failures (``row_id``, ``reason``) and valid typed rows of one table of records."""

    def __init__(self, rows: DataFrame, row_id: str, failures: DataFrame, typed: DataFrame):
        self.rows, self.row_id, self.failures, self._typed = rows, row_id, failures, typed

    def valid(self) -> DataFrame:
        return self._typed.join(self.failures.select(F.col("row_id").alias("_bad")),
                                F.col(self.row_id) == F.col("_bad"), "left_anti")


def _layout(v: Column) -> Column:
    tag = F.try_variant_get(v, "$[0][0]", "variant")
    kind = F.try_variant_get(v, "$[0][1][0][0]", "variant")

    def text(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))
    return F.when(text(tag) == "z", "z").when(
        (text(tag) == "m") & text(kind).isin("rx", "zgrev", "ref", "zmojis"), text(kind))


def decode_lines(lines: DataFrame, row_id: str = "line_id", text: str = "line") -> Decoded:
    spark = lines.sparkSession

    def build() -> Decoded:
        # exploded, so that no later filter or projection parses the line again
        once = F.transform(F.array(F.try_variant_get(strict_json(F.col(text)), "$[0]", "variant")),
                           lambda v: F.struct(v.alias("v"), _layout(v).alias("layout")))
        parsed = lines.select("*", F.explode(once).alias("_p")).withColumns({"_v": F.col("_p.v"), "_layout": F.col("_p.layout")}).drop("_p")

        def cells(layout: str) -> Column:
            out = []
            for column, path, kind in LINE_LAYOUTS[layout]:
                if kind.startswith("array"):
                    n = F.size(F.try_variant_get("_v", path, "array<variant>"))
                    value = F.coalesce(n, F.lit(-1)).cast("string")
                else:
                    value = F.try_variant_get("_v", path, "string")
                kind_found = F.lit("ARRAY") if kind.startswith("array") else F.schema_of_variant(
                    F.try_variant_get("_v", path, "variant"))
                out.append(F.struct(F.lit(column).alias("column"), kind_found.alias("found"), value.alias("value")))
            return F.array(*out)

        by_layout = F.when(F.lit(False), cells("z"))
        for layout in LINE_LAYOUTS:
            by_layout = by_layout.when(F.col("_layout") == layout, cells(layout))
        exploded = parsed.filter(F.col("_layout").isNotNull()).select(
            F.col(row_id).alias("row_id"), F.col("_layout").alias("layout"), F.explode(by_layout).alias("c")
        ).select("row_id", "layout", "c.*")
        rules = spark.createDataFrame(
            [(lay, c, k.split()[0], k.partition(" ")[2]) for lay, r in LINE_LAYOUTS.items() for c, _, k in r],
            "layout string, column string, kind string, size string")
        found, value, kind = F.col("found"), F.col("value"), F.col("kind")
        ok = (
            F.when(kind == "array", value == F.col("size"))
            .when(kind == "int", (found == "BIGINT") & (F.expr("try_cast(value as bigint)") >= 0))
            .when(kind == "flag", found == "BOOLEAN")
            .when(kind == "style", (found == "STRING") & value.isin("d", "x"))
            .otherwise(found == "STRING")
        )
        errors = exploded.join(F.broadcast(rules), ["layout", "column"]).filter(~F.coalesce(ok, F.lit(False)))
        by_rule = errors.groupBy("row_id").agg(F.min(F.when(kind == "array", 1).otherwise(2)).alias("rank"))
        at_once = parsed.filter(F.col("_layout").isNull()).select(
            F.col(row_id).alias("row_id"), F.when(F.col("_v").isNull(), "syntax").otherwise("shape").alias("reason"))
        failures = at_once.unionByName(
            by_rule.select("row_id", F.when(F.col("rank") == 1, "shape").otherwise("value").alias("reason")))
        columns = dict.fromkeys(c for r in LINE_LAYOUTS.values() for c, _, k in r if not k.startswith("array"))
        typed = []
        for c in columns:
            x = F.lit(None).cast(TYPES.get(c, "string"))
            for layout, r in LINE_LAYOUTS.items():
                for name, path, k in r:
                    if name == c and not k.startswith("array"):
                        x = F.when(F.col("_layout") == layout,
                                   F.try_variant_get("_v", path, TYPES.get(c, "string"))).otherwise(x)
            typed.append(x.alias(c))
        typed_rows = parsed.filter(F.col("_layout").isNotNull()).select(
            F.col(row_id), F.col("_layout").alias("layout"), *typed)
        return Decoded(lines, row_id, failures, typed_rows)

    return _with_duplicate_keys(spark, build)


def _below(value: Column, limit: str) -> Column:
    """Whether a string of ASCII digits is at most ``limit``, whatever its length."""
    digits = F.regexp_replace(value, "^0+(?=.)", "")
    return value.rlike(r"\A[0-9]+\z") & ((F.length(digits) < len(limit))
                                        | ((F.length(digits) == len(limit)) & (digits <= limit)))


def decode_tuples(tuples: DataFrame, row_id: str = "tuple_id", layout: str = "layout",
                  record: str = "record") -> Decoded:
    spark = tuples.sparkSession
    items = tuples.withColumn("_items", F.split(F.col(record), ITEM_SEPARATOR, -1))
    size = F.lit(None).cast("int")
    for name, rule in TUPLE_LAYOUTS.items():
        size = F.when(F.col(layout) == name, len(rule)).otherwise(size)
    items = items.withColumn("_fits", F.coalesce(F.size("_items") == size, F.lit(False)))
    exploded = items.filter("_fits").select(
        F.col(row_id).alias("row_id"), F.col(layout).alias("layout"), F.posexplode("_items").alias("pos", "value"))
    rules = spark.createDataFrame(
        [(n, p, c, k) for n, r in TUPLE_LAYOUTS.items() for p, (c, k) in enumerate(r)],
        "layout string, pos int, column string, kind string")
    value, kind = F.col("value"), F.col("kind")
    ok = (
        F.when(kind == "i", _below(value, str(2**63 - 1)))
        .when(kind == "u", _below(value, str(2**32 - 1)))
        .when(kind == "b", value.isin("T", "F"))
        .otherwise(True)
    )
    errors = exploded.join(F.broadcast(rules), ["layout", "pos"]).filter(~ok)
    failures = errors.groupBy("row_id").agg(F.lit("value").alias("reason")).unionByName(
        items.filter("not _fits").select(F.col(row_id).alias("row_id"), F.lit("shape").alias("reason")))
    columns = dict.fromkeys(c for r in TUPLE_LAYOUTS.values() for c, _ in r)
    typed = []
    for c in columns:
        x = F.lit(None).cast(TYPES.get(c, "string"))
        for name, rule in TUPLE_LAYOUTS.items():
            for p, (col, k) in enumerate(rule):
                if col == c:
                    item = F.try_element_at("_items", F.lit(p + 1))
                    item = (item == "T") if k == "b" else F.regexp_replace(item, "^0+(?=.)", "").try_cast("bigint") if k in "iu" else item
                    x = F.when(F.col(layout) == name, item).otherwise(x)
        typed.append(x.alias(c))
    typed_rows = items.filter("_fits").select(F.col(row_id), F.col(layout).alias("layout"), *typed)
    return Decoded(tuples, row_id, failures, typed_rows)
