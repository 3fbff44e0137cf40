import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from chatlore import problem_queries as P
from chatlore.operators.changes import ChangeTable, current_state
from chatlore.operators.decode import TUPLE_LAYOUTS, decode_lines, decode_tuples
from chatlore.operators.orphans import OrphanTracker, references, track

FEED = "seq long, k string, value boolean, delivered_at timestamp, _file string, _pos string"


def at(n):
    return dt.datetime(2001, 1, 1) + dt.timedelta(hours=n)


def feed(spark, rows):
    return spark.createDataFrame([(s, k, v, at(t), "x", None) for s, k, v, t in rows], FEED)


ROWS = [(5, "a", True, 1), (3, "a", False, 2), (5, "a", True, 3), (40_000, "b", False, 1), (2, "b", True, 9),
        (7, None, True, 1), (None, "c", True, 1), (70_000, "c", True, 4), (8, "d", None, 4), (6, "d", True, 5)]


def test_current_state_out_of_order_repeated_and_null(spark):
    got = current_state(feed(spark, ROWS), ["k"], deleted=~F.col("value"), changes=F.col("value").isNotNull())
    assert sorted((r.k, r.seq, r.delivered_at) for r in got.collect()) == [
        ("a", 5, at(1)), ("c", 70_000, at(4)), ("d", 6, at(5))]
    assert got.columns == ["seq", "k", "value", "delivered_at", "_file", "_pos"]
    assert current_state(feed(spark, []), ["k"]).count() == 0


def test_change_table_in_batches_equals_one_pass(spark):
    whole = current_state(feed(spark, ROWS), ["k"], deleted=~F.col("value"), changes=F.col("value").isNotNull())
    t = ChangeTable(spark, ["k"], deleted=~F.col("value"), changes=F.col("value").isNotNull())
    rows = feed(spark, ROWS).drop("_file", "_pos")
    for n, part in enumerate((ROWS[7:], ROWS[:4], ROWS[4:7])):
        t.apply(feed(spark, part).drop("_file", "_pos"), n)
    t.apply(feed(spark, ROWS[:4]).drop("_file", "_pos"), 1)  # again
    assert rows.count() == len(ROWS)
    assert sorted((r.k, r.seq) for r in t.read().collect()) == sorted((r.k, r.seq) for r in whole.collect())


def test_change_table_opens_again_and_reads_touched_buckets_only(spark):
    def rows(part):
        return spark.createDataFrame([(s, k, v) for s, k, v in part], "seq long, k string, value string")
    many = [(n * 10**12, f"k{n}", f"v{n}") for n in range(200)]  # sparse order
    t = ChangeTable(spark, ["k"], deleted=F.col("value").isNull(), delivered_col=None, buckets=32)
    t.apply(rows(many), 0)
    assert len(t.state.manifest["tables"]["index"]) == 32
    again = ChangeTable(spark, ["k"], path=t.path, deleted=F.col("value").isNull(), delivered_col=None)
    again.apply(rows([(5, "k3", "old"), (10**15, "k3", "new"), (10**15 + 1, "k4", None)]), 1)
    again.apply(rows([(10**16, "k3", "never")]), 1)  # the same batch again
    assert 1 <= len(again.state.read_buckets["index"]) <= 2
    want = {k: v for _, k, v in many} | {"k3": "new"}
    want.pop("k4")
    for table in (again, ChangeTable(spark, ["k"], path=t.path, deleted=F.col("value").isNull(), delivered_col=None)):
        assert {r.k: r.value for r in table.read().collect()} == want
    assert spark.read.parquet(f"{t.path}/vectors").count() <= 4  # one bitmap a file that lost images
    late = ChangeTable(spark, ["k"], path=t.path)
    late.state.manifest["steps"].append("half")  # a step that never came to its manifest
    assert ChangeTable(spark, ["k"], path=t.path).state.manifest["steps"] == [0, 1]


def why(line):
    """Independent check of a log line."""
    def no(_):
        raise ValueError
    try:
        v = json.loads(line, parse_constant=no, parse_float=lambda x: ("float", x))
    except (ValueError, TypeError, RecursionError):
        return "syntax"

    def arr(x, n):
        if not isinstance(x, list) or len(x) != n:
            raise KeyError
        return x
    S, I, B, D = "s", "i", "b", "d"
    try:
        tag, p = arr(arr(v, 1)[0], 2)
        if tag == "z":
            p = arr(p, 6)
            inst = arr(p[5], 3)
            cells = [(arr(p[0], 1)[0], I), (p[1], I), (p[2], S), (p[3], S), (p[4], B), (inst[0], S), (inst[1], S), (inst[2], D)]
        elif tag == "m":
            kind, q = arr(arr(p, 1)[0], 2)
            n = {"rx": 4, "zgrev": 2, "ref": 3, "zmojis": 2}[kind if isinstance(kind, str) else ""]
            q = arr(q, n)
            if kind == "rx":
                cells = [(arr(q[0], 1)[0], I), (q[1], S), (q[2], S), (q[3], B)]
            elif kind == "zgrev":
                c = arr(q[1], 3)
                cells = [(arr(q[0], 1)[0], I), (c[0], S), (c[1], S), (c[2], D)]
            elif kind == "ref":
                cells = [(arr(q[0], 1)[0], I), (arr(q[1], 1)[0], I), (q[2], B)]
            else:
                cells = [(q[0], S), (q[1], S)]
        else:
            return "shape"
    except KeyError:
        return "shape"
    good = {S: lambda x: isinstance(x, str), B: lambda x: isinstance(x, bool), D: lambda x: x in ("d", "x") and isinstance(x, str),
            I: lambda x: type(x) is int and 0 <= x < 2**63}
    return None if all(good[k](x) for x, k in cells) else "value"


def why_tuple(layout, record):
    rule = TUPLE_LAYOUTS.get(layout)
    if rule is None or record is None or len(items := record.split("ÿ")) != len(rule):
        return "shape"
    good = {"i": lambda x: bool(re.fullmatch("[0-9]+", x)) and int(x) < 2**63, "u": lambda x: bool(re.fullmatch("[0-9]+", x)) and int(x) < 2**32,
            "b": lambda x: x in ("T", "F"), "s": lambda x: True}
    return None if all(good[k](x) for x, (_, k) in zip(items, rule)) else "value"


REF = '[["m",[["ref",[[1],[2],true]]]]]'
LINES = [REF, REF + " ", " \t" + REF + "\r\n", REF + "]", REF + "}", "1}]", "1]}", REF + REF, REF + ",1", REF[:-1], None, "", " ", "null", "NaN", "[NaN]",
         REF.replace("1", "01"), REF.replace("1", "1.0"), REF.replace("1", "1e0"), REF.replace("1", "-1"), REF.replace("1", str(2**63)),
         REF.replace("1", str(2**63 - 1)), REF.replace("1", "9" * 3000), REF.replace("1", "null"), REF.replace("[1]", "1"), REF.replace("[1]", "[]"),
         REF.replace("[1]", '{"a":1,"a":2}'), REF.replace("1", '{"a":1,"a":2}'), REF.replace("true", "null"), REF.replace("true", '"true"'),
         REF.replace("ref", "Ref"), REF.replace('"ref"', "3"), REF.replace('"m"', '"q"'), "﻿" + REF, REF.replace("1", "1 "), "[" * 300 + "]" * 300,
         '[["m",[["zmojis",["u","\\ud83d\\ude00\\n"]]]]]', '[["m",[["zmojis",["u\t","a"]]]]]', '[["m",[["zmojis",["u","' + "long " * 50_000 + '"]]]]]',
         '[["z",[[1],2,"s","g",false,["i","b","x"]]]]', '[["z",[[1],2,"s","g",false,["i","b","y"]]]]', '[["z",[[1],2,"s","g",0,["i","b","x"]]]]',
         '[["z",[[1],2,"s","g",false,["i","b"]]]]', '[["z",[[1],2.5,"s",[],false,["i","b","x"]]]]', "[1,2]//c", '[["z",null]]', "{}", "[[]]", '"z"']


def test_lines_against_brute_force(spark):
    df = spark.createDataFrame([(n, x, "extra") for n, x in enumerate(LINES)], "line_id long, line string, row_id string")
    d = decode_lines(df)
    got = {r.row_id: r.reason for r in d.failures.collect()}
    want = {n: w for n, x in enumerate(LINES) if (w := why(x))}
    assert got == want
    assert {r.line_id for r in d.valid().collect()} == set(range(len(LINES))) - set(want)
    assert decode_lines(df.limit(0)).failures.count() == 0


TUPLES = [("zmojis", "aÿb"), ("zmojis", "a"), ("zmojis", None), (None, "aÿb"), ("nope", "aÿb"), ("zmojis", "ÿ"), ("refers_to", "1ÿ2ÿT"), ("refers_to", "1ÿ2ÿt"),
          ("refers_to", "ÿ2ÿT"), ("refers_to", "١ÿ2ÿT"), ("refers_to", f"{2**63 - 1}ÿ{2**63}ÿT"), ("refers_to", "0" * 40 + "7ÿ2ÿF"), ("refers_to", "1ÿ2ÿT\n"), ("refers_to", "1\nÿ2ÿT"),
          ("revisions", f"1ÿiÿbÿ{2**32 - 1}"), ("revisions", f"1ÿiÿbÿ{2**32}"), ("revisions", "1ÿiÿbÿ-1"), ("reactions_by_id", "1ÿrÿcÿF"), ("reactions_by_id", "1ÿrÿcÿÿF")]


def test_tuples_against_brute_force(spark):
    d = decode_tuples(spark.createDataFrame([(n, *x) for n, x in enumerate(TUPLES)], "tuple_id long, layout string, record string"))
    assert {r.row_id: r.reason for r in d.failures.collect()} == {n: w for n, x in enumerate(TUPLES) if (w := why_tuple(*x))}
    row = d.valid().filter("tuple_id = 11").first()
    assert (row.zgram_id, row.refers_to, row.value) == (7, 2, False)


@pytest.mark.parametrize("table,check", [("raw_lines", lambda r: why(r.line)), ("raw_tuples", lambda r: why_tuple(r.layout, r.record))])
def test_decode_whole_table(spark, small, table, check):
    rows = spark.read.parquet(f"{small}/{table}.parquet").collect()
    want = {(table, r[0], w) for r in rows if (w := check(r))}
    assert {tuple(r) for r in P.p5_found(spark, small).filter(F.col("source_table") == table).collect()} == want


def orphan_rows(spark, refs):
    return references({"log": (spark.createDataFrame(
        [(s, p, dt.date(2001, 1, 1), None if t is None else at(t)) for s, p, t in refs],
        "seq long, ref long, log_date date, delivered_at timestamp"), ["ref"])})


@pytest.mark.parametrize("periods", [1, 2, 4])
def test_orphans_missing_late_deleted_reopened(spark, periods):
    refs = orphan_rows(spark, [(1, 10, 5), (1, 10, 1), (2, 11, 4), (3, 12, 4), (4, 13, 4), (5, None, 1), (6, 14, 30), (7, 15, 2), (8, 10, None)])
    parents = spark.createDataFrame([(10, at(3)), (11, at(4)), (11, at(20)), (13, at(9)), (14, at(1)), (15, at(1)), (None, at(1))],
                                    "parent_id long, first_seen timestamp")
    deleted = spark.createDataFrame([(14, at(2)), (15, at(25)), (99, None)], "parent_id long, deleted_at timestamp")
    got = {(r.seq, r.status) for r in track(refs, parents, deleted, periods).report().collect()}
    assert got == {(1, "late"), (3, "missing"), (4, "late"), (6, "deleted"), (7, "deleted")}


def test_orphan_state_is_incremental(spark):
    t = OrphanTracker(spark, buckets=32)
    parents = lambda rows: spark.createDataFrame([(i, at(h)) for i, h in rows], "parent_id long, first_seen timestamp")
    gone = lambda ids: spark.createDataFrame([(i,) for i in ids], "parent_id long")
    t.advance(orphan_rows(spark, [(n, n, 2) for n in range(300)]), parents([(n, 1) for n in range(150)]), gone([]), "jan")
    assert t._read("waiting").count() == 150 and t._read("held").count() == 150
    again = OrphanTracker(spark, t.path)
    again.advance(orphan_rows(spark, [(999, 7, 30)]), parents([(200, 30)]), gone([8]), "feb")
    assert all(1 <= len(again.state.read_buckets[n]) <= 3 for n in ("parents", "gone", "held", "opened") if again.state.read_buckets[n])
    again.advance(orphan_rows(spark, [(1, 5000, 1)]), parents([]), gone([9]), "feb")  # the same step again
    assert again._read("waiting").count() == 149
    status = {r.seq: r.status for r in again.report().collect()}
    assert status == {n: "missing" for n in range(150, 300)} | {200: "late", 8: "deleted"}
    counts = {(r.step, r.status): r.n_refs for r in again.snapshots().collect()}
    assert counts == {("jan", "missing"): 150, ("feb", "missing"): 149, ("feb", "late"): 1, ("feb", "deleted"): 1}
    for n in range(10):
        again.advance(orphan_rows(spark, [(1000 + n, 7, 40)]), parents([]), gone([]), n)
    assert max(len(s) for s in again.state.manifest["tables"]["held"].values()) <= 9


def test_orphans_empty(spark):
    t = OrphanTracker(spark)
    empty = orphan_rows(spark, [(1, 1, 1)]).limit(0)
    t.advance(empty, spark.createDataFrame([], "parent_id long, first_seen timestamp"), spark.createDataFrame([], "parent_id long"))
    assert t.report().count() == 0 and t.snapshot().count() == 0
