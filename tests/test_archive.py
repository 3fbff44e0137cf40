import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatlore.functions import text as T
from chatlore.operators import facts, paging, policy
from chatlore.operators.index import Index, current_version, publish
from chatlore.plans import postings_plan
from chatlore.plans.parser import parse
from chatlore.sources import logs
from chatlore.streaming import ingest
from chatlore.streaming.sessions import Sessions, Tables

DAY = dt.date(2001, 2, 5)


def zgrams(spark, rows):
    """rows: id, timesecs, sender, instance, body"""
    return spark.createDataFrame([(i, t, s, "", True, inst, b, "d", DAY, dt.datetime(2001, 2, 5)) for i, t, s, inst, b in rows],
                                 "zgram_id long, timesecs long, sender string, signature string, is_logged boolean, instance string, body string, render_style string, log_date date, delivered_at timestamp")


def revisions(spark, rows):
    return spark.createDataFrame(rows, "seq long, zgram_id long, instance string, body string, render_style string")


def test_current_text_takes_the_last_revision(spark):
    z = zgrams(spark, [(1, 1, "a", "i", "one"), (1, 1, "a", "i", "one"), (2, 2, "a", "i", "two"), (3, 3, "b", "i", "three")])
    r = revisions(spark, [(9, 1, "i", "uno", "d"), (5, 1, "i", "eins", "d"), (7, 2, "i", "dos", "d"), (8, 2, None, None, None), (4, None, "i", "x", "d"), (3, 99, "i", "x", "d")])
    assert {x.zgram_id: x.body for x in facts.current_text(z, r).collect()} == {1: "uno", 2: "two", 3: "three"}
    assert facts.current_text(z.limit(0), r).count() == 0


def test_karma_running_in_blocks(spark):
    z = zgrams(spark, [(1, 1, "a", "i", "x++"), (49, 1, "a", "i", "nothing"), (50, 1, "a", "i", "x++ x++ y--"), (70, 1, "a", "i", None), (71, 1, "a", "i", "x-- C++")])
    got = {(r.key, r.zgram_id): r.karma for r in facts.karma_running(facts.karma_deltas(z), block_ids=10).collect()}
    assert got == {("x", 1): 1, ("x", 50): 3, ("y", 50): -1, ("x", 71): 2}
    assert {r.key: r.karma for r in facts.karma_after(facts.karma_deltas(z), 50).collect()} == {"x": 3, "y": -1}


def test_reaction_count_of_unknown_is_zero(spark):
    log = spark.createDataFrame([(1, 1, "up", "a", True), (2, 1, "up", "a", False), (3, 1, "up", "b", True), (4, 2, "up", "a", None), (5, None, "up", "a", True)],
                                "seq long, zgram_id long, reaction string, creator string, value boolean")
    assert facts.reaction_count(log, "up", 1) == 1 and facts.reaction_count(log, "up", 2) == 0


def test_pages_from_the_middle(spark):
    hits = spark.createDataFrame([(n, n * 10) for n in (0, 1, 3, 10, 11, 12, 13, 14, 15, 20, 22)], "zgram_id long, timesecs long")
    c = paging.start(hits, "zgram", 13)
    seen = []
    for side in ("back", "front", "back", "front", "back"):
        ids = [r.zgram_id for r in paging.page(hits, c, side, 3).collect()]
        seen += ids
        c = paging.advance(c, side, ids)
    assert seen == [13, 14, 15, 12, 11, 10, 20, 22, 3, 1, 0]
    assert (c.low, c.high) == (0, 23)
    est = {r.side: (r["count"], r.exact) for r in paging.estimates(hits, paging.start(hits, "timestamp", 105), 4).collect()}
    assert est == {"back": (4, False), "front": (4, False)}
    assert paging.start(hits).front == 23 and paging.start(hits, "timestamp", 999).back == 23
    assert facts.end_id(hits.limit(0)) == 0 and paging.specific(hits, []).count() == 0


def test_retention_and_filters(spark):
    rows = spark.createDataFrame([(1, True, dt.date(2000, 1, 1), "a", "x"), (2, False, dt.date(2001, 1, 1), "a", "graffiti"), (3, False, dt.date(2001, 1, 20), None, "graffiti.y"), (4, True, dt.date(2001, 1, 20), "b", None)],
                                 "zgram_id long, is_logged boolean, log_date date, sender string, instance string")
    assert [r.zgram_id for r in policy.retained(rows, F.lit(dt.date(2001, 1, 25))).orderBy("zgram_id").collect()] == [1, 3, 4]
    got = {r.zgram_id: (r.weakly_hidden, r.strongly_hidden) for r in policy.with_filters(rows, [{"sender": "a"}, {"instance_prefix": "graffiti", "strong": True}]).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (True, True), 4: (False, False)}
    assert {r.weakly_hidden for r in policy.with_filters(rows, [{}]).collect()} == {True}
    proposals = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b")], "user_id string, version long, filters string")
    assert policy.latest_filters(proposals).first().filters == "c"


def test_sanitize(spark):
    z = zgrams(spark, [(1, 1, "ann", "i", "x"), (2, 1, "bob", "i", "x")])
    records = spark.createDataFrame([("rx", 1, "ann"), ("rx", 1, "bob"), ("zgrev", 1, None), ("zgrev", 2, None), ("ref", 9, None), ("zmojis", None, None)], "kind string, zgram_id long, creator string")
    got = [(r.kind, r.zgram_id) for r in policy.sanitize(records, facts.messages(z), F.lit("ann")).collect()]
    assert sorted(got, key=repr) == [("rx", 1), ("zgrev", 1), ("zmojis", None)]


def test_logs_round_trip_through_a_directory(spark, tmp_path):
    texts = ['he said "hi"\n\ttab \\ back', "", "🙀 é", "a,b]["]
    z = zgrams(spark, [(n, n, "ann", "ops", t) for n, t in enumerate(texts)])
    rx = spark.createDataFrame([(1, 3, "👍", "ann", True)], "seq long, zgram_id long, reaction string, creator string, value boolean")
    rev = revisions(spark, [(2, 3, "ops", "new", "x")])
    ref = spark.createDataFrame([(3, 3, 1, False)], "seq long, zgram_id long, refers_to long, value boolean")
    zm = spark.createDataFrame([(4, "ann", "a, b")], "seq long, user_id string, zmojis string")
    lines = [r.line for r in logs.encode({"zgrams": z, "reactions_log": rx, "revisions_log": rev, "refers_log": ref, "zmojis_log": zm}).collect()]
    path = tmp_path / logs.plaintext_path("20010205", True)
    path.parent.mkdir(parents=True)
    path.write_text("\n".join(lines) + "\n")
    (tmp_path / "logged/2001/02/20010206.unlogged").write_text("wrong place\n")
    (tmp_path / "logged/2001/02/20011340.logged").write_text("no day\n")
    root = f"file://{tmp_path}"
    rows = logs.read(spark, root)
    assert rows.count() == len(lines) and logs.read(spark, root, since="2001-02-06").count() == 0
    t = logs.load(rows)
    assert {r.body for r in t["zgrams"].collect()} == set(texts)
    assert t["reactions_log"].select("zgram_id", "reaction", "value").first() == (3, "👍", True)
    assert t["refers_log"].first().value is False and t["zmojis_log"].first().zmojis == "a, b" and t["revisions_log"].first().body == "new"
    bad = spark.createDataFrame([(1, DAY, "[1")], "line_id long, log_date date, line string")
    with pytest.raises(ValueError):
        logs.load(bad)
    assert logs.load(bad, fail_fast=False)["zgrams"].count() == 0


def test_append_read_clip_compact_and_next_position(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    day2 = dt.date(2001, 2, 6)
    assert logs.next_position(spark, root, "20010205", True) == ("20010205", 0)
    for n in range(2):
        lines = spark.createDataFrame([(True, DAY, f"a{n}", 0), (True, DAY, f"bb{n}", 1), (False, DAY, f"c{n}", 0), (True, day2, f"é{n}", 2)], "is_logged boolean, log_date date, line string, nth int")
        logs.append(lines, root)
    rows = logs.read(spark, root).orderBy("line_id").collect()
    assert [(r.log_date, r.is_logged_file, r.line_no, r.begin, r.line) for r in rows] == [
        (DAY, False, 1, 0, "c0"), (DAY, False, 2, 3, "c1"), (DAY, True, 1, 0, "a0"), (DAY, True, 2, 3, "bb0"), (DAY, True, 3, 7, "a1"), (DAY, True, 4, 10, "bb1"),
        (day2, True, 1, 0, "é0"), (day2, True, 2, 4, "é1")]
    got = logs.read(spark, root, logged=(("20010205", 3), ("20010206", 4)), unlogged=(("20010205", 0), ("20010205", 3)))
    assert sorted(r.line for r in got.collect()) == ["a1", "bb0", "bb1", "c0", "é0"]
    assert logs.next_position(spark, root, "20010205", True) == ("20010206", 8) and logs.next_position(spark, root, "20010207", True) == ("20010207", 0)
    assert logs.next_position(spark, root, "20010205", False) == ("20010205", 6)
    logs.compact(spark, root, "20010205", True)
    assert (tmp_path / "log/logged/2001/02/20010205.logged").read_text() == "a0\nbb0\na1\nbb1\n"
    assert [(r.line_no, r.begin, r.line) for r in logs.read(spark, root).orderBy("line_id").collect()] == [(r.line_no, r.begin, r.line) for r in rows]
    logs.append(spark.createDataFrame([(True, DAY, "z")], "is_logged boolean, log_date date, line string"), root)
    assert [r.line for r in logs.read(spark, root).filter("is_logged_file").orderBy("line_id").collect()][:5] == ["a0", "bb0", "a1", "bb1", "z"]


def test_wrong_kind(spark):
    lines = spark.createDataFrame([(1, True), (2, False)], "line_id long, is_logged_file boolean")
    z = spark.createDataFrame([(1, 10, False), (2, 11, False)], "seq long, zgram_id long, is_logged boolean")
    assert [r.zgram_id for r in logs.wrong_kind(lines, z).collect()] == [10]


def test_kinds_are_merged(spark):
    one, two = (spark.createDataFrame([(i, "x") for i in ids], "zgram_id long, body string") for ids in ((1, 3), (2, 3)))
    assert sorted(r.zgram_id for r in facts.merge_kinds(one, two.filter("zgram_id = 2")).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="logged and unlogged: 3"):
        facts.merge_kinds(one, two).collect()


def test_strings_are_frozen(spark):
    rows = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "é", "a")], "n int, s string, t string")
    codes = facts.string_codes(facts.dictionary([(rows, "s"), (rows, "t")]))
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "b": 1, "x": 2, "é": 3}
    assert sorted(map(tuple, facts.freeze(rows, ["s", "t"], codes).select("n", "s", "t").collect())) == [(1, 1, 2), (2, 0, None), (3, 3, 0)]
    with pytest.raises(Exception, match="not in the pool: é"):
        facts.freeze(rows, ["s"], codes.filter("value <> 'é'")).collect()
    assert sorted((r.level, tuple(r.group), r.n) for r in facts.nested_sizes(rows, ["s", "t"]).collect()) == [(0, (), 3), (1, ("a",), 1), (1, ("b",), 1), (1, ("é",), 1)]


def live(spark, tmp_path):
    z = zgrams(spark, [(n, n, "ann" if n % 2 else "bob", "ops", f"tea {n} k++") for n in range(30)])
    rx = spark.createDataFrame([(1, 20, "up", "ann", True), (2, 3, "up", "bob", True)], "seq long, zgram_id long, reaction string, creator string, value boolean")
    rev = revisions(spark, [(3, 21, "ops", "tea again", "d")])
    ref = spark.createDataFrame([(4, 21, 20, True)], "seq long, zgram_id long, refers_to long, value boolean")
    zm = spark.createDataFrame([(5, "ann", "a,b")], "seq long, user_id string, zmojis string")
    return Sessions(spark, f"file://{tmp_path}", Tables(z, rx, rev, ref, zm))


def test_sessions(spark, tmp_path):
    s = live(spark, tmp_path)
    now = dt.datetime(2001, 2, 6)
    first = s.maintain(now)
    assert first and s.maintain(now + dt.timedelta(seconds=599)) is None
    ok, est, palette = s.subscribe("a", "ann", "tea", "zgram", 15)
    assert ok and {r.side: r["count"] for r in est.collect()} == {"back": 15, "front": 15} and palette.first().zmojis == "a,b"
    assert s.subscribe("b", "bob", '"open')[0] is False and "b" not in s.subscriptions
    seen = []
    for side in ("back", "front", "back"):
        page = s.get_more("a", side, 4)
        seen += page.ids
    assert seen == [15, 16, 17, 18, 14, 13, 12, 11, 19, 20, 21, 22]
    assert sorted((r.kind, r.zgram_id) for r in page.metadata.collect()) == [("ref", 21), ("rx", 20), ("zgrev", 21)]
    assert {(r.key, r.zgram_id): r.karma for r in page.karma.collect()} == {("k", 19): 20, ("k", 20): 21, ("k", 22): 22}
    assert {r.side: r["count"] for r in page.estimates.collect()} == {"back": 7, "front": 11}
    assert set(s.estimates_changed()) == {"a"} and s.estimates_changed() == {}

    records = spark.createDataFrame([("rx", 10, 12, "ann", None), ("rx", 11, 12, "bob", None), ("zgrev", 12, 20, None, None), ("zgrev", 13, 13, None, None), ("rx", 14, 2, "ann", None), ("zmojis", 15, None, None, "ann")],
                                    "kind string, seq long, zgram_id long, creator string, user_id string")
    kept = []

    def append(allowed):
        kept.extend(r.seq for r in allowed.collect())
        return s.tables
    told = s.post_metadata("a", records, append)
    assert sorted(kept) == [10, 13, 14, 15] and sorted((r.sub_id, r.seq) for r in told.collect()) == [("a", 10), ("a", 13), ("a", 15)]
    assert s.maintain(now + dt.timedelta(seconds=600)) not in (None, first)
    assert (s.subscriptions["a"].cursor.back, s.subscriptions["a"].cursor.front) == (23, 11)
    s.unsubscribe("a")
    assert not s.subscriptions


def test_no_text_is_moved_by_a_search(spark, small):
    from chatlore.archive_queries import QUERIES

    QUERIES["word_search"](spark, small).count()
    plan = QUERIES["word_search"](spark, small)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanges and not [line for line in exchanges if "body" in line or "instance" in line]
    under = plan.split("Exchange")
    assert all("tok_body" not in part.split("\n")[0] for part in under[1:])


def test_out_of_order_ids(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, 6), (4, 2)], "seq long, zgram_id long").withColumns({"log_date": F.lit(DAY), "is_logged": F.lit(True)})
    assert sorted(r.seq for r in logs.out_of_order(rows).collect()) == [3, 4]


def test_index_build_publish_and_open(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert current_version(spark, root) is None
    z = facts.messages(zgrams(spark, [(1, 1, "a", "i", "tea cup"), (2, 1, "a", "i", "cup tea")]))
    for v in ("v1", "v2"):
        Index.build(z, f"{root}/{v}", files=2)
        publish(spark, root, v)
    assert current_version(spark, root) == "v2"
    ix = Index.open(spark, f"{root}/v2")
    assert [r.zgram_id for r in postings_plan.ids(parse('"tea cup"'), ix).collect()] == [1]
    newer = Index.of(facts.messages(zgrams(spark, [(2, 1, "a", "i", "tea cup"), (3, 1, "a", "i", "pot")])))
    both = ix.with_delta(newer)
    assert sorted(r.zgram_id for r in postings_plan.ids(parse('"tea cup" or pot'), both).collect()) == [1, 2, 3]


def test_stream_is_idempotent_and_posts(spark, tmp_path):
    z = zgrams(spark, [(1, 1, "a", "i", "x++"), (2, 1, "a", "i", "x--")])
    z.write.parquet(f"{tmp_path}/in")
    sink = ingest.append_batches(f"file://{tmp_path}/out")
    ingest.run(ingest.source(spark, f"file://{tmp_path}/in", z.schema), sink, f"file://{tmp_path}/check")
    sink(z, 0)  # the batch again
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    new = spark.createDataFrame([(1, "a", "", " graffiti.x ", "b", "d"), (0, "a", "", "ops", "b", "d")], "nth int, sender string, signature string, instance string, body string, render_style string")
    got = [(r.zgram_id, r.instance, r.is_logged) for r in ingest.post(new, 72, F.lit(5)).orderBy("zgram_id").collect()]
    assert got == [(72, "ops", True), (73, "graffiti.x", False)]


def test_notifications(spark):
    events = spark.createDataFrame([(1, 4095, "z"), (2, 4096, "z"), (3, 9000, "u1"), (4, None, "u2")], "seq long, zgram_id long, user_id string")
    subs = spark.createDataFrame([("s1", "u1", 4000, 4096), ("s2", "u2", 4096, 9001), ("s3", "x", 5, 5)], "sub_id string, user_id string, lo long, hi long")
    assert sorted((r.sub_id, r.seq) for r in ingest.notify_metadata(events, subs).collect()) == [("s1", 1), ("s1", 3), ("s2", 2), ("s2", 3), ("s2", 4)]
    w = ingest.EstimateWatcher()
    est = spark.createDataFrame([("back", 1, True)], "side string, count long, exact boolean")
    assert w.changed("s", est) and not w.changed("s", est)


def test_small_functions(spark):
    df = spark.createDataFrame([("graffiti", DAY, " a,b "), ("graffitix", DAY, ""), (None, DAY, None)], "i string, d date, z string")
    assert [r[0] for r in df.select(T.is_logged(F.col("i"))).collect()] == [False, True, None]
    assert df.select(T.day_key(F.col("d"), F.lit(True))).first()[0] == 200102051
    assert [r[0] for r in df.select(T.zmoji_list(F.col("z"))).collect()] == [["a", "b"], [], None]
    keys = spark.createDataFrame([(200102051,), (200113010,), (196902050,), (200102052,), (200102300,)], "k long")
    assert [str(r[0]) for r in keys.select(T.day_of_key(F.col("k"))[0]).collect()] == ["2001-02-05", "None", "None", "None", "None"]
    assert spark.range(1).select(T.linkify(F.lit("see https://a.example/b now"))).first()[0] == 'see <a href="https://a.example/b">https://a.example/b</a> now'


def test_whole_archive_is_covered(spark, small):
    """Queries with a fixed range of ids have one for all ids beside them."""
    from chatlore.archive_queries import QUERIES

    deltas = {(r.key, r.zgram_id): r.delta for r in QUERIES["karma_delta"](spark, small).collect()}
    want = {}
    for (key, _), n in deltas.items():
        want[key] = want.get(key, 0) + n
    assert {r.key: r.karma for r in QUERIES["karma_after_end"](spark, small).collect()} == want
    assert {r.zgram_id % 100 for r in QUERIES["metadata_for_all"](spark, small).collect()} > {0}
    assert {r.zgram_id for r in QUERIES["notify_karma_all"](spark, small).collect()} <= {z for _, z in deltas}
