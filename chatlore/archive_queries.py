"""Queries of the message archive and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.functions import text as T
from chatlore.operators import facts, paging, policy
from chatlore.operators.decode import decode_lines
from chatlore.operators.index import Index, current_version, postings, publish, vocabulary, with_tokens
from chatlore.plans import postings_plan, row_plan
from chatlore.plans.parser import by_instance, by_reaction, by_sender, check_syntax, parse
from chatlore.shared import shared_dir, table
from chatlore.sources import logs
from chatlore.streaming import ingest
from chatlore.streaming.sessions import Sessions, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


# -- what the queries start from -------------------------------------------------------------------
def current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_text(table(spark, d, "zgrams"), table(spark, d, "revisions_log"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return with_tokens(current(spark, d))


def reactions(spark: SparkSession, d: str) -> DataFrame:
    return facts.reaction_counts(table(spark, d, "reactions_log"))


_PUBLISHED: dict[tuple[str, str], str] = {}


def published(spark: SparkSession, d: str) -> Index:
    """The published index of the tables in a folder; built by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, d)
    root = _PUBLISHED.get(key)
    if root is None or current_version(spark, root) is None:
        root = _PUBLISHED[key] = shared_dir(spark, "index")
        Index.build(current(spark, d), f"{root}/v1", reactions(spark, d))
        publish(spark, root, "v1")
    return Index.open(spark, f"{root}/{current_version(spark, root)}")


_W = T.TOKEN_RE2.replace("'", "''")
BASE = f"""
z0 AS (SELECT zgram_id, any_value(timesecs) AS timesecs, any_value(sender) AS sender, any_value(signature) AS signature, any_value(is_logged) AS is_logged,
   any_value(instance) AS instance, any_value(body) AS body, any_value(log_date) AS log_date FROM zgrams GROUP BY zgram_id),
rev AS (SELECT * FROM revisions_log WHERE zgram_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY zgram_id ORDER BY seq DESC, delivered_at) = 1),
z AS (SELECT z0.zgram_id, timesecs, sender, signature, is_logged, z0.log_date,
   CASE WHEN r.zgram_id IS NULL THEN z0.instance ELSE r.instance END AS instance, CASE WHEN r.zgram_id IS NULL THEN z0.body ELSE r.body END AS body
   FROM z0 LEFT JOIN (SELECT * FROM rev WHERE instance IS NOT NULL OR body IS NOT NULL OR render_style IS NOT NULL) r ON r.zgram_id = z0.zgram_id),
t AS (SELECT zgram_id, timesecs, sender AS who, {', '.join(f"coalesce(regexp_extract_all({f}, '{_W}'), []) AS {f}" for f in ("sender", "signature", "instance", "body"))} FROM z),
rx AS (SELECT * FROM reactions_log WHERE zgram_id IS NOT NULL AND reaction IS NOT NULL AND creator IS NOT NULL AND value IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY zgram_id, reaction, creator ORDER BY seq DESC, delivered_at) = 1),
rxc AS (SELECT reaction, zgram_id, count(*) AS n FROM rx WHERE value GROUP BY ALL)
"""


_K = T.KARMA_RE2.replace("'", "''")
_PP = (f"k AS (SELECT zgram_id, unnest(regexp_extract_all(body, '{_K}', 1)) AS key, unnest(regexp_extract_all(body, '{_K}', 2)) AS op FROM z), "
       "pp AS (SELECT key, zgram_id, sum(CASE op WHEN '++' THEN 1 WHEN '--' THEN -1 ELSE 0 END)::BIGINT AS delta FROM k WHERE key NOT IN ('c', 'C') GROUP BY ALL)")


def _re(glob: str) -> str:
    return T.glob_regex(glob).replace("'", "''")


def has(glob: str, *fields: str) -> str:
    return "(" + " OR ".join(f"len(list_filter({f}, lambda x: regexp_matches(x, '{_re(glob)}'))) > 0" for f in fields or ("instance", "body")) + ")"


def at(f: str, place: str, glob: str) -> str:
    return f"(len({f}) > 0 AND regexp_matches({f}[{place}], '{_re(glob)}'))"


def near(margin: int, globs: list[str], *fields: str) -> str:
    def one(f: str, k: int, i: str) -> str:
        if k == len(globs):
            return "true"
        return f"len(list_filter(range(1, {margin + 1}), lambda d{k}: {i} + d{k} < len({f}) AND regexp_matches({f}[{i} + d{k} + 1], '{_re(globs[k])}') AND {one(f, k + 1, f'({i} + d{k})')})) > 0"
    return "(" + " OR ".join(
        f"len(list_filter(range(len({f})), lambda i: regexp_matches({f}[i + 1], '{_re(globs[0])}') AND {one(f, 1, 'i')})) > 0" for f in fields or ("instance", "body")) + ")"


def _search(name: str, query: str, where: str, postings_too: bool = False) -> None:
    def by_rows(spark: SparkSession, d: str) -> DataFrame:
        plan = parse(query)
        return row_plan.search_archive(plan, table(spark, d, "zgrams"), table(spark, d, "revisions_log"), reactions(spark, d)).select("zgram_id")

    def by_postings(spark: SparkSession, d: str) -> DataFrame:
        return postings_plan.ids(parse(query), published(spark, d))

    QUERIES[name] = by_rows
    ORACLE[name] = f"WITH {BASE} SELECT zgram_id FROM t WHERE {where}"
    if postings_too:
        QUERIES[f"postings_{name}"] = by_postings
        ORACLE[f"postings_{name}"] = ORACLE[name]


RELAY, PARSER, BATCH = has("relay"), has("parser"), has("batch")
_search("word_search", "relay", RELAY, True)
_search("word_search_exact_case", "The", has("The"))
_search("glob_qmark", "pars?r", has("pars?r"))
_search("glob_star", "pag*", has("pag*"), True)
_search("glob_both_ends", "*box*", has("*box*"))
_search("fuzzy_word", "the", has("the"))
_search("escaped_word", r"C\*", near(1, ["C", r"\*"]))
_search("anchored_left", "body:^anyone", at("body", "1", "anyone"), True)
_search("anchored_right", "signature:index$", at("signature", "-1", "index"))
_search("anchored_both", "body:^agreed$", f"len(body) = 1 AND {at('body', '1', 'agreed')}")
_search("one_word_instance", "instance:^*$", "len(instance) = 1")
_search("phrase2", '"morning backlog"', near(1, ["morning", "backlog"]), True)
_search("phrase3", '"the paging cursor"', near(1, ["the", "paging", "cursor"]))
_search("phrase_punctuation", "C++", near(1, ["C", "+", "+"]))
_search("phrase_anchored", 'body:^"my guess"', f"({at('body', '1', 'my')} AND len(body) > 1 AND regexp_matches(body[2], '{_re('guess')}'))")
_search("near3", "~relay whole~", near(3, ["relay", "whole"]), True)
_search("near3_three_words", "~track handful replies~", near(3, ["track", "handful", "replies"]))
_search("bool_and", "relay and batch", f"{RELAY} AND {BATCH}", True)
_search("bool_implied_and", "relay batch", f"{RELAY} AND {BATCH}")
_search("bool_or", "relay or parser", f"{RELAY} OR {PARSER}", True)
_search("bool_not", "not relay", f"NOT {RELAY}", True)
_search("bool_mixed_precedence", "relay or parser and not batch", f"{RELAY} OR ({PARSER} AND NOT {BATCH})", True)
_search("bool_parentheses", "(relay or parser) batch", f"({RELAY} OR {PARSER}) AND {BATCH}")
_search("field_scope", "signature:index", has("index", "signature"))
_search("field_scope_multi", "sender,signature:the", has("the", "sender", "signature"))
_search("empty_field", 'body:""', "len(body) = 0")
_search("populated_field", 'not signature:""', "len(signature) > 0")
_search("match_all", "", "true")
_search("zgramid_lookup", "zgramid(68)", "zgram_id = 68")
_search("has_reaction", by_reaction("👍"), "zgram_id IN (SELECT zgram_id FROM rxc WHERE reaction = '👍')", True)
_search("has_reaction_and_word", by_reaction("🔥") + " relay", f"zgram_id IN (SELECT zgram_id FROM rxc WHERE reaction = '🔥') AND {RELAY}")
_search("canned_instance", by_instance("help.relay"), f"({at('instance', '1', 'help')} AND len(instance) > 2 AND instance[2] = '.' AND regexp_matches(instance[3], '{_re('relay')}'))")
_search("canned_sender", by_sender("kifafi"), f"len(sender) = 1 AND {at('sender', '1', 'kifafi')}")


def _query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


# -- tokens, index ---------------------------------------------------------------------------------
@_query(f"WITH {BASE} SELECT zgram_id, len(sender)::BIGINT AS n_sender, len(signature)::BIGINT AS n_signature, len(instance)::BIGINT AS n_instance, len(body)::BIGINT AS n_body FROM t")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("zgram_id", *[F.size(f"tok_{f}").cast("long").alias(f"n_{f}") for f in ("sender", "signature", "instance", "body")])


@_query(f"WITH {BASE}, p AS (SELECT zgram_id, f, unnest(w) AS token, unnest(range(len(w))) AS pos, len(w) AS field_len FROM (SELECT zgram_id, 'sender' AS f, sender AS w FROM t "
        "UNION ALL SELECT zgram_id, 'signature', signature FROM t UNION ALL SELECT zgram_id, 'instance', instance FROM t UNION ALL SELECT zgram_id, 'body', body FROM t)) "
        "SELECT token, zgram_id, f AS field, pos::BIGINT AS pos, field_len::BIGINT AS field_len FROM p")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    p = postings(docs(spark, d))
    return p.select("token", "zgram_id", "field", F.col("pos").cast("long").alias("pos"), F.col("field_len").cast("long").alias("field_len"))


@_query(f"WITH {BASE}, p AS (SELECT zgram_id, unnest(list_concat(list_concat(sender, signature), list_concat(instance, body))) AS token FROM t) "
        "SELECT token, count(*) AS n_words, count(DISTINCT zgram_id) AS n_zgrams FROM p GROUP BY token")
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary(postings(docs(spark, d)))


@_query(f"WITH {BASE} SELECT zgram_id FROM t WHERE {RELAY} OR {near(1, ['morning', 'backlog'])}")
def index_published(spark: SparkSession, d: str) -> DataFrame:
    """Build an index on disk, publish it, open the published one and search it."""
    root = shared_dir(spark, "index")
    Index.build(current(spark, d), f"{root}/v1", reactions(spark, d))
    publish(spark, root, "v1")
    ix = Index.open(spark, f"{root}/{current_version(spark, root)}")
    return postings_plan.ids(parse('relay or "morning backlog"'), ix)


@_query(f"WITH {BASE} SELECT zgram_id FROM t WHERE {BATCH}")
def index_base_and_delta(spark: SparkSession, d: str) -> DataFrame:
    """A base index of the older half joined with one of the newer half."""
    now = current(spark, d)
    half = facts.end_id(now) // 2
    base, delta = Index.of(now.filter(F.col("zgram_id") < half)), Index.of(now.filter(F.col("zgram_id") >= half))
    return postings_plan.ids(parse("batch"), base.with_delta(delta))


# -- facts -----------------------------------------------------------------------------------------
@_query(f"WITH {BASE} SELECT zgram_id, reaction, creator FROM rx WHERE value")
def reactions_current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_reactions(table(spark, d, "reactions_log")).select("zgram_id", "reaction", "creator")


@_query(f"WITH {BASE} SELECT reaction, zgram_id, n FROM rxc")
def reaction_counts(spark: SparkSession, d: str) -> DataFrame:
    return reactions(spark, d)


@_query(f"WITH {BASE} SELECT zgram_id, instance, body FROM z")
def revision_latest(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select("zgram_id", "instance", "body")


@_query("SELECT zgram_id, row_number() OVER (PARTITION BY zgram_id ORDER BY seq) AS nth, seq, body FROM (SELECT DISTINCT zgram_id, seq, body FROM revisions_log WHERE zgram_id IS NOT NULL)")
def revision_history(spark: SparkSession, d: str) -> DataFrame:
    return facts.revision_history(table(spark, d, "revisions_log"))


_REFS = ("ref AS (SELECT * FROM refers_log WHERE zgram_id IS NOT NULL AND refers_to IS NOT NULL AND value IS NOT NULL "
         "QUALIFY row_number() OVER (PARTITION BY zgram_id, refers_to ORDER BY seq DESC, delivered_at) = 1)")


@_query(f"WITH {_REFS} SELECT zgram_id, refers_to FROM ref WHERE value")
def refers_current(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_refers(table(spark, d, "refers_log")).select("zgram_id", "refers_to")


@_query(f"WITH {BASE}, {_REFS} SELECT ref.zgram_id, refers_to, z.sender AS parent_sender, substring(z.body, 1, 60) AS parent_body FROM ref LEFT JOIN z ON z.zgram_id = refers_to WHERE value")
def reply_parent(spark: SparkSession, d: str) -> DataFrame:
    return facts.reply_parents(table(spark, d, "refers_log"), current(spark, d))


@_query("SELECT user_id, zmojis FROM (SELECT * FROM zmojis_log WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, delivered_at) = 1) WHERE zmojis IS NOT NULL")
def zmojis_latest(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_zmojis(table(spark, d, "zmojis_log")).select("user_id", "zmojis")


@_query(f"WITH {BASE}, {_REFS} SELECT 'rx' AS kind, zgram_id, count(*) AS n FROM rx WHERE value AND zgram_id % 100 = 0 GROUP BY ALL UNION ALL "
        "SELECT 'zgrev', zgram_id, count(DISTINCT seq) FROM revisions_log WHERE zgram_id % 100 = 0 GROUP BY ALL UNION ALL "
        "SELECT 'ref', zgram_id, count(*) FROM ref WHERE value AND zgram_id % 100 = 0 GROUP BY ALL")
def metadata_for_ids(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a stated set of messages: those whose id is divisible by 100."""
    ids = facts.messages(table(spark, d, "zgrams")).select("zgram_id")
    refs = [table(spark, d, t) for t in ("reactions_log", "revisions_log", "refers_log")]
    wanted = refs[0].select("zgram_id").unionByName(refs[1].select("zgram_id")).unionByName(refs[2].select("zgram_id")).unionByName(ids)
    wanted = wanted.filter("zgram_id % 100 = 0").distinct()
    return facts.metadata_for(wanted, *refs).groupBy("kind", "zgram_id").agg(F.count("*").alias("n"))


@_query(f"WITH {BASE}, {_REFS} SELECT 'rx' AS kind, zgram_id, count(*) AS n FROM rx WHERE value AND zgram_id IS NOT NULL GROUP BY ALL UNION ALL "
        "SELECT 'zgrev', zgram_id, count(DISTINCT seq) FROM revisions_log WHERE zgram_id IS NOT NULL GROUP BY ALL UNION ALL "
        "SELECT 'ref', zgram_id, count(*) FROM ref WHERE value GROUP BY ALL")
def metadata_for_all(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of all messages."""
    refs = [table(spark, d, t) for t in ("reactions_log", "revisions_log", "refers_log")]
    wanted = facts.messages(table(spark, d, "zgrams")).select("zgram_id")
    for r in refs:
        wanted = wanted.unionByName(r.select("zgram_id"))
    wanted = wanted.filter("zgram_id is not null").distinct()
    return facts.metadata_for(wanted, *refs).groupBy("kind", "zgram_id").agg(F.count("*").alias("n"))


@_query(f"WITH {BASE}, {_PP} SELECT key, zgram_id, delta FROM pp")
def karma_delta(spark: SparkSession, d: str) -> DataFrame:
    return facts.karma_deltas(current(spark, d))


@_query(f"WITH {BASE}, {_PP} SELECT key, zgram_id, delta, sum(delta) OVER (PARTITION BY key ORDER BY zgram_id)::BIGINT AS karma FROM pp")
def karma_running(spark: SparkSession, d: str) -> DataFrame:
    return facts.karma_running(facts.karma_deltas(current(spark, d)), block_ids=256)


@_query(f"WITH {BASE}, {_PP} SELECT key, sum(delta)::BIGINT AS karma FROM pp WHERE zgram_id <= 5000 GROUP BY key")
def karma_after(spark: SparkSession, d: str) -> DataFrame:
    return facts.karma_after(facts.karma_deltas(current(spark, d)), 5000)


@_query(f"WITH {BASE}, {_PP} SELECT key, sum(delta)::BIGINT AS karma FROM pp GROUP BY key")
def karma_after_end(spark: SparkSession, d: str) -> DataFrame:
    """Karma of every key after the last message."""
    z = current(spark, d)
    return facts.karma_after(facts.karma_deltas(z), facts.end_id(z))


@_query(f"WITH {BASE}, {_PP} SELECT zgram_id, count(*) AS n_keys, string_agg(key, ' ' ORDER BY key) AS keys FROM pp GROUP BY zgram_id")
def karma_keys(spark: SparkSession, d: str) -> DataFrame:
    deltas = facts.karma_deltas(current(spark, d))
    return deltas.groupBy("zgram_id").agg(F.count("*").alias("n_keys"), F.array_join(F.array_sort(F.collect_set("key")), " ").alias("keys"))


@_query(f"""WITH h AS (SELECT DISTINCT zgram_id, seq, body FROM revisions_log WHERE zgram_id IS NOT NULL UNION ALL
  SELECT DISTINCT zgram_id, -1, body FROM zgrams WHERE zgram_id IN (SELECT zgram_id FROM revisions_log)),
b AS (SELECT zgram_id, seq, body, lag(body) OVER (PARTITION BY zgram_id ORDER BY seq) AS before FROM h),
k AS (SELECT zgram_id, seq, 1 AS s, unnest(regexp_extract_all(body, '{_K}', 1)) AS key, unnest(regexp_extract_all(body, '{_K}', 2)) AS op FROM b UNION ALL
  SELECT zgram_id, seq, -1, unnest(regexp_extract_all(before, '{_K}', 1)), unnest(regexp_extract_all(before, '{_K}', 2)) FROM b)
SELECT zgram_id, seq, key, sum(s * CASE op WHEN '++' THEN 1 WHEN '--' THEN -1 ELSE 0 END)::BIGINT AS delta FROM k WHERE seq >= 0 AND key NOT IN ('c', 'C')
GROUP BY ALL HAVING sum(s * CASE op WHEN '++' THEN 1 WHEN '--' THEN -1 ELSE 0 END) <> 0""")
def karma_of_revisions(spark: SparkSession, d: str) -> DataFrame:
    return facts.karma_of_revisions(table(spark, d, "zgrams"), table(spark, d, "revisions_log"))


# -- sorted-stream operators on relational tables --------------------------------------------------
@_query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def tuple_last_keeper(spark: SparkSession, d: str) -> DataFrame:
    return facts.last_keeper(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderkey")


@_query("SELECT l_partkey, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY l_partkey")
def tuple_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return facts.accumulator(table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")), ["l_partkey"], "l_linenumber")


@_query("SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS running FROM events")
def tuple_running_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    return facts.running_sum(e, ["user_id"], ["event_id"], "event_id", block=F.floor(F.col("event_id") / 1024))


@_query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def tuple_counter(spark: SparkSession, d: str) -> DataFrame:
    return facts.counter(table(spark, d, "events"), ["user_id", "event_type"])


@_query("SELECT user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type, value >= 10 AS flag FROM events) WHERE flag GROUP BY ALL")
def tuple_true_keeper(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("value") >= 10).alias("flag"))
    return facts.counter(facts.true_keeper(e, "flag"), ["user_id", "event_type"])


@_query("SELECT n_nationkey, n_name FROM nation")
def tuple_prefix(spark: SparkSession, d: str) -> DataFrame:
    return facts.prefix_grabber(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), 2)


_POOL = ("pool AS (SELECT DISTINCT value FROM (SELECT reaction AS value FROM reactions_log UNION ALL SELECT creator FROM reactions_log UNION ALL SELECT instance FROM revisions_log "
         "UNION ALL SELECT body FROM revisions_log UNION ALL SELECT user_id FROM zmojis_log UNION ALL SELECT zmojis FROM zmojis_log UNION ALL SELECT key FROM pp) WHERE value IS NOT NULL), "
         "codes AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM pool)")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rx, rev, zm = (table(spark, d, t) for t in ("reactions_log", "revisions_log", "zmojis_log"))
    keys = facts.karma_deltas(current(spark, d))
    return facts.dictionary([(rx, "reaction"), (rx, "creator"), (rev, "instance"), (rev, "body"), (zm, "user_id"), (zm, "zmojis"), (keys, "key")])


@_query(f"WITH {BASE}, {_PP}, {_POOL} SELECT value FROM pool")
def string_pool(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


@_query(f"WITH {BASE}, {_PP}, {_POOL} SELECT value, code FROM codes")
def string_codes(spark: SparkSession, d: str) -> DataFrame:
    return facts.string_codes(_pool(spark, d))


@_query(f"WITH {BASE}, {_PP}, {_POOL} SELECT zgram_id, r.code AS reaction, c.code AS creator FROM (SELECT zgram_id, reaction, creator FROM rx WHERE value) x JOIN codes r ON r.value = x.reaction JOIN codes c ON c.value = x.creator")
def frozen_reactions(spark: SparkSession, d: str) -> DataFrame:
    """Current reactions with codes of the pool in place of strings."""
    rx = facts.current_reactions(table(spark, d, "reactions_log")).select("zgram_id", "reaction", "creator")
    return facts.freeze(rx, ["reaction", "creator"], facts.string_codes(_pool(spark, d))).select("zgram_id", "reaction", "creator")


@_query(f"WITH {BASE}, c AS (SELECT reaction, zgram_id::VARCHAR AS z, creator FROM rx WHERE value) SELECT 0 AS level, '' AS grp, count(DISTINCT reaction) AS n FROM c UNION ALL "
        "SELECT 1, reaction, count(DISTINCT z) FROM c GROUP BY reaction UNION ALL SELECT 2, reaction || ' ' || z, count(DISTINCT creator) FROM c GROUP BY reaction, z")
def nested_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes of reaction > message > creator at each level."""
    rx = facts.current_reactions(table(spark, d, "reactions_log"))
    return facts.nested_sizes(rx, ["reaction", "zgram_id", "creator"]).select("level", F.array_join("group", " ").alias("grp"), "n")


@_query(f"WITH {BASE} SELECT zgram_id, string_agg(reaction || ':' || c, ' ' ORDER BY reaction) AS nested FROM (SELECT zgram_id, reaction, string_agg(creator, ',' ORDER BY creator) AS c FROM rx WHERE value GROUP BY ALL) GROUP BY zgram_id")
def inflate_reactions(spark: SparkSession, d: str) -> DataFrame:
    nested = facts.inflate(facts.current_reactions(table(spark, d, "reactions_log")), "zgram_id", "reaction", "creator")
    return nested.select("zgram_id", F.array_join(F.transform(F.map_entries("nested"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), " ").alias("nested"))


# -- paging ----------------------------------------------------------------------------------------
def _hits(spark: SparkSession, d: str) -> DataFrame:
    return row_plan.search_archive(parse("relay"), table(spark, d, "zgrams"), table(spark, d, "revisions_log"))


@_query(f"WITH {BASE} SELECT zgram_id FROM t WHERE {RELAY} ORDER BY zgram_id DESC LIMIT 20")
def page_front(spark: SparkSession, d: str) -> DataFrame:
    return paging.page(_hits(spark, d), paging.start(current(spark, d)), "front", paging.INITIAL).select("zgram_id")


@_query(f"WITH {BASE} SELECT zgram_id FROM t WHERE {RELAY} AND zgram_id >= 1000 ORDER BY zgram_id LIMIT 50")
def page_back(spark: SparkSession, d: str) -> DataFrame:
    return paging.page(_hits(spark, d), paging.start(current(spark, d), "zgram", 1000), "back").select("zgram_id")


@_query(f"WITH {BASE} SELECT zgram_id FROM t WHERE {RELAY} AND zgram_id >= (SELECT min(zgram_id) FROM z WHERE timesecs >= 983000000) ORDER BY zgram_id LIMIT 50")
def page_from_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return paging.page(_hits(spark, d), paging.start(current(spark, d), "timestamp", 983000000), "back").select("zgram_id")


@_query(f"WITH {BASE} SELECT zgram_id FROM (SELECT zgram_id FROM t WHERE {RELAY} ORDER BY zgram_id DESC LIMIT 40) ORDER BY zgram_id LIMIT 20")
def page_second(spark: SparkSession, d: str) -> DataFrame:
    """The page below the newest 20 hits."""
    hits = _hits(spark, d)
    c = paging.start(current(spark, d))
    c = paging.advance(c, "front", [r[0] for r in paging.page(hits, c, "front", 20).select("zgram_id").collect()])
    return paging.page(hits, c, "front", 20).select("zgram_id")


@_query(f"WITH {BASE}, n AS (SELECT count(*) FILTER (zgram_id >= 1000) AS b, count(*) FILTER (zgram_id < 1000) AS f FROM t WHERE {RELAY}) "
        "SELECT 'back' AS side, least(b, 20) AS count, b < 20 AS exact FROM n UNION ALL SELECT 'front', least(f, 20), f < 20 FROM n")
def estimates(spark: SparkSession, d: str) -> DataFrame:
    return paging.estimates(_hits(spark, d), paging.Cursor(1000, 1000))


@_query(f"WITH {BASE} SELECT zgram_id, body FROM z WHERE zgram_id IN (1, 4, 68, 100, 999999999)")
def get_specific(spark: SparkSession, d: str) -> DataFrame:
    return paging.specific(current(spark, d), [1, 4, 68, 100, 999999999]).select("zgram_id", "body")


@_query(f"WITH {BASE} SELECT zgram_id, is_logged FROM z0")
def merged_kinds(spark: SparkSession, d: str) -> DataFrame:
    m = facts.messages(table(spark, d, "zgrams"))
    return facts.merge_kinds(m.filter("is_logged"), m.filter("not is_logged")).select("zgram_id", "is_logged")


# -- policies --------------------------------------------------------------------------------------
@_query(f"WITH {BASE} SELECT zgram_id, log_date::VARCHAR AS log_date FROM z WHERE is_logged OR log_date >= (SELECT max(log_date) FROM zgrams) - 7")
def retention_ttl(spark: SparkSession, d: str) -> DataFrame:
    m = current(spark, d)
    today = m.agg(F.max("log_date")).first()[0]
    return policy.retained(m, F.lit(today)).select("zgram_id", F.col("log_date").cast("string").alias("log_date"))


@_query(f"WITH {BASE} SELECT zgram_id, NOT (instance = 'graffiti' OR starts_with(instance, 'graffiti.')) AS logged FROM z")
def logging_policy(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select("zgram_id", T.is_logged(F.col("instance")).alias("logged"))


@_query("SELECT zgram_id, (year(log_date) * 100000 + month(log_date) * 1000 + day(log_date) * 10 + is_logged::INT)::BIGINT AS day_key FROM zgrams GROUP BY ALL")
def day_keys(spark: SparkSession, d: str) -> DataFrame:
    return facts.messages(table(spark, d, "zgrams")).select("zgram_id", T.day_key(F.col("log_date"), F.col("is_logged")).alias("day_key"))


@_query("SELECT line_id, make_date((file_key // 100000)::INT, (file_key // 1000 % 100)::INT, (file_key // 10 % 100)::INT)::VARCHAR AS day, file_key % 10 = 1 AS logged FROM raw_lines")
def day_keys_expand(spark: SparkSession, d: str) -> DataFrame:
    day, logged = T.day_of_key(F.col("file_key"))
    return table(spark, d, "raw_lines").select("line_id", day.cast("string").alias("day"), logged.alias("logged"))


@_query(f"WITH {BASE} SELECT zgram_id, coalesce(sender = 'kifafi', false) OR coalesce(starts_with(instance, 'help.'), false) AS weakly_hidden, coalesce(starts_with(instance, 'help.'), false) AS strongly_hidden FROM z")
def filters_weak_strong(spark: SparkSession, d: str) -> DataFrame:
    rows = policy.with_filters(current(spark, d), [{"sender": "kifafi"}, {"instance_prefix": "help.", "strong": True}])
    return rows.select("zgram_id", "weakly_hidden", "strongly_hidden")


@_query(f"WITH {BASE} SELECT count(*) FILTER (zgram_id > 5000) AS n_unread FROM z")
def unread_count(spark: SparkSession, d: str) -> DataFrame:
    return policy.unread(current(spark, d), 5000)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """All metadata records once, in one shape."""
    out = None
    for name, kind in (("reactions_log", "rx"), ("revisions_log", "zgrev"), ("refers_log", "ref"), ("zmojis_log", "zmojis")):
        t = table(spark, d, name)
        def c(x: str, of: str) -> Column:
            return F.col(x).cast(of).alias(x) if x in t.columns else F.lit(None).cast(of).alias(x)
        rows = t.select(F.lit(kind).alias("kind"), "seq", c("zgram_id", "long"), c("creator", "string"), c("user_id", "string")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


_ALLOWED = """a AS (SELECT 'rx' AS kind, seq, zgram_id FROM (SELECT DISTINCT seq, zgram_id, creator FROM reactions_log) WHERE creator = 'kifafi' UNION ALL
SELECT 'zgrev', seq, zgram_id FROM (SELECT DISTINCT seq, zgram_id FROM revisions_log) r JOIN z0 USING (zgram_id) WHERE z0.sender = 'kifafi' UNION ALL
SELECT 'ref', seq, zgram_id FROM (SELECT DISTINCT seq, zgram_id FROM refers_log) r JOIN z0 USING (zgram_id) WHERE z0.sender = 'kifafi' UNION ALL
SELECT DISTINCT 'zmojis', seq, NULL FROM zmojis_log)"""


@_query(f"WITH {BASE}, {_ALLOWED} SELECT kind, seq FROM a")
def sanitize_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Which records of all kinds one user may post."""
    return policy.sanitize(_records(spark, d), facts.messages(table(spark, d, "zgrams")), F.lit("kifafi")).select("kind", "seq")


# -- live searches ---------------------------------------------------------------------------------
def _sessions(spark: SparkSession, d: str) -> Sessions:
    s = Sessions(spark, shared_dir(spark, "live"), Tables(*[table(spark, d, t) for t in ("zgrams", "reactions_log", "revisions_log", "refers_log", "zmojis_log")]))
    s.index = published(spark, d)
    return s


_PAGE = f"p AS (SELECT zgram_id FROM t WHERE {RELAY} AND zgram_id < 3000 ORDER BY zgram_id DESC LIMIT 20)"


def _first_page(spark: SparkSession, d: str):
    s = _sessions(spark, d)
    s.subscribe("a", "kifafi", "relay", "zgram", 3000)
    return s, s.get_more("a", "front", 20)


@_query(f"WITH {BASE}, n AS (SELECT count(*) FILTER (zgram_id >= 3000) AS b, count(*) FILTER (zgram_id < 3000) AS f FROM t WHERE {RELAY}) "
        "SELECT 'back' AS side, least(b, 20) AS count, b < 20 AS exact FROM n UNION ALL SELECT 'front', least(f, 20), f < 20 FROM n")
def subscribe_estimates(spark: SparkSession, d: str) -> DataFrame:
    """What a new subscription is told first."""
    return _sessions(spark, d).subscribe("a", "kifafi", "relay", "zgram", 3000)[1]


@_query(f"WITH {BASE}, {_PAGE} SELECT zgram_id, sender, body FROM z JOIN p USING (zgram_id)")
def get_more_rows(spark: SparkSession, d: str) -> DataFrame:
    return _first_page(spark, d)[1].rows.select("zgram_id", "sender", "body")


@_query(f"WITH {BASE}, {_REFS}, {_PAGE} SELECT 'rx' AS kind, zgram_id, count(*) AS n FROM rx JOIN p USING (zgram_id) WHERE value GROUP BY ALL UNION ALL "
        "SELECT 'zgrev', zgram_id, count(DISTINCT seq) FROM revisions_log JOIN p USING (zgram_id) GROUP BY ALL UNION ALL SELECT 'ref', zgram_id, count(*) FROM ref JOIN p USING (zgram_id) WHERE value GROUP BY ALL")
def get_more_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _first_page(spark, d)[1].metadata.groupBy("kind", "zgram_id").agg(F.count("*").alias("n"))


@_query(f"WITH {BASE}, {_PP}, {_PAGE}, r AS (SELECT key, zgram_id, sum(delta) OVER (PARTITION BY key ORDER BY zgram_id)::BIGINT AS karma FROM pp) SELECT key, zgram_id, karma FROM r JOIN p USING (zgram_id)")
def get_more_karma(spark: SparkSession, d: str) -> DataFrame:
    return _first_page(spark, d)[1].karma


@_query(f"WITH {BASE}, n AS (SELECT count(*) FILTER (zgram_id >= 3000) AS b, count(*) FILTER (zgram_id < (SELECT min(zgram_id) FROM (SELECT zgram_id FROM t WHERE {RELAY} AND zgram_id < 3000 ORDER BY zgram_id DESC LIMIT 20))) AS f FROM t WHERE {RELAY}) "
        "SELECT 'back' AS side, least(b, 20) AS count, b < 20 AS exact FROM n UNION ALL SELECT 'front', least(f, 20), f < 20 FROM n")
def get_more_estimates(spark: SparkSession, d: str) -> DataFrame:
    """What is left after the first page."""
    return _first_page(spark, d)[1].estimates


@_query(f"WITH {BASE}, {_ALLOWED}, {_PAGE} SELECT 'a' AS sub_id, kind, seq FROM a WHERE zgram_id BETWEEN (SELECT min(zgram_id) FROM p) AND (SELECT max(zgram_id) FROM p) UNION "
        "SELECT 'a', 'zmojis', seq FROM zmojis_log WHERE user_id = 'kifafi'")
def post_metadata(spark: SparkSession, d: str) -> DataFrame:
    """One user posts every record again: who is told of what, after it was sanitised and appended."""
    s, _ = _first_page(spark, d)
    root = shared_dir(spark, "posted")

    def append(allowed: DataFrame) -> Tables:
        allowed.select("kind", "seq", "zgram_id").write.parquet(root)
        return s.tables
    return s.post_metadata("a", _records(spark, d), append)


@_query(f"WITH {BASE} SELECT zgram_id FROM t JOIN z USING (zgram_id) WHERE ({RELAY.replace('instance', 't.instance').replace('body', 't.body')}) AND (is_logged OR z.log_date >= (SELECT max(log_date) FROM zgrams) - 7)")
def reindex_and_reset(spark: SparkSession, d: str) -> DataFrame:
    """A search of a subscription that was moved over to the next index, built when its time came."""
    s = _sessions(spark, d)
    s.subscribe("a", "kifafi", "relay")
    today = s.tables.zgrams.agg(F.max("log_date")).first()[0]
    s.maintain(dt.datetime(today.year, today.month, today.day))
    return s.subscriptions["a"].hits.select("zgram_id")


@_query(f"WITH {BASE} SELECT zgram_id, coalesce(length(trim(instance, ' ')) > 0 AND length(trim(body, ' ')) > 0, false) AS ok FROM z")
def submit_validity(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).select("zgram_id", T.can_submit(F.col("instance"), F.col("body")).alias("ok"))


@_query("SELECT user_id, CASE WHEN trim(zmojis, ' ') = '' THEN 0 ELSE len(string_split(trim(zmojis, ' '), ',')) END::BIGINT AS n FROM (SELECT * FROM zmojis_log WHERE user_id IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, delivered_at) = 1) WHERE zmojis IS NOT NULL")
def zmojis_list(spark: SparkSession, d: str) -> DataFrame:
    return facts.current_zmojis(table(spark, d, "zmojis_log")).select("user_id", F.size(T.zmoji_list(F.col("zmojis"))).cast("long").alias("n"))


@_query(f"WITH {BASE} SELECT coalesce(min(zgram_id) FILTER (zgram_id >= 777), max(zgram_id) + 1) AS by_id, coalesce(min(zgram_id) FILTER (timesecs >= 983000000), max(zgram_id) + 1) AS by_time, max(zgram_id) + 1 AS end_id FROM z")
def lower_bounds(spark: SparkSession, d: str) -> DataFrame:
    m = current(spark, d).select("zgram_id", "timesecs")
    return spark.createDataFrame([(facts.lower_bound(m, zgram_id=777), facts.lower_bound(m, timesecs=983000000), facts.end_id(m))], "by_id long, by_time long, end_id long")


_B = "instance|body"


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', {v}, '{p}')" for q, v, p in (
    ("relay", "true", f"Adapt(Pattern({_B}, relay))"), ('body:^"a b"', "true", "Near(1, [Anchored(^, Pattern(body, a)), Pattern(body, b)])"),
    ("a or b and not c", "true", f"Or([Adapt(Pattern({_B}, a)), And([Adapt(Pattern({_B}, b)), Not(Adapt(Pattern({_B}, c)))])])"), ("sender:*", "true", "PopOrNot(pop=sender, unpop=(none))"),
    ("zgramid(5)", "true", "ZgramId(5)"))) + ") v(query, valid, plan) UNION ALL SELECT * FROM (VALUES ('\"open', false, ''), ('(a', false, ''), ('zgramid(x)', false, '')) w(query, valid, plan)")
def syntax_check(spark: SparkSession, d: str) -> DataFrame:
    """Plans of some queries, and those that have none."""
    texts = ["relay", 'body:^"a b"', "a or b and not c", "sender:*", "zgramid(5)", '"open', "(a", "zgramid(x)"]
    checked = [(q, *check_syntax(q)) for q in texts]
    return spark.createDataFrame([(q, ok, plan if ok else "") for q, ok, plan in checked], "query string, valid boolean, plan string")


# -- sources, streaming ----------------------------------------------------------------------------
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in ("timesecs", "sender", "signature", "is_logged", "instance", "body", "render_style"))


@_query(f"WITH o AS (SELECT DISTINCT zgram_id, timesecs, sender, signature, instance, body FROM zgrams WHERE {_WHOLE}) SELECT * FROM o")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Messages encoded as log lines and decoded again."""
    m = facts.messages(table(spark, d, "zgrams")).filter(_WHOLE)
    lines = logs.encode({"zgrams": m}).select(F.col("seq").alias("line_id"), "line")
    return decode_lines(lines).valid().select("zgram_id", "timesecs", "sender", "signature", "instance", "body")


_WRITABLE = {"zgrams": (["zgram_id", *("timesecs", "sender", "signature", "is_logged", "instance", "body", "render_style")], "zgram_id"),
             "reactions_log": (["zgram_id", "reaction", "creator", "value"], "seq"), "revisions_log": (["zgram_id", "instance", "body", "render_style"], "seq"),
             "refers_log": (["zgram_id", "refers_to", "value"], "seq"), "zmojis_log": (["user_id", "zmojis"], "seq")}
_LINES = "lines AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{name}' AS feed, {key} AS key, {'is_logged' if name == 'zgrams' else 'true'} AS is_logged, log_date FROM {name} WHERE log_date IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in cols)
    for name, (cols, key) in _WRITABLE.items()) + ")"


def _write_logs(spark: SparkSession, d: str) -> str:
    """All records as a log directory. A null can't be written: the layouts have none."""
    root = shared_dir(spark, "logs")
    rows = {}
    for name, (cols, key) in _WRITABLE.items():
        t = table(spark, d, name).dropna(subset=[*cols, "log_date"])
        rows[name] = t.dropDuplicates([key]) if name == "zgrams" else t.dropDuplicates(["seq"]).withColumn("is_logged", F.lit(True))
    logs.append(logs.encode(rows, "is_logged", "log_date").withColumnRenamed("seq", "nth"), root)
    return root


@_query(f"WITH {_LINES} SELECT feed, log_date::VARCHAR AS log_date, count(*) AS n FROM lines GROUP BY ALL")
def log_directory(spark: SparkSession, d: str) -> DataFrame:
    """All records of five kinds appended to the logs of their days, read back by path and decoded."""
    got = logs.load(logs.read(spark, _write_logs(spark, d)))
    out = None
    for name in _WRITABLE:
        rows = got[name].select(F.lit(name).alias("feed"), F.col("log_date").cast("string").alias("log_date"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("feed", "log_date").agg(F.count("*").alias("n"))


@_query(f"WITH {_LINES} SELECT is_logged, log_date::VARCHAR AS log_date, count(*) AS n FROM lines WHERE "
        "(is_logged AND log_date BETWEEN DATE '2001-02-01' AND DATE '2001-03-31') OR (NOT is_logged AND log_date >= DATE '2001-02-15') GROUP BY ALL")
def log_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Each kind clipped to a range of its own."""
    rows = logs.read(spark, _write_logs(spark, d), logged=(("20010201", 0), ("20010401", 0)), unlogged=(("20010215", 0), ("99991231", 0)))
    return rows.groupBy(F.col("is_logged_file").alias("is_logged"), F.col("log_date").cast("string").alias("log_date")).agg(F.count("*").alias("n"))


@_query(ORACLE["karma_delta"])
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Messages and revisions ingested as streams, then the same karma as in batch."""
    root = shared_dir(spark, "ingested")
    for name in ("zgrams", "revisions_log"):
        schema = table(spark, d, name).schema
        ingest.run(ingest.source(spark, f"{d}/{name}.parquet*", schema), ingest.append_batches(f"{root}/{name}"))
    z, r = (spark.read.parquet(f"{root}/{n}").drop("batch") for n in ("zgrams", "revisions_log"))
    return facts.karma_deltas(facts.current_text(z, r))


@_query(f"WITH {BASE} SELECT 's1' AS sub_id, seq FROM rx WHERE value AND zgram_id >= 1000 AND zgram_id < 2500 UNION ALL SELECT 's2', seq FROM rx WHERE value AND (zgram_id >= 2000 AND zgram_id < 3000)")
def notify_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Reactions that concern two subscribers by what they display."""
    events = facts.current_reactions(table(spark, d, "reactions_log")).select("zgram_id", "seq", F.lit(None).cast("string").alias("user_id"))
    subs = spark.createDataFrame([("s1", "kifafi", 1000, 2500), ("s2", "pikoto", 2000, 3000)], "sub_id string, user_id string, lo long, hi long")
    return ingest.notify_metadata(events, subs).select("sub_id", "seq")


@_query(f"WITH {BASE}, {_PP}, r AS (SELECT key, zgram_id, sum(delta) OVER (PARTITION BY key ORDER BY zgram_id)::BIGINT AS karma FROM pp), c AS (SELECT key, min(zgram_id) AS since FROM pp WHERE zgram_id BETWEEN 2000 AND 3000 GROUP BY key) "
        "SELECT r.key, zgram_id, karma FROM r JOIN c USING (key) WHERE zgram_id >= since AND zgram_id BETWEEN 1000 AND 4999")
def notify_karma(spark: SparkSession, d: str) -> DataFrame:
    deltas = facts.karma_deltas(current(spark, d))
    return ingest.notify_karma(deltas, deltas.filter("zgram_id between 2000 and 3000").select("key", "zgram_id"), 1000, 5000)


@_query(f"WITH {BASE}, {_PP}, r AS (SELECT key, zgram_id, sum(delta) OVER (PARTITION BY key ORDER BY zgram_id)::BIGINT AS karma FROM pp), "
        "c AS (SELECT key, min(zgram_id) AS since FROM pp WHERE zgram_id IN (SELECT zgram_id FROM revisions_log) GROUP BY key) "
        "SELECT r.key, zgram_id, karma FROM r JOIN c USING (key) WHERE zgram_id >= since")
def notify_karma_all(spark: SparkSession, d: str) -> DataFrame:
    """For a subscription to the whole archive, after all revisions."""
    z = current(spark, d)
    deltas = facts.karma_deltas(z)
    changed = deltas.join(table(spark, d, "revisions_log").select("zgram_id").distinct(), "zgram_id", "left_semi").select("key", "zgram_id")
    return ingest.notify_karma(deltas, changed, 0, facts.end_id(z))
