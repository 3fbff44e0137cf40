"""Queries over the texts of the archive and their SQL, where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlore.llm import conversations as C
from chatlore.llm import frequency as N
from chatlore.llm import leakage as L
from chatlore.llm import markup as M
from chatlore.llm import pii as P
from chatlore.llm import residue as R
from chatlore.llm import tokenizer as K
from chatlore.shared import spread, table


def _lexicon(messages: DataFrame) -> DataFrame:
    return P.lexicon_table(messages.select(F.explode(F.array("body", "signature")).alias("text")))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Repeated deliveries are dropped from the narrow result, so that no text is shuffled."""
    m = spread(table(spark, d, "zgrams").filter("zgram_id is not null").select("zgram_id", "body", "signature"))
    return P.entities(m, "zgram_id", ["body", "signature"], _lexicon(m)).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("zgram_id", "field", "kind")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items and messages per field and kind."""
    return _entities(spark, d).groupBy("field", "kind").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_messages"))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every message with placeholders in place of personal data."""
    m = _messages(spark, d, "body", "signature")
    return P.mask(m, "zgram_id", ["body", "signature"], _lexicon(m))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "zgrams")
    total = z.agg(F.count_distinct("zgram_id")).first()[0]
    return N.mark(N.ngram_counts(N.message_records(z)), total)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).filter("mark is not null").select("field", F.col("gram")[0].alias("term"), "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("field", F.col("gram")[0].alias("term"), "occurrences", "records",
                                    F.coalesce("mark", F.lit("")).alias("mark"))


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to three words (or values) that occur in more than one message."""
    grams = N.ngram_counts(N.message_records(table(spark, d, "zgrams")), max_n=3).filter("records > 1")
    return grams.select("field", "n", F.array_join("gram", " ").alias("gram"), "occurrences", "records")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return C.conversations(table(spark, d, "zgrams"), table(spark, d, "refers_log"), table(spark, d, "purged_zgrams"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select("root_id", "turn", "zgram_id")


def p3_roles(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d)


def _messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every message once."""
    return table(spark, d, "zgrams").filter("zgram_id is not null").select("zgram_id", *columns).dropDuplicates(["zgram_id"])


def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows from which stripping takes markup, repeated deliveries included; texts that can't hold any aren't stripped."""
    z = spread(table(spark, d, "zgrams").filter("zgram_id is not null").select("zgram_id", "body"))
    return M.clean(z.filter(F.size(M.kinds(F.col("body"))) > 0)).filter(F.size("kinds") > 0)


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every message with markup."""
    rows = p6_rows(spark, d).select("zgram_id", F.array_join("kinds", ",").alias("kinds"), "clean_text")
    return rows.dropDuplicates(["zgram_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages from which stripping takes markup."""
    return p6_rows(spark, d).select("zgram_id").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return K.encode(spread(table(spark, d, "documents")))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from the text (none)."""
    docs = spread(table(spark, d, "documents"))
    back = K.decode(K.encode(docs)).withColumnRenamed("text", "decoded")
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id")
            .groupBy((F.col("text") == F.col("decoded")).alias("equal")).agg(F.count("*").alias("n_docs")))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where the tokens of each document end, and whether each begins no later than the one before it ended."""
    rows = K.encode_with_offsets(spread(table(spark, d, "documents")))
    gap = F.exists(F.zip_with(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda b, e: b > e), lambda x: x)
    return rows.select("doc_id", F.coalesce(F.array_max("ends"), F.lit(0)).alias("n_chars"), gap.alias("gap"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return L.find(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaks per item."""
    return p9_leaks(spark, d).groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("run_words").alias("longest_run"),
        F.sum(F.col("has_answer").cast("long")).alias("n_with_answer"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return R.judge(table(spark, d, "documents")).select("doc_id")


def p10_reasons(spark: SparkSession, d: str) -> DataFrame:
    return R.judge(table(spark, d, "documents")).groupBy("reason").agg(F.count("*").alias("n_docs"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay, per source."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return docs.join(R.judge(table(spark, d, "documents")), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_masked, p2_found, p2_counts, p2_ngrams, p3_found, p3_roles, p6_found, p6_clean, p8_ids, p8_round_trip, p8_offsets,
                                   p9_found, p9_leaks, p9_items, p10_found, p10_reasons, p10_kept)}

_W = r"[0-9a-z\x{80}-\x{10FFFF}]+(?:''+[0-9a-z\x{80}-\x{10FFFF}]+)*"
_ONCE = "SELECT zgram_id, any_value(body) AS body, any_value(instance) AS instance, any_value(sender) AS sender FROM zgrams GROUP BY ALL"
_TERMS = f"""
WITH z AS ({_ONCE}),
t AS (SELECT zgram_id, 'body' AS field, unnest(regexp_extract_all(lower(body), '{_W}')) AS term FROM z
  UNION ALL SELECT zgram_id, 'instance', instance FROM z WHERE instance <> ''
  UNION ALL SELECT zgram_id, 'sender', sender FROM z WHERE sender <> ''),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT zgram_id) AS records FROM t GROUP BY ALL),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records * 20 > (SELECT count(*) FROM z) THEN 'common' END AS mark FROM c)
"""
_CONV = """
WITH RECURSIVE e AS (
  SELECT zgram_id AS a, refers_to AS b FROM refers_log WHERE zgram_id IS NOT NULL AND refers_to IS NOT NULL AND value IS NOT NULL
  GROUP BY ALL HAVING arg_max(value, seq)),
p AS (SELECT a, min(b) AS b FROM e WHERE a <> b GROUP BY a),
r AS (SELECT DISTINCT b AS node FROM p WHERE b NOT IN (SELECT a FROM p)),
t AS (SELECT node, node AS root, CAST(NULL AS BIGINT) AS parent FROM r
  UNION ALL SELECT p.a, t.root, p.b FROM t JOIN p ON p.b = t.node),
x AS (SELECT e.a, e.b FROM e LEFT JOIN t ON t.node = e.a AND t.parent = e.b WHERE t.node IS NULL),
bad AS (SELECT DISTINCT root FROM t WHERE node IN (SELECT a FROM x UNION SELECT b FROM x)),
z AS (SELECT zgram_id AS node, any_value(timesecs) AS ts, any_value(sender) AS sender, any_value(lower(trim(instance, ' '))) AS inst,
        any_value(trim(body, E' \\t\\r\\n') <> '') AS hasb FROM zgrams GROUP BY ALL),
m AS (SELECT t.*, z.ts, z.sender, z.inst, z.hasb, z.node IS NULL OR t.node IN (SELECT zgram_id FROM purged_zgrams) OR z.ts IS NULL OR z.inst IS NULL
        OR (t.parent IS NOT NULL AND NOT coalesce((z.ts, t.node) > (q.ts, t.parent), false)) AS wrong
      FROM t LEFT JOIN z USING (node) LEFT JOIN z q ON q.node = t.parent),
k AS (SELECT root FROM m GROUP BY root HAVING NOT bool_or(wrong) AND count(DISTINCT inst) = 1 AND count(*) > 1
        AND count(DISTINCT CASE WHEN hasb THEN sender END) > 1 AND root NOT IN (SELECT root FROM bad)),
o AS (SELECT m.root AS root_id, row_number() OVER (PARTITION BY m.root ORDER BY ts, node) AS turn, node AS zgram_id, sender,
        first(sender) OVER (PARTITION BY m.root ORDER BY CASE WHEN node = m.root THEN 0 ELSE 1 END) AS starter FROM m JOIN k ON k.root = m.root)
"""

ORACLE = {
    "p2_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p2_counts": _TERMS + "SELECT field, term, occurrences, records, coalesce(mark, '') AS mark FROM m",
    "p2_ngrams": f"""WITH z AS ({_ONCE}), w AS (SELECT zgram_id, 'body' AS field, regexp_extract_all(lower(body), '{_W}') AS w FROM z WHERE body IS NOT NULL
  UNION ALL SELECT zgram_id, 'instance', [instance] FROM z WHERE instance <> '' UNION ALL SELECT zgram_id, 'sender', [sender] FROM z WHERE sender <> ''),
p AS (SELECT zgram_id, field, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT zgram_id, field, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM p, (VALUES (1), (2), (3)) v(n) WHERE i + n - 1 <= len(w))
SELECT field, n, gram, count(*) AS occurrences, count(DISTINCT zgram_id) AS records FROM g GROUP BY ALL HAVING count(DISTINCT zgram_id) > 1""",
    "p3_found": _CONV + "SELECT root_id, turn, zgram_id FROM o",
    "p3_roles": _CONV + "SELECT root_id, turn, zgram_id, CASE WHEN sender IS NOT DISTINCT FROM starter THEN 'starter' ELSE 'responder' END AS role FROM o",
    "p8_offsets": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, false AS gap FROM documents",
    "p8_round_trip": "SELECT true AS equal, count(*) AS n_docs FROM documents",
}
