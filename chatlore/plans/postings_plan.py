"""A query plan over postings: patterns are matched once per distinct word, then joined by position.

Set operations work on ids. Words and postings meet in an equi join whose small side is chosen at
run time; nothing is broadcast by hint, because the number of matching words isn't bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlore.functions.text import exact_word, glob_match
from chatlore.operators.index import Index
from chatlore.plans import nodes as P
from chatlore.plans.row_plan import _parts


def _hits(word, ix: Index) -> DataFrame:
    """(zgram_id, field, pos) of a word's occurrences."""
    core, left, right = _parts(word)
    post = ix.postings.filter(F.col("field").isin(*sorted(core.mask)))
    if left:
        post = post.filter("pos = 0")
    if right:
        post = post.filter("pos = field_len - 1")
    if isinstance(core, P.Pattern) and (word := exact_word(core.glob)) is not None:
        post = post.filter(F.col("token") == word)  # reaches the sorted files
    elif isinstance(core, P.Pattern):
        post = post.join(ix.vocab.filter(glob_match(F.col("token"), core.glob)).select("token"), "token", "left_semi")
    return post.select("zgram_id", "field", "pos")


def ids(node, ix: Index) -> DataFrame:
    """(zgram_id) of the matching messages."""
    every = ix.docs.select("zgram_id")
    if isinstance(node, P.And):
        out = ids(node.children[0], ix)
        for c in node.children[1:]:
            out = out.join(ids(c.child, ix), "zgram_id", "left_anti") if isinstance(c, P.Not) else out.join(ids(c, ix), "zgram_id", "left_semi")
        return out
    if isinstance(node, P.Or):
        out = ids(node.children[0], ix)
        for c in node.children[1:]:
            out = out.unionByName(ids(c, ix))
        return out.distinct()
    if isinstance(node, P.Not):
        return every.join(ids(node.child, ix), "zgram_id", "left_anti")
    if isinstance(node, P.PopOrNot):
        cond = F.lit(node == P.TRUE)
        for f in P.FIELDS:
            if f in node.pop:
                cond = cond | (F.size(f"tok_{f}") > 0)
            if f in node.unpop:
                cond = cond | (F.size(f"tok_{f}") == 0)
        return ix.docs.filter(cond).select("zgram_id")
    if isinstance(node, P.ZgramId):
        return every.filter(F.col("zgram_id") == node.zgram_id)
    if isinstance(node, P.HavingReaction):
        having = ix.reactions.filter((F.col("reaction") == node.reaction) & (F.col("n") > 0)).select("zgram_id")
        return every.join(having, "zgram_id", "left_semi")
    if isinstance(node, P.Adapt):
        return _hits(node.word, ix).select("zgram_id").distinct()
    reach = _hits(node.words[0], ix)
    for w in node.words[1:]:
        # place in buckets of the margin: an equi join on the bucket instead of a range join
        m = node.margin
        left = reach.select("zgram_id", "field", F.col("pos").alias("p0"), F.explode(F.sequence(F.floor((F.col("pos") + 1) / m), F.floor((F.col("pos") + m) / m))).alias("bucket"))
        right = _hits(w, ix).withColumn("bucket", F.floor(F.col("pos") / m))
        reach = left.join(right, ["zgram_id", "field", "bucket"]).filter((F.col("pos") - F.col("p0")).between(1, m)).select("zgram_id", "field", "pos").distinct()
    return reach.select("zgram_id").distinct()


def search(plan, ix: Index) -> DataFrame:
    return ix.docs.join(ids(plan, ix), "zgram_id", "left_semi")
