"""A query plan over rows with word arrays.

``search`` is one Boolean column over rows that are current already. ``search_archive`` starts from the
raw tables: each message and each revision is reduced, where it is read, to one flag for each leaf
of the plan; only ids, flags and times are moved to drop repeats and to let the latest revision
replace the text. No text is shuffled. ``hasreaction`` joins the ids with that reaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlore.functions.text import glob_match
from chatlore.operators.index import with_tokens
from chatlore.plans import nodes as P


def _parts(word) -> tuple[object, bool, bool]:
    return (word.child, word.left, word.right) if isinstance(word, P.Anchored) else (word, False, False)


def _hit(word, token: Column) -> Column:
    core = _parts(word)[0]
    return F.lit(True) if isinstance(core, P.AnyWord) else glob_match(token, core.glob)


def _single(word, field: str) -> Column:
    """Whether a field has the word, with its anchors."""
    core, left, right = _parts(word)
    tok = F.col(f"tok_{field}")
    first, last = _hit(word, F.try_element_at(tok, F.lit(1))), _hit(word, F.try_element_at(tok, F.lit(-1)))
    some = F.size(tok) > 0
    if left and right:
        return (F.size(tok) == 1) & first
    if left:
        return some & first
    if right:
        return some & last
    return some if isinstance(core, P.AnyWord) else F.exists(tok, lambda t: _hit(word, t))


def _near(node: P.Near, field: str) -> Column:
    """Ordered proximity by dynamic programming over positions that match so far.

    The word array is bound once: a filter is pushed below the projection that splits the words, and
    would split them anew at each position.
    """
    return F.exists(F.array(F.col(f"tok_{field}")), lambda tok: _near_in(node, tok))


def _near_in(node: P.Near, tok: Column) -> Column:
    """One fold over the positions that keeps, for each word, the last place where the words up to it match."""
    every = F.when(F.size(tok) > 0, F.sequence(F.lit(0), F.size(tok) - 1)).otherwise(F.array().cast("array<int>"))
    never = -node.margin - 1

    def at(word, i: Column) -> Column:
        _, left, right = _parts(word)
        ok = _hit(word, F.get(tok, i))
        ok = ok & (i == 0) if left else ok
        return ok & (i == F.size(tok) - 1) if right else ok

    def step(last: Column, i: Column) -> Column:
        out = []
        for k, w in enumerate(node.words):
            ok = at(w, i) if k == 0 else (i - last[k - 1] <= node.margin) & at(w, i)
            out.append(F.when(ok, i).otherwise(last[k]))
        return F.array(*out)
    n = len(node.words)
    return F.aggregate(every, F.array(*[F.lit(never)] * n), step, lambda last: last[n - 1] >= 0)


def _fields(word) -> list[str]:
    core = _parts(word)[0]
    return [f for f in P.FIELDS if f in core.mask]


def _in_fields(node, fields) -> Column:
    """Whether a leaf holds by some fields of a row alone."""
    out = F.lit(False)
    if isinstance(node, P.PopOrNot):
        for f in fields:
            if f in node.pop:
                out = out | (F.size(f"tok_{f}") > 0)
            if f in node.unpop:
                out = out | (F.size(f"tok_{f}") == 0)
    elif isinstance(node, P.Adapt):
        for f in _fields(node.word):
            out = out | _single(node.word, f) if f in fields else out
    else:
        for f in _fields(node.words[0]):
            out = out | _near(node, f) if f in fields else out
    return out


def predicate(node, reacted: dict[str, str], leaf=lambda node: _in_fields(node, P.FIELDS)) -> Column:
    """Column of a plan; ``reacted`` maps a reaction to the flag column that stands for it, ``leaf`` gives that of a leaf."""
    if isinstance(node, (P.And, P.Or)):
        out = F.lit(isinstance(node, P.And))
        for c in node.children:
            one = predicate(c, reacted, leaf)
            out = out & one if isinstance(node, P.And) else out | one
        return out
    if isinstance(node, P.Not):
        return ~predicate(node.child, reacted, leaf)
    if isinstance(node, P.PopOrNot) and node == P.TRUE:
        return F.lit(True)
    if isinstance(node, P.ZgramId):
        return F.col("zgram_id") == node.zgram_id
    if isinstance(node, P.HavingReaction):
        return F.col(reacted[node.reaction])
    return leaf(node)


def leaves(node) -> list:
    """The distinct leaves that look at words."""
    if isinstance(node, (P.And, P.Or)):
        return list(dict.fromkeys(x for c in node.children for x in leaves(c)))
    if isinstance(node, P.Not):
        return leaves(node.child)
    return [] if isinstance(node, (P.ZgramId, P.HavingReaction)) or node == P.TRUE else [node]


def _reactions(node) -> set[str]:
    if isinstance(node, P.HavingReaction):
        return {node.reaction}
    children = getattr(node, "children", None) or ((node.child,) if isinstance(node, P.Not) else ())
    return set().union(*map(_reactions, children))


def search(plan, docs: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (with word arrays) that match; ``reactions``: (reaction, zgram_id, n)."""
    reacted = {}
    for n, r in enumerate(sorted(_reactions(plan))):
        flag = f"_reacted{n}"
        ids = reactions.filter((F.col("reaction") == r) & (F.col("n") > 0)).select("zgram_id", F.lit(True).alias(flag))
        docs = docs.join(ids, "zgram_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
        reacted[r] = flag
    return docs.filter(predicate(plan, reacted)).drop(*reacted.values())


OWN, TEXT = ("sender", "signature"), ("instance", "body")  # what revisions leave alone, and what they replace


def _flags(found: list, fields) -> Column:
    return F.array(*[_in_fields(x, fields) for x in found]) if found else F.array().cast("array<boolean>")


def search_archive(plan, zgrams: DataFrame, revisions_log: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """(zgram_id, timesecs) of the messages whose current text matches, from the raw tables."""
    found = leaves(plan)
    rows = with_tokens(zgrams.filter("zgram_id is not null").select("zgram_id", "timesecs", *P.FIELDS))
    rows = rows.select("zgram_id", "timesecs", _flags(found, OWN).alias("own"), _flags(found, TEXT).alias("text"))
    rev = with_tokens(revisions_log.filter("zgram_id is not null").select("zgram_id", "seq", *TEXT, "render_style"), TEXT)
    blank = F.col("instance").isNull() & F.col("body").isNull() & F.col("render_style").isNull()
    rev = rev.select("zgram_id", "seq", F.struct((~blank).alias("stands"), _flags(found, TEXT).alias("text")).alias("r"))
    last = rev.groupBy("zgram_id").agg(F.max_by("r", "seq").alias("r")).filter("r.stands").select("zgram_id", F.col("r.text").alias("new_text"))

    def matching(narrow: DataFrame, text: str) -> DataFrame:
        reacted = {}
        for n, r in enumerate(sorted(_reactions(plan))):
            ids = reactions.filter((F.col("reaction") == r) & (F.col("n") > 0)).select("zgram_id", F.lit(True).alias(f"_reacted{n}"))
            narrow = narrow.join(ids, "zgram_id", "left").withColumn(f"_reacted{n}", F.coalesce(f"_reacted{n}", F.lit(False)))
            reacted[r] = f"_reacted{n}"
        at = {x: n for n, x in enumerate(found)}
        return narrow.filter(predicate(plan, reacted, lambda x: F.col("own")[at[x]] | F.col(text)[at[x]])).select("zgram_id", "timesecs")
    plain = matching(rows, "text").join(last.select("zgram_id"), "zgram_id", "left_anti")
    revised = matching(rows.drop("text").join(last, "zgram_id"), "new_text")
    return plain.unionByName(revised).dropDuplicates(["zgram_id"])
