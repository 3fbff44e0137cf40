"""Conversations from message rows and reply edges, by pointer jumping.

Each reply has a pointer to the message it refers to. Pointers are doubled by joins until they
reach a root; a round in which none does proves that what is left hangs on a cycle, so the number
of rounds is about log2 of the longest chain. A second current edge out of a message joins two
trees: both ends' trees are broken, as are trees that hang on cycles or on unknown messages.

Defined cases: edges with a null in id, parent or ``value`` are ignored, as is every assertion but
the one with the highest ``seq``; messages and edges delivered several times count once; empty
tables give no conversation; other columns are ignored.

Scale: the doubling join is skewed only where many unfinished pointers share a target; adaptive
execution splits such targets. Members are checked by partial aggregates, and turns are numbered in
two levels (within a block of time, then over blocks), so that no task gathers a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlore.shared import cut

BLOCK_SECONDS = 3600
BLANK = r"^[ \t\r\n]*$"


def current_edges(log: DataFrame) -> DataFrame:
    """(zgram_id, refers_to) of assertions whose latest value is true."""
    rows = log.filter("zgram_id is not null and refers_to is not null and value is not null and seq is not null")
    last = rows.groupBy("zgram_id", "refers_to").agg(F.max_by("value", "seq").alias("value"))
    return last.filter("value").select("zgram_id", "refers_to")


def resolve(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root, parent) of every node that reaches a root, and (node) of those on or below cycles."""
    pointer = edges.groupBy(F.col("zgram_id").alias("node")).agg(F.min("refers_to").alias("parent"))
    pointer = cut(pointer, "pointers")
    roots = pointer.select(F.col("parent").alias("node")).distinct().join(pointer, "node", "left_anti").select("node")
    roots = cut(roots, "roots")
    done = roots.select("node", F.col("node").alias("root"))
    # jump(node, to): where the pointer of an unfinished node leads; finished ones know their root
    jump = pointer.select("node", F.col("parent").alias("to"))
    left = None
    finished = [done]
    latest = done
    while True:
        hit = jump.join(latest.select(F.col("node").alias("to"), "root"), "to", "left")
        hit = cut(hit.select("node", "to", "root"), "jumps")
        newly = hit.filter("root is not null").select("node", "root")
        rest = hit.filter("root is null").select("node", "to")
        if newly.isEmpty():
            left = rest.select("node")
            break
        finished.append(newly)
        latest = newly
        if rest.isEmpty():
            left = rest.select("node")
            break
        # what an unfinished pointer leads to is unfinished or finished just now
        onward = rest.alias("a").join(rest.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left")
        jump = onward.select("node", F.coalesce("further", "to").alias("to"))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.join(pointer, "node", "left").select("node", "root", "parent"), left


def number(rows: DataFrame, group: str, order: list[str], time: str) -> DataFrame:
    """``turn`` from 1 within ``group`` by ``order``, in blocks of time; ``order`` begins with ``time``."""
    rows = rows.withColumn("_block", F.floor(F.col(time) / BLOCK_SECONDS))
    block = rows.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(group, "_block").orderBy(*order)
    rows = rows.withColumn("_rank", F.row_number().over(inner)).join(block, [group, "_block"])
    return rows.withColumn("turn", F.col("_before") + F.col("_rank")).drop("_block", "_before", "_rank")


def conversations(zgrams: DataFrame, refers_log: DataFrame, purged: DataFrame) -> DataFrame:
    """(root_id, turn, zgram_id, role) of every kept conversation's messages."""
    edges = cut(current_edges(refers_log), "edges")
    tree, cyclic = resolve(edges.filter("zgram_id <> refers_to"))
    tree = cut(tree, "tree")
    chosen = tree.select(F.col("node").alias("zgram_id"), F.col("parent").alias("refers_to"))
    surplus = edges.join(chosen, ["zgram_id", "refers_to"], "left_anti")
    touched = surplus.select(F.explode(F.array("zgram_id", "refers_to")).alias("node")).distinct()
    broken_by_edge = tree.join(touched, "node", "left_semi").select("root").distinct()

    messages = (
        zgrams.filter("zgram_id is not null")
        .select("zgram_id", "timesecs", "sender", F.lower(F.trim("instance")).alias("instance"),
                (F.col("body").isNotNull() & ~F.col("body").rlike(BLANK)).alias("has_body"))
        .dropDuplicates(["zgram_id"])
        .withColumn("known", F.lit(True))
    )
    gone = purged.filter("zgram_id is not null").select("zgram_id").distinct().withColumn("gone", F.lit(True))
    members = tree.withColumnRenamed("node", "zgram_id").join(messages, "zgram_id", "left").join(gone, "zgram_id", "left")
    members = cut(members, "members")
    parent = members.select(F.col("zgram_id").alias("parent"), F.col("timesecs").alias("parent_time"))
    # the parent's time is looked up only for replies; roots have none
    ordered = members.join(parent, "parent", "left")
    bad = (
        F.col("known").isNull() | F.col("gone").isNotNull() | F.col("timesecs").isNull() | F.col("instance").isNull()
        | (F.col("parent").isNotNull() & ~F.coalesce(
            F.struct("timesecs", "zgram_id") > F.struct(F.col("parent_time"), F.col("parent")), F.lit(False)))
    )
    speaker = F.when(F.col("has_body"), F.col("sender"))
    kept = (
        ordered.groupBy("root").agg(
            F.max(bad.cast("int")).alias("bad"), F.min("instance").alias("i0"), F.max("instance").alias("i1"),
            F.min(speaker).alias("s0"), F.max(speaker).alias("s1"), F.count("*").alias("n"))
        .filter("bad = 0 and i0 = i1 and s0 <> s1 and n > 1").select("root")
        .join(broken_by_edge, "root", "left_anti")
    )
    rows = members.join(kept, "root", "left_semi").select("root", "zgram_id", "timesecs", "sender")
    rows = number(rows, "root", ["timesecs", "zgram_id"], "timesecs")
    starter = rows.filter("zgram_id = root").select("root", F.col("sender").alias("starter"))
    role = F.when(F.col("sender").eqNullSafe(F.col("starter")), "starter").otherwise("responder")
    return rows.join(starter, "root").select(F.col("root").alias("root_id"), F.col("turn").cast("long").alias("turn"),
                                             "zgram_id", role.alias("role"))


def dropped(zgrams: DataFrame, refers_log: DataFrame) -> DataFrame:
    """(zgram_id) of replies that hang on a cycle."""
    return resolve(current_edges(refers_log).filter("zgram_id <> refers_to"))[1].select(F.col("node").alias("zgram_id"))
