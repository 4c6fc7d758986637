"""Trees by their Euler tour: places, depths, ancestor tests and lowest common ancestors in rounds logarithmic in the nodes.

A tour enters and leaves each node once. Every entry and exit knows the next one; pointer doubling gives its distance from
the end and the sum of +1 for entries and -1 for exits on the way, so a chain of 5,000 nodes takes 14 rounds. A node's
descendants are those entered between its own entry and exit. Siblings are ordered by ranks of sorted ranges, so a parent
with a third of all nodes is no single task. Rows stay linear in the nodes (times the logarithm of the depth for `lifts`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.operators.blocks import numbered
from apiloom.session import Scratch, cut


def tree_intervals(tree: DataFrame) -> DataFrame:
    """(agent_id, parent_id, depth, enter, leave) of a forest with unique ids: places on its tour, from 0.

    Rows on parent cycles or under a missing parent are left out: no root reaches them."""
    with Scratch(tree.sparkSession) as keep:
        rows = numbered(tree.select("agent_id", "parent_id").where("agent_id IS NOT NULL"), "parent_id", "agent_id", name="place")
        rows = keep(rows)
        following = rows.select((F.col("place") - 1).alias("place"), F.col("agent_id").alias("sibling"), F.col("parent_id").alias("of"))
        first = rows.groupBy("parent_id").agg(F.min(F.struct("place", "agent_id")).alias("child")).select(F.col("parent_id").alias("agent_id"), F.col("child.agent_id").alias("child"))
        known = rows.join(following, "place", "left").withColumn("sibling", F.when(F.col("of").eqNullSafe(F.col("parent_id")), F.col("sibling"))).join(first, "agent_id", "left")
        stop = F.col("sibling").isNull() & F.col("parent_id").isNull()
        enter = F.struct(F.lit(True).alias("into"), F.col("agent_id").alias("node"), F.col("child").isNotNull().alias("to_into"), F.coalesce("child", "agent_id").alias("to"), F.lit(False).alias("ended"))
        leave = F.struct(F.lit(False).alias("into"), F.col("agent_id").alias("node"), F.col("sibling").isNotNull().alias("to_into"), F.coalesce("sibling", "parent_id", "agent_id").alias("to"), stop.alias("ended"))
        step = known.select(F.inline(F.array(enter, leave)))
        step = keep(step.select("into", "node", "to_into", "to", "ended", F.lit(1).cast("long").alias("far"), F.when(F.col("into"), 1).otherwise(-1).cast("long").alias("sum")))
        count, turn = step.count(), 0
        while count and turn <= math.ceil(math.log2(count)) + 1:
            going = step.where("NOT ended")
            if going.isEmpty():
                break
            ahead = step.select(F.col("into").alias("to_into"), F.col("node").alias("to"), F.col("to_into").alias("into2"), F.col("to").alias("to2"), F.col("ended").alias("ended2"), F.col("far").alias("far2"), F.col("sum").alias("sum2"))
            moved = going.join(ahead, ["to_into", "to"]).select("into", "node", F.col("into2").alias("to_into"), F.col("to2").alias("to"), F.col("ended2").alias("ended"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"))
            step, turn = keep(step.where("ended").unionByName(moved)), turn + 1
        done = step.where("ended")
        whole = done.agg(F.max("far")).first()[0] or 0
        places = done.groupBy(F.col("node").alias("agent_id")).agg(
            F.max(F.when(F.col("into"), -F.col("sum"))).cast("int").alias("depth"), (whole - F.max(F.when(F.col("into"), F.col("far")))).alias("enter"), (whole - F.max(F.when(~F.col("into"), F.col("far")))).alias("leave")
        )
        return cut(rows.join(places, "agent_id").select("agent_id", "parent_id", "depth", "enter", "leave"))


def lifts(intervals: DataFrame) -> list[DataFrame]:
    """(agent_id, up) for each k: the ancestor 2^k steps up, for nodes that have one."""
    deepest = intervals.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return []
    out = [cut(intervals.where("depth > 0").select("agent_id", F.col("parent_id").alias("up")))]
    while 2 ** len(out) <= deepest:
        last = out[-1]
        out.append(cut(last.join(last.select(F.col("agent_id").alias("up"), F.col("up").alias("further")), "up").select("agent_id", F.col("further").alias("up"))))
    return out


def _with_places(pairs: DataFrame, intervals: DataFrame, *names: str) -> DataFrame:
    for n in names:
        pairs = pairs.join(intervals.select(F.col("agent_id").alias(n), F.col("enter").alias(f"{n}_in"), F.col("leave").alias(f"{n}_out")), n)
    return pairs


def is_descendant(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """The pairs (ancestor, node) with `descendant`: a range test of their places. Pairs of unknown nodes are false."""
    known = _with_places(pairs.select("ancestor", "node").distinct(), intervals, "ancestor", "node")
    below = known.where("ancestor_in < node_in AND node_out < ancestor_out").select("ancestor", "node", F.lit(True).alias("below"))
    same = pairs["ancestor"].eqNullSafe(below["ancestor"]) & pairs["node"].eqNullSafe(below["node"])
    return pairs.join(below, same, "left").select(pairs["*"], F.coalesce("below", F.lit(False)).alias("descendant"))


def lowest_common_ancestor(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """(a, b, lca) for pairs of known nodes: a rises by the largest steps that do not yet hold b below it; null without one."""
    ups = lifts(intervals)
    state = _with_places(pairs.select("a", "b"), intervals, "a", "b").withColumns({"at": F.col("a"), "at_in": F.col("a_in"), "at_out": F.col("a_out")}).drop("a_in", "a_out")
    state = cut(state)
    holds = lambda i, o: (F.col(i) <= F.col("b_in")) & (F.col("b_out") <= F.col(o))
    for k in reversed(range(len(ups))):
        placed = ups[k].join(intervals.select(F.col("agent_id").alias("up"), F.col("enter").alias("up_in"), F.col("leave").alias("up_out")), "up")
        both = state.join(placed.withColumnRenamed("agent_id", "at"), "at", "left")
        rise = F.col("up").isNotNull() & ~holds("at_in", "at_out") & ~holds("up_in", "up_out")
        new = {c: F.when(rise, F.col(u)).otherwise(F.col(c)).alias(c) for c, u in (("at", "up"), ("at_in", "up_in"), ("at_out", "up_out"))}
        state = cut(both.select("a", "b", "b_in", "b_out", *new.values()))
    parent = intervals.select(F.col("agent_id").alias("at"), "parent_id")
    return state.join(parent, "at").select("a", "b", F.when(holds("at_in", "at_out"), F.col("at")).otherwise(F.col("parent_id")).alias("lca"))
