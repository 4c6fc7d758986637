"""Connected components of a table of links, by contraction under a new random order in each round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import cut, in_batches


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, top) of few links, top the smallest node of the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
        nodes = list(top)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "top"])

    return in_batches(edges.coalesce(1), run, "node long, top long")


def components(links: DataFrame, *, in_task: int = 100_000) -> DataFrame:
    """(node, comp) for every end of a link (a, b), a != b; comp is the smallest node that can be reached.

    Each round maps each node to the first of itself and its neighbours, in an order hashed anew with the round's
    number (one to one, so no two are equal), and replaces both ends of every link by what they map to. The last node
    of a component in that order is nobody's choice, so each round takes at least one node from each component, and on
    average a constant part of its nodes whatever its shape. Once at most `in_task` rows of links are left (counted, both
    directions) one task joins them. The rounds' maps shrink too and are composed from the last to the first. All of it
    is cut to shared storage; no list of links reaches the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    edges = cut(both)
    maps: list[DataFrame] = []
    while (left := edges.count()) > in_task:
        place = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: B023, E731
        near = edges.groupBy(F.col("a").alias("node")).agg(F.min_by("b", place("b")).alias("near"))
        step = cut(near.select("node", F.when(place("node") < place("near"), F.col("node")).otherwise(F.col("near")).alias("top")))
        maps.append(step)
        to = lambda side: step.select(F.col("node").alias(side), F.col("top").alias(f"to_{side}"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b")
        edges = cut(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    if not maps:
        return cut(_in_one_task(edges).select("node", F.col("top").alias("comp")))
    tops = cut(_in_one_task(edges)) if left else maps.pop()
    while maps:
        further = tops.select(F.col("node").alias("top"), F.col("top").alias("further"))
        tops = cut(maps.pop().join(further, "top", "left").select("node", F.coalesce("further", "top").alias("top")))
    names = tops.groupBy("top").agg(F.min("node").alias("comp"))
    return cut(tops.join(names, "top").select("node", "comp"))
