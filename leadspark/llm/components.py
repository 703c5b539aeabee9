"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers, and
    contracts the edges to the parents; nodes that are not the smallest of their
    neighbourhood vanish, so rounds grow with the logarithm of the path length.
    Loops and repeated edges are allowed; nulls are ignored; without edges the
    result is empty.
    """
    live = work.table(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    labels, held = None, None  # held is the written table behind labels
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = work.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        parent = first
        for _ in range(2):
            next_up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = parent.join(next_up, "up").select("node", F.col("top").alias("up"))
        parent = work.table(parent, "jumped")
        work.done(first)
        a = parent.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        fewer = live.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        fewer = work.table(fewer, "edges")
        work.done(live)
        live = fewer
        if labels is None:
            labels, held = parent.select("node", F.col("up").alias("root")), parent
        else:
            to = parent.select(F.col("node").alias("root"), "up")
            labels = work.table(labels.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            work.done(held, parent)
            held = labels
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
