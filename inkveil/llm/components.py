"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stored

JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)`` of BIGINTs: the least node that can be reached.

    Every round each node takes the least of itself and its neighbours, follows
    that pointer a few steps on, and links are redrawn between what the nodes
    have become; links within one vanish.  Paths shrink by a power of two a
    round.  A node in a third of all links costs no more: minima are taken per
    task first, and joins on it can be split.  Each round is stored.
    """
    edges = stored(_both(links.filter("a <> b")), "links")
    found = None
    while edges.limit(1).count():
        near = edges.groupBy("a").agg(F.min("b").alias("b"))
        step = stored(near.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "links")
        for _ in range(JUMPS):
            further = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
            step = step.join(further, "to", "left").select("node", F.coalesce("on", "to").alias("to"))
        step = stored(step, "links")
        if found is None:
            found = step.select("node", F.col("to").alias("component"))
        else:
            later = step.select(F.col("node").alias("component"), "to")
            found = found.join(later, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        found = stored(found, "links")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y")
        edges = stored(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def _both(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionByName(turned).distinct()
