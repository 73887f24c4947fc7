"""Connected components of an edge table, by hooking every node to its smallest neighbour.

All state is tables: nothing about nodes or edges reaches the driver but row
counts and the few heaviest nodes.  Each round maps every node to the smallest
id next to it, jumps once more along those pointers and contracts the edges, so
long chains shrink by a factor and stars vanish at once.  Rounds are stored in
the shared folder.  A node at which a good part of the edges meet is looked up
by broadcast, so its edges are not brought into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.lookups import looked_up
from tidegauge.plans import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node it can reach."""
    rest = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        parents = scratch.cut(_followed(parents, parents))
        steps.append(parents)
        rest = scratch.cut(_contracted(rest, parents))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return scratch.cut(reduce(_followed, steps))


def _followed(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels one pointer further."""
    step = parents.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return looked_up(labels, "root", step, "left").select("node", F.coalesce("_to", "root").alias("root"))


def _contracted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between roots."""
    mapped = looked_up(edges, "a", parents.select(F.col("node").alias("a"), F.col("root").alias("_a")))
    mapped = looked_up(mapped, "b", parents.select(F.col("node").alias("b"), F.col("root").alias("_b"))).where("_a <> _b")
    return mapped.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
