"""Connected components by contraction, on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlife.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is one node of its component.

    Each round hooks every node to its smallest neighbour, follows those hooks
    to their ends by doubling, and replaces nodes by the ends in all links. A
    round leaves local minima only, at most half of the nodes, so the number
    of rounds is logarithmic however long the chains are. Neighbours are never
    listed, only their minimum is taken. Links may repeat; null ends and links
    of a node to itself are left out. Only one number a step reaches the driver.
    """
    left = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "hooks")
        while True:
            on = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hooks = stored(hooks.join(on, "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
        hooks = hooks.select("node", "up")
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("root"))
        else:
            onward = hooks.select(F.col("node").alias("root"), "up")
            roots = stored(roots.join(onward, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        a, b = hooks.select(F.col("node").alias("a"), F.col("up").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = left.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = stored(moved.distinct(), "links")
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots
