"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _to_roots(to: DataFrame) -> DataFrame:
    """(v, m) with every pointer led to the end of its chain: each pass doubles how far it reaches."""
    while True:
        up = to.select(F.col("v").alias("_v"), F.col("m").alias("_m"))
        nxt = cut(to.join(up, to["m"] == up["_v"], "left").select("v", F.coalesce("_m", "m").alias("m"), (F.col("_m") != F.col("m")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return to
        to = nxt.select("v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b): root is the same throughout a component.

    Each round points every node to the least of itself and its neighbours, follows these
    pointers to their ends by doubling, and contracts the edges along them; edges inside a
    merged node vanish.  A least node that nothing points to has a neighbour with a lesser
    label in the next round, so two rounds at least halve what is left: rounds, and the
    doublings inside each, grow with the logarithm of the number of nodes, on paths too.
    Minima are aggregated before the shuffle; joins on a node with many edges are plain
    equi-joins, which adaptive execution splits.
    """
    at = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not at.isEmpty():
        both = at.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(at.select(F.col("b").alias("v"), F.col("a").alias("w")))
        to = _to_roots(cut(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))))
        if roots is None:
            roots = to.select(F.col("v").alias("node"), F.col("m").alias("root"))
        else:
            roots = cut(roots.join(to, roots["root"] == to["v"], "left").select("node", F.coalesce("m", "root").alias("root")))
        left = at.join(to, at["a"] == to["v"]).select(F.col("m").alias("a"), "b")
        moved = left.join(to, left["b"] == to["v"]).select("a", F.col("m").alias("b"))
        at = cut(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if roots is None:
        return at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
