"""Connected components by contraction, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.tables import lookup, written


def _shortcut(parents: DataFrame) -> DataFrame:
    """Let every node point at the root of its tree, halving the depth per round."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = lookup(parents, up, "parent", "left")
        higher = F.coalesce("above", "parent")
        moved = moved.select("node", higher.alias("parent"), (higher != F.col("parent")).alias("moved"))
        parents = written(moved, "component-parents")
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node reached.

    In each round every node points at its least neighbour if that is smaller,
    trees are flattened by pointer doubling, and links are redrawn between the
    roots.  Each round leaves only roots without a smaller neighbour, so few
    rounds are needed even for long chains.  Crowded nodes are aggregated before
    the shuffle and joined by lookups that can be split.
    """
    links, roots = written(links.select("a", "b"), "component-links"), None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parents = _shortcut(written(least.select("node", F.least("node", "near").alias("parent")), "component-least"))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            up = parents.select(F.col("node").alias("root"), "parent")
            roots = lookup(roots, up, "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")
            )
        roots = written(roots, "component-roots")
        for end in ("a", "b"):
            up = parents.select(F.col("node").alias(end), "parent")
            other = "b" if end == "a" else "a"
            links = lookup(links, up, end, "inner").select(F.col("parent").alias(end), other)
        links = written(links.filter("a != b").select("a", "b").distinct(), "component-links")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
