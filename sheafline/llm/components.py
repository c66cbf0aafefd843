"""Connected components of links between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Components at least halve in a round and paths in a step, so this is beyond any table.
MOST_ROUNDS = 200


def _rooted(parents: DataFrame, name: str) -> DataFrame:
    """parents(node, component) with the root that parents lead to; paths shrink by half in a step."""
    for _ in range(MOST_ROUNDS):
        up = parents.select(F.col("node").alias("component"), F.col("component").alias("up"))
        after = stored(parents.join(up, "component").select("node", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("moved")), name)
        still = after.filter("moved").isEmpty()
        release(parents)
        parents = after.select("node", "component")
        parents._stored_at = after._stored_at
        if still:
            return parents
    raise RuntimeError(f"parents didn't settle in {MOST_ROUNDS} rounds")


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links(a long, b long) -> (node long, component long), the smallest node of each component.

    Every round hooks each component to its least neighbour, follows these to
    the roots, and keeps only the links between what is still apart, so links
    are read about once; each step is a table in the shared folder, so a lost
    executor costs one step at most.  Only linked nodes take part.  No null
    nodes; loops and repeated links are harmless.  An empty table gives an
    empty result.  What is returned is a stored() table; those of earlier
    rounds are deleted.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    for _ in range(MOST_ROUNDS):
        ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = _rooted(stored(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-hooks"), f"{name}-hooks")
        if labels is None:
            after = hooks
        else:
            up = hooks.select(F.col("node").alias("component"), F.col("component").alias("up"))
            after = stored(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), f"{name}-labels")
            release(labels)
        of = lambda s: hooks.select(F.col("node").alias(s), F.col("component").alias(f"{s}_up"))
        left = edges.join(of("a"), "a").join(of("b"), "b").filter("a_up <> b_up")
        rest = stored(left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), f"{name}-links")
        release(edges, *([] if after is hooks else [hooks]))
        labels, edges = after, rest
        if edges.isEmpty():
            release(edges)
            return labels
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
