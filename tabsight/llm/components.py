"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``u``, ``v``; longs).

    Each round hooks a node to the neighbour (or itself) that comes first in an order drawn anew
    by hashing, replaces both ends of every edge by their hooks and drops loops and repeats. Hooks
    are minima, so they are pre-aggregated before the shuffle however many edges a hub has; the
    expected number of nodes falls by a constant share a round, so the rounds are few also for
    long chains. Every round is written to the shared checkpoint folder.
    """
    edges = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(hooks))
        rank = lambda c: F.struct(F.xxhash64(c, salt).alias("h"), c.alias("id"))
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        first = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best"))
        hook = stored(first.select(F.col("u").alias("node"),
                                   F.least(F.col("best"), rank(F.col("u")))["id"].alias("to")), "hooks")
        hooks.append(hook)
        moved = (edges.join(hook.withColumnsRenamed({"node": "u", "to": "a"}), "u")
                 .join(hook.withColumnsRenamed({"node": "v", "to": "b"}), "v")
                 .where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        edges = stored(moved, "edges")
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        later = hook.withColumnsRenamed({"node": "component", "to": "__to"})
        found = (found.join(later, "component", "left")
                 .select("node", F.coalesce("__to", "component").alias("component")))
    return stored(found, "components")
