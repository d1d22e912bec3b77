"""Connected components by repeated contraction, all state in written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of every vertex of ``edges`` (a, b): label is the smallest key reachable.

    Each round hooks every vertex to its smallest neighbour or itself and
    contracts the edges to the hooks, so hubs cost a partial minimum and not a
    list of neighbours. The rounds' hooks, composed, are the labels; the number
    of rounds grows with the logarithm of the longest path. No edges: no rows.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialise(live, "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hook = both.groupBy("v").agg(F.min("w").alias("h")).select("v", F.least("v", "h").alias("h"))
        hooks.append(materialise(hook, "hooks"))
        h = hooks[-1]
        moved = (
            live.join(h.select(F.col("v").alias("a"), F.col("h").alias("ha")), "a")
            .join(h.select(F.col("v").alias("b"), F.col("h").alias("hb")), "b")
            .where("ha <> hb")
            .select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
            .distinct()
        )
        live = materialise(moved, "edges")
    if not hooks:
        return live.select(F.col("a").alias("key"), F.col("b").alias("label"))

    def follow(labels: DataFrame, hook: DataFrame) -> DataFrame:
        return labels.join(hook.select(F.col("v").alias("label"), "h"), "label", "left").select("key", F.coalesce("h", "label").alias("label"))

    first = hooks[0].select(F.col("v").alias("key"), F.col("h").alias("label"))
    return materialise(reduce(follow, hooks[1:], first), "labels")
