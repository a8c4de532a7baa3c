"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long); root is one node of the component.

    Each round draws a priority for every node, a hash of its id and the round, hooks every node
    to the first of itself and its neighbours, follows that hook once more, and replaces links by
    the distinct links between hooks; a component is done when it has no link left. Only nodes that
    are first among their neighbours can stay hooks of their own, so a constant share of the nodes
    of a component goes in each round whatever its shape: rounds grow with the logarithm of its
    size. Each round is written to the shared folder, which cuts its lineage, and the round before
    is removed; sums are combined before shuffles, and joins on a hot hook can be split.
    Null ends are dropped; an empty table gives an empty result.
    """
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = common.stash(pairs, "links")
    labels, turn = None, 0
    while pairs.take(1):
        def priority(c, turn=turn):
            return F.xxhash64(c, F.lit(turn))

        best = pairs.groupBy("a").agg(F.min_by("b", priority("b")).alias("b"))
        hook = common.stash(best.select("a", F.when(priority("b") < priority("a"), F.col("b")).otherwise(F.col("a")).alias("to")), "hooks")
        far = hook.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        hooked = hook.join(far, "to").select("a", F.col("beyond").alias("to"))
        left = pairs.join(hooked, "a").select(F.col("to").alias("c"), "b")
        both = left.join(hooked.withColumnRenamed("a", "b"), "b").select(F.col("c").alias("a"), F.col("to").alias("b"))
        if labels is None:
            moved, done = hooked.select(F.col("a").alias("node"), F.col("to").alias("root")), [hook, pairs]
        else:
            # Roots of finished components have no link, and so no hook.
            moved = labels.join(hooked.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            done = [hook, pairs, labels]
        labels, pairs = common.stash(moved, "labels"), common.stash(both.filter("a <> b").distinct(), "links")
        common.release(*done)
        turn += 1
    return labels if labels is not None else pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
