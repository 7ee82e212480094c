"""Groups of requests that touch a common resource, directly or over others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stockline.sources.staging import stage


def conflict_groups(touches: DataFrame, request: str, resource: Sequence[str]) -> DataFrame:
    """``request, _group``: two requests have one group if a chain of shared resources links them.

    Every request starts as its own parent. In a round it learns the smallest
    grandparent among the requests that share a resource with it; it and its old
    parent are hung below that one, and paths are halved. So a chain of n requests
    takes about log2(n) rounds, where handing on the smallest name takes n. The
    names travel over the resources as minima, aggregated before the shuffle, so a
    resource that very many requests touch costs its rows and no pairs. The minima
    are staged, which lets a join with a hot resource be split. A request without
    an id or a resource without a value links nothing; rows without an id are left out.
    """
    keys = list(resource)
    edges = stage(touches.where(F.col(request).isNotNull()).select(request, *keys).distinct(), "touches")
    parents = stage(edges.select(request, F.col(request).alias("_parent")).distinct(), "parents")
    while True:
        above = parents.select(F.col(request).alias("_parent"), F.col("_parent").alias("_grand"))
        known = stage(parents.join(above, "_parent"), "grandparents")
        least = stage(edges.join(known, request).groupBy(*keys).agg(F.min("_grand").alias("_near")), "near")
        near = edges.join(least, keys).groupBy(request).agg(F.min("_near").alias("_near"))
        # One who has no resource with a value meets nobody.
        seen = stage(known.join(near, request, "left").withColumn("_near", F.coalesce("_near", "_grand")), "seen")
        hung = seen.groupBy(F.col("_parent").alias(request)).agg(F.min("_near").alias("_hung"))
        parents = stage(seen.join(hung, request, "left").select(
            request, F.col("_parent").alias("_was"), F.least("_grand", "_near", "_hung").alias("_parent")), "parents")
        if parents.where(F.col("_parent") != F.col("_was")).isEmpty():
            return parents.select(request, F.col("_parent").alias("_group"))
        parents = parents.drop("_was")
