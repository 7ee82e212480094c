"""Subtree totals of a forest by parallel tree contraction, with DataFrame operations only.

Each round compresses and rakes. Compress takes every node with a single child and finds,
by pointer doubling in joins, the first node below it that has none or several, together
with the sum of the values passed on the way; the chain then disappears and its lower end
hangs below the parent of its upper end. Rake takes all leaves, whose totals are known by
then, and adds them to their parents. What is left are branching nodes, fewer than the
leaves that went: a round leaves at most half of the nodes, whatever the tree's shape.
Afterwards the rounds are undone last to first: a chain node's total is the sum down to
the end of its chain plus the total of that end.

No node's children are ever collected: leaves are summed per parent by partial aggregates,
and all frames that are joined are written tables, so that adaptive execution may split a
parent or a chain that holds much of the table.

Defined results: a node without a parent is a root; one whose parent is not in the table
is not allowed, nor are repeated ids or cycles (an error, once a chain is longer than the
table); an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stockline.llm.store import keep


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _with_children(active: DataFrame, values: list[str]) -> DataFrame:
    """Each node with its number of children, one of them, and its children's lifts added to its values."""
    kids = active.where("parent IS NOT NULL").groupBy("parent").agg(
        F.count("*").alias("kids"), F.min("id").alias("kid"), *[F.sum(f"lift_{v}").alias(f"up_{v}") for v in values]).withColumnRenamed("parent", "of")
    return active.join(kids, active["id"] == kids["of"], "left").select(
        "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), "kid", *[(F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values])


def _chains(tagged: DataFrame, values: list[str]) -> DataFrame:
    """Per node with one child: the ``end`` of its chain below, and the sums of the values down to there; made of written tables."""
    now = tagged.where("kids = 1").select("id", F.col("kid").alias("next"), *values)
    done: list[DataFrame] = []
    span, most = 1, now.count()
    while span <= 4 * most or not most:
        if now.isEmpty():
            return _union(done).withColumnRenamed("next", "end") if done else now.withColumnRenamed("next", "end")
        below = _union([*done, now]).select(F.col("id").alias("at"), F.col("next").alias("then"), *[F.col(v).alias(f"more_{v}") for v in values])
        jumped, _ = keep(now.join(below, now["next"] == below["at"], "left").select(
            "id", F.coalesce("then", "next").alias("next"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values],
            F.col("at").isNull().alias("ended")), "jumped")
        done.append(jumped.where("ended").drop("ended"))
        now = jumped.where("NOT ended").drop("ended")
        span *= 2
    raise ValueError("the parents form a cycle")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and, for each of ``values`` (longs), its sum over the subtree of ``id``; ``nodes`` has ``id, parent`` (longs) too."""
    active = nodes.select("id", "parent", *values, *[F.lit(0).cast("long").alias(f"lift_{v}") for v in values])
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        tagged, _ = keep(_with_children(active, values), "tree")
        if tagged.isEmpty():
            break
        chains = _chains(tagged, values)
        links = tagged.where("kids = 1")
        upper = links.join(links.select(F.col("kid").alias("lower")), F.col("id") == F.col("lower"), "left_anti").select(F.col("id").alias("top"), F.col("parent").alias("above"))
        tops = upper.join(chains, upper["top"] == chains["id"]).select("end", "above", *[F.col(v).alias(f"lift_{v}") for v in values])
        rest = tagged.where("kids <> 1")
        hung, _ = keep(rest.join(tops, rest["id"] == tops["end"], "left").select(
            "id", "kids", F.when(F.col("end").isNull(), F.col("parent")).otherwise(F.col("above")).alias("parent"), *values,
            *[F.coalesce(f"lift_{v}", F.lit(0)).alias(f"lift_{v}") for v in values]), "compressed")
        leaves = hung.where("kids = 0")
        given = leaves.where("parent IS NOT NULL").groupBy("parent").agg(*[F.sum(F.col(v) + F.col(f"lift_{v}")).alias(f"up_{v}") for v in values]).withColumnRenamed("parent", "of")
        inner = hung.where("kids > 1")
        active = inner.join(given, inner["id"] == given["of"], "left").select(
            "id", "parent", *[(F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values], *[f"lift_{v}" for v in values])
        rounds.append((chains, leaves.select("id", *values)))
    if not rounds:
        return nodes.select("id", *values).limit(0)
    known: list[DataFrame] = []
    for chains, leaves in reversed(rounds):
        known.append(leaves)
        ends = _union(known).select(F.col("id").alias("at"), *[F.col(v).alias(f"more_{v}") for v in values])
        undone, _ = keep(chains.join(ends, chains["end"] == ends["at"]).select("id", *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in values]), "expanded")
        known.append(undone)
    return _union(known)
