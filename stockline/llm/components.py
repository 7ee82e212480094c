"""Connected components of an edge table, with DataFrame operations only.

Rounds of large-star and small-star: every vertex hands its larger neighbours to
its smallest one, then its smaller ones. Edges shrink to stars around the smallest
vertex of each component, in about the logarithm of the component's size. No round
collects a vertex's neighbours: the minimum is a partial aggregate. Minima are written
before they are joined back to the edges: adaptive execution splits the partition of a
hub only where both sides of the join come straight from a shuffle, not from an
aggregate. Each round's tables are removed after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockline.llm.store import forget, keep


def minima(edges: DataFrame) -> DataFrame:
    """``a, m``: the smallest of each vertex and its neighbours."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def towards_minimum(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """Every edge ``a, b`` with the ``m`` of its ``a``; ``smallest`` is a written table."""
    return edges.join(smallest, "a")


def _star(edges: DataFrame) -> tuple[DataFrame, str]:
    """One round, written; its own tables are removed."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near, near_path = keep(minima(both), "minima")
    large = towards_minimum(both, near).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large, large_path = keep(large, "large-star")
    forget(spark, near_path)
    low, low_path = keep(minima(large), "minima")
    moved = towards_minimum(large, low).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    out = keep(moved.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
    forget(spark, large_path)
    forget(spark, low_path)
    return out


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(id, component)`` for every vertex that is not the smallest of its component.

    Vertices may be of any type with an order. Rows with a null end and loops are
    ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    clean = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"{left} IS NOT NULL AND {right} IS NOT NULL AND a <> b").distinct()
    now, path = keep(clean, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(CAST(xxhash64(b, a) AS DECIMAL(38, 0)))")).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = state
        after, fresh = _star(now)
        forget(spark, path)
        now, path = after, fresh
