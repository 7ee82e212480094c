"""Running totals that hold for groups of any size.

``Window.partitionBy(keys)`` puts a whole group in one task. That is right for
ordinary groups, but one product may own a third of all rows, and a total over
the whole table has only one group. Large groups are therefore range-partitioned
by their order, summed per partition, and shifted by the totals of the
partitions before them.

Both forms give the same result; which one a group takes depends only on its
row count. ``order`` must be unique within a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockline.sources.staging import stage

# Rows of one group that a single task sorts and sums without strain.
HOT_ROWS = 5_000_000

_PART = "_range_part"


def _window(keys: Sequence[str], order: Sequence[Column], *, before: bool):
    end = -1 if before else Window.currentRow
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    floors: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None | bool = True,
) -> DataFrame:
    """Add, for each ``sums`` entry, the total over the group's rows *before* this one.

    ``floors`` maps an output name to an expression over the group's running
    total *including* this row, named by the single ``sums`` entry plus
    ``_incl``; the output is the smallest value of it so far, this row included.

    ``hot`` may hold the answer of ``hot_groups`` for the same or more rows, so
    that an iterative caller looks for large groups only once.
    """
    if not keys or hot_rows <= 0:
        return _ranged(df, keys, order, sums, floors)
    if hot is True:
        hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return _windowed(df, keys, order, sums, floors)
    # At most rows / hot_rows groups are hot; the optimiser sees the staged
    # size and broadcasts it only when it is small.
    same = _same(df, hot, keys)
    cold = df.join(hot, same, "left_anti")
    large = df.join(hot, same, "left_semi")
    return _windowed(cold, keys, order, sums, floors).unionByName(_ranged(large, keys, order, sums, floors))


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None when there are none."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = stage(sizes.where(F.col("_n") > hot_rows).drop("_n"), "hot-groups")
    return None if hot.isEmpty() else hot


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def _windowed(df, keys, order, sums, floors):
    before = _window(keys, order, before=True)
    out = df.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).cast("decimal(28,4)").alias(n)
                           for n, v in sums.items()])
    return _typed(_with_floors(out, keys, order, sums, floors), df, sums)


def _with_floors(out, keys, order, sums, floors):
    if not floors:
        return out
    (name, value), = sums.items()
    out = out.withColumn(f"{name}_incl", F.col(name) + F.coalesce(value, F.lit(0)))
    upto = _window(keys, order, before=False)
    return out.select("*", *[F.min(expr).over(upto).alias(n) for n, expr in floors.items()]).drop(f"{name}_incl")


def _typed(out, df, sums):
    """Totals of whole numbers are bigint, totals of money keep four decimals."""
    kinds = dict(df.select(*[F.sum(v).alias(n) for n, v in sums.items()]).dtypes)
    return out.withColumns({n: F.col(n).cast("bigint") for n in sums if kinds[n] == "bigint"})


def _ranged(df, keys, order, sums, floors):
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = df.repartitionByRange(tasks, *[F.col(k) for k in keys], *order).withColumn(
        _PART, F.spark_partition_id()
    )
    # Range bounds are sampled, so partition numbers are fixed by writing them.
    fixed = stage(marked, "ranged")

    # Only groups that begin or end a range can continue in the next one. There
    # are at most two of them per range, whatever the data.
    if keys:
        key = F.struct(*keys)
        edges = (
            fixed.groupBy(_PART)
            .agg(F.array(F.min(key), F.max(key)).alias("k"))
            .select(F.explode("k").alias("k")).select("k.*").distinct()
        )
        spanning = fixed.join(F.broadcast(edges), _same(fixed, edges, keys), "left_semi")
    else:
        spanning = fixed
    parts = spanning.groupBy(*keys, _PART).agg(
        *[F.coalesce(F.sum(v), F.lit(0)).cast("decimal(28,4)").alias(n) for n, v in sums.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, _PART, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )
    local = [*keys, _PART]
    before = _window(local, order, before=True)
    inside = fixed.select("*", *[
        F.coalesce(F.sum(v).over(before), F.lit(0)).cast("decimal(28,4)").alias(n) for n, v in sums.items()
    ])
    joined = _shift(inside, offsets, keys, sums)
    if floors:
        joined = _ranged_floors(joined, keys, order, sums, floors)
    return _typed(joined.drop(_PART), df, sums)


def _shift(inside: DataFrame, offsets: DataFrame, keys, sums) -> DataFrame:
    """Add the totals of earlier ranges; at most two offsets per range are broadcast."""
    same = _same(inside, offsets, [*keys, _PART])
    wide = inside.join(F.broadcast(offsets), same, "left")
    kept = [inside[c] for c in inside.columns if c not in sums]
    return wide.select(*kept, *[
        (inside[n] + F.coalesce(offsets[f"_before_{n}"], F.lit(0))).cast("decimal(28,4)").alias(n) for n in sums
    ])


def _ranged_floors(df: DataFrame, keys, order, sums, floors) -> DataFrame:
    """Running minimum across ranges: the minimum of earlier ranges, then inside this one."""
    (name, value), = sums.items()
    df = stage(df.withColumn(f"{name}_incl", F.col(name) + F.coalesce(value, F.lit(0))), "floors")
    local = [*keys, _PART]
    upto = _window(local, order, before=False)
    inside = df.select("*", *[F.min(e).over(upto).alias(n) for n, e in floors.items()])
    # Minima of groups that lie in one range are never needed by another.
    parts = df.groupBy(*local).agg(*[F.min(e).alias(n) for n, e in floors.items()])
    every = Window.partitionBy(*keys)
    earlier = every.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    mins = (
        parts.select(*local, F.count("*").over(every).alias("_ranges"),
                     *[F.min(n).over(earlier).alias(f"_before_{n}") for n in floors])
        .where(F.col("_ranges") > 1).drop("_ranges")
    )
    wide = inside.join(F.broadcast(mins), _same(inside, mins, local), "left")
    kept = [inside[c] for c in inside.columns if c not in floors and c != f"{name}_incl"]
    return wide.select(*kept, *[F.least(inside[n], mins[f"_before_{n}"]).alias(n) for n in floors])
