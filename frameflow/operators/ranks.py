"""Exact order statistics without one task for all values of a group.

Equal values are counted first, the counted values are sorted by range over all tasks and stored, and each value's rank is its place within its part plus
the counts of the parts before it, of which there are as many as tasks (and keys). A hot group is spread like any other; what meets in
one task is one range of distinct values.

Defined results: null values and NaN count for nothing; a group of nulls only has null statistics where it is asked for beside others, and no row else; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameflow.sources.store import table

#: Ranks that one part of a lookup spans; a target meets as many values at most.
SPAN = 64


def ranked(rows: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """The distinct values of each group (null keys are a group) with how often they stand (n), how many values are smaller (before) and how many there
    are in all (total). A table that is stored once; names of the result: keys, value, n, before, total."""
    column = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = rows.select(*keys, column.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    sorted_ = counts.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id())
    kept = table(sorted_, "ranked")
    parts = kept.groupBy(*keys, "part").agg(F.sum("n").alias("own"), F.min("value").alias("least"))
    group = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    offset = F.sum("own").over(group.orderBy("least").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    starts = parts.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("part").alias("s_part"), offset.alias("start"), F.sum("own").over(group).alias("total"))
    near = kept.select("*", F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    same = F.col("part") == F.col("s_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    return near.join(starts, same).select(*keys, "value", "n", (F.col("start") + F.col("upto") - F.col("n")).alias("before"), "total")


def between(lower: Column, upper: Column, place: Column) -> Column:
    """The value at a place (counted from 0) that may lie between two ranks."""
    return lower + (upper - lower) * (place - F.floor(place))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str | Column, fractions: Mapping[str, float]) -> DataFrame:
    """One row for each group: keys, n and the interpolated quantile under each name. The ranks asked for are picked by one pre-aggregated grouping."""
    r = ranked(rows, keys, value)
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))
    place = {name: (F.col("total") - 1) * F.lit(float(f)) for name, f in fractions.items()}
    found = r.groupBy(*keys, "total").agg(*[c for name, p in place.items() for c in (at(F.floor(p)).alias(f"{name}_a"), at(F.ceil(p)).alias(f"{name}_b"))]) if keys else r.groupBy("total").agg(*[c for name, p in place.items() for c in (at(F.floor(p)).alias(f"{name}_a"), at(F.ceil(p)).alias(f"{name}_b"))])
    return found.select(*keys, F.col("total").alias("n"), *[between(F.col(f"{name}_a"), F.col(f"{name}_b"), p).alias(name) for name, p in place.items()])


def values_at(counted: DataFrame, targets: DataFrame, rank: str, name: str) -> DataFrame:
    """targets with the value of the given rank (0 is the smallest) among all values of a ranked() table without keys. Ranks are met in blocks of SPAN,
    so that this is an equi-join in which a target sees SPAN values at most."""
    c = F.col
    blocks = counted.select(c("value").alias("v_value"), c("before").alias("v_before"), (c("before") + c("n")).alias("v_after")).withColumn("v_block", F.explode(F.sequence(F.floor(c("v_before") / SPAN), F.floor((c("v_after") - 1) / SPAN))))
    asked = targets.withColumn("t_block", F.floor(c(rank) / SPAN))
    return asked.join(blocks, (c("t_block") == c("v_block")) & (c(rank) >= c("v_before")) & (c(rank) < c("v_after")), "left").select(*targets.columns, c("v_value").alias(name))


def left_out_quantiles(rows: DataFrame, fold: str, value: str, fractions: Mapping[str, float]) -> DataFrame:
    """For each fold the quantiles of all values outside it (null if there are none). Only the pooled values are ranked; a fold's own values shift
    the ranks: the value of rank r outside the fold is the pooled one of rank r plus the fold's values that come before it. How many those are is
    found among the fold's own values, each of which knows how many values outside stand up to it. Every row is used once, whatever the number of folds."""
    pooled = ranked(rows, [], value)
    clean = rows.select(F.col(fold).alias("fold"), F.col(value).cast("double").alias("value"))
    own = clean.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("fold", "value").agg(F.count("*").alias("own"))
    met = own.join(pooled, "value")
    upto = Window.partitionBy("fold").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    steps = met.select("fold", (F.col("before") + F.col("n") - F.sum("own").over(upto)).alias("outside"), F.sum("own").over(upto).alias("inside"), "own", "total")
    size = steps.groupBy("fold").agg(F.sum("own").alias("m"), F.max("total").alias("total"))
    every = clean.select("fold").distinct().join(size, "fold", "left").select("fold", F.coalesce("m", F.lit(0)).alias("m"), "total").crossJoin(F.broadcast(pooled.agg(F.max("total").alias("everything"))))
    sizes = every.select("fold", (F.coalesce("total", "everything") - F.col("m")).alias("rest"))
    place = {name: (F.col("rest") - 1) * F.lit(float(f)) for name, f in fractions.items()}
    asked = sizes.where("rest > 0").select("fold", "rest", F.explode(F.array(*[F.struct(F.lit(f"{name}_{side}").alias("which"), g(p).alias("r")) for name, p in place.items() for side, g in (("a", F.floor), ("b", F.ceil))])).alias("t")).select("fold", "rest", "t.*")
    # the fold's own values that come before the wanted one: those with at most r values outside up to them
    shift = asked.join(steps.select("fold", "outside", "inside"), "fold", "left").groupBy("fold", "rest", "which", "r").agg(F.coalesce(F.max(F.when(F.col("outside") <= F.col("r"), F.col("inside"))), F.lit(0)).alias("shift"))
    found = values_at(pooled, shift.withColumn("rank", F.col("r") + F.col("shift")), "rank", "v")
    wide = found.groupBy("fold", "rest").agg(*[F.max(F.when(F.col("which") == f"{name}_{s}", F.col("v"))).alias(f"{name}_{s}") for name in fractions for s in "ab"])
    return sizes.select("fold", F.col("rest").alias("n")).join(wide.drop("rest").withColumnRenamed("fold", "w_fold"), F.col("fold").eqNullSafe(F.col("w_fold")), "left").select(
        F.col("fold").alias(fold), "n", *[between(F.col(f"{name}_a"), F.col(f"{name}_b"), (F.col("n") - 1) * F.lit(float(f))).alias(name) for name, f in fractions.items()])
