"""Ranks inside groups without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import cut


def ranked(rows: DataFrame, group: list[str], order: list[Column], numbered: bool = False) -> DataFrame:
    """`rows` with `rank` (from 0, in its group) and `size` (of its group), both long; `numbered` adds `number`, the group's place
    among all groups, ascending with NULL first.

    Rows are dealt by ranges of (group, order, a drawn number), so a group with most of the rows, or a row repeated that often,
    spans many tasks. A rank is the place in a task plus what earlier tasks hold of the group: one row per task and group. The
    sorted rows are written to the shared folder, which fixes their places. Rows equal in `order` are ranked in any order."""
    keys = [F.col(c).asc_nulls_first() for c in group] + order + [F.rand(11)]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), needed=True)
    task = F.shiftright("place", 33).alias("task")
    runs = cut(placed.groupBy(task, *group).agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("held")))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("held").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("task", *group, "begin", before.alias("before"), F.sum("held").over(whole).alias("size"))
    if numbered:   # groups are in order within a task and over tasks, so a group's number counts the groups that began before it
        inside = Window.partitionBy("task").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        new = F.when(F.col("before") == 0, 1).otherwise(0)
        runs = runs.withColumn("nth", F.coalesce(F.sum(new).over(inside), F.lit(0)))
        begun = runs.groupBy("task").agg(F.sum(new).alias("begun"))   # a row for each task
        earlier = F.coalesce(F.sum("begun").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = runs.join(begun.select("task", earlier.alias("earlier")), "task")
        runs = runs.withColumn("number", F.max(F.when(F.col("before") == 0, F.col("earlier") + F.col("nth"))).over(whole)).drop("nth", "earlier")
    joined = _same(placed.withColumn("task", F.shiftright("place", 33)), runs, ["task", *group])
    return joined.withColumn("rank", F.col("place") - F.col("begin") + F.col("before")).drop("task", "place", "begin", "before")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, NULL being equal to NULL."""
    other = right.select(*(F.col(c).alias(f"other_{c}" if c in keys else c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in keys]
    return left.join(other, on).drop(*(f"other_{c}" for c in keys))
