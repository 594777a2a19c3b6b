"""Ranks, running sums and running maxima of groups of any size.

Rows are dealt to tasks by ranges of (group, order), numbered inside each task,
and moved on by what the tasks before them hold of the group: a table with a
row per group and task. No group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.graph import settled

#: Bits of monotonically_increasing_id that number the rows of a task.
_ROWS = (1 << 33) - 1


def _dealt(rows: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """Rows with their task (_part) and place in it (_at), in order; written down, so that both stay."""
    keys = [F.col(c).asc() for c in by] + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settled(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_ROWS).alias("_at")))


def _joined(rows: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside their group's and task's row of ``heads``; groups may be null."""
    named = heads.withColumnsRenamed({c: f"_h_{c}" for c in [*by, "_part"]})
    on = F.col("_part") == F.col("_h__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return rows.join(named, on).drop(*[f"_h_{c}" for c in [*by, "_part"]])


def _before(by: list[str]):
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task


def numbered(rows: DataFrame, order: list[Column], *by: str, name: str = "place") -> DataFrame:
    """``rows`` with their row number in the group; ``order`` should leave no ties."""
    by = list(by)
    placed = _dealt(rows, order, by)
    heads = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    heads = heads.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(by)), F.lit(0)))
    number = F.col("_at") - F.col("_first") + F.col("_offset") + 1
    return _joined(placed, heads, by).withColumn(name, number).drop("_part", "_at", "_first", "_n", "_offset")


def running(rows: DataFrame, value: Column, order: list[Column], *by: str, name: str, largest: bool = False) -> DataFrame:
    """``rows`` with the sum (or the largest) of ``value`` over the group's rows up to and with each."""
    by, f = list(by), F.max if largest else F.sum
    placed = _dealt(rows.withColumn("_v", value), order, by)
    here = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # what one task holds
    heads = placed.groupBy(*by, "_part").agg(f("_v").alias("_all")).withColumn("_carry", f("_all").over(_before(by)))
    inside = f("_v").over(here)
    whole = F.greatest(inside, F.col("_carry")) if largest else inside + F.coalesce("_carry", F.lit(0))
    return _joined(placed, heads, by).withColumn(name, whole).drop("_part", "_at", "_v", "_all", "_carry")
