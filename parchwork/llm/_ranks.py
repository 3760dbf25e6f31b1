"""Gapless numbers within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.plans.session import materialize

#: Low bits of `monotonically_increasing_id`: the row's place in its partition.
_PLACE = (1 << 33) - 1


def ordered(df: DataFrame, group: str, order: list[Column], label: str) -> tuple[DataFrame, DataFrame]:
    """`df` written in order of `group` and `order`, each row with its range `__range` and place `__place` there; and for
    each group and range in which it stands the number of rows `__n` and the place `__least` of the first.

    Ranges cut groups wherever their sizes ask for it; rows that tie are told apart by where they were read, so equal
    rows are dealt over ranges too. The second table has no more rows than there are groups and ranges together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order, F.col("__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    placed = ranged.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(_PLACE)})
    rows = materialize(placed, label)
    return rows, rows.groupBy(group, "__range").agg(F.count("*").alias("__n"), F.min("__place").alias("__least"))


def numbered(df: DataFrame, group: str, order: list[Column], name: str, label: str) -> DataFrame:
    """`df` with `name`, each row's number from 0 in its group, in `order`; `group` has no nulls."""
    rows, parts = ordered(df, group, order, label)
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are groups and ranges
    starts = F.broadcast(parts.select(group, "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__start")))
    return rows.join(starts, [group, "__range"]).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__start") + F.col("__place")).cast("long").alias(name))
