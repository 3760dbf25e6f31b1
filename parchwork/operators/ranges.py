"""Numbers along a total order, from sums over ranges of it: no window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchwork.plans.session import materialize

_PART = "__part"


def running(df: DataFrame, by: list[Column], amount: Column, column: str) -> DataFrame:
    """`df` with `column`, the sum of `amount` over all rows up to this one in the order `by`; equal rows come in any order.

    Rows are dealt over ranges of `by` by sample and written; each range's sum is one number, of which the driver adds up as many as there
    are partitions; within its range a row's own sum follows from a window. An amount that is null counts as 0. An empty table stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__amount", F.coalesce(amount.cast("long"), F.lit(0)))
    ranged = materialize(rows.repartitionByRange(parts, *by).withColumn(_PART, F.spark_partition_id()), "ranges")
    sums = sorted((r[_PART], r["n"]) for r in ranged.groupBy(_PART).agg(F.sum("__amount").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, f"{_PART} int, __start long"))  # a row for each partition
    within = Window.partitionBy(_PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(before, _PART).withColumn(column, F.col("__start") + F.sum("__amount").over(within)).drop(_PART, "__start", "__amount")
