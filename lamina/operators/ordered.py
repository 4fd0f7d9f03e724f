"""Running totals over a whole order, and groups of overlapping intervals, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.runtime import cut, small


def running_total(df: DataFrame, by: Sequence[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Sum of ``value`` over all rows up to each, in order: rows are cut into ranges of the order, each range is summed
    up by itself, and begins at the total of those before it. Rows that tie stay in one range, so the order has to be total.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    sums, at, starts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.sum(value).alias("n")).collect()}, 0, []
    for p in sorted(sums):
        starts.append((p, at))
        at += sums[p] or 0
    if not starts:
        return ranged.drop("_range").withColumn(name, F.lit(None).cast("long"))
    first = spark.createDataFrame(starts, "_range int, _first long")
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(name, own).join(small(first, len(starts)), "_range").withColumn(name, F.col(name) + F.col("_first")).drop("_range", "_first")


def interval_groups(df: DataFrame, lo: str, hi: str, within: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """(within, lo, hi, n) of each group of intervals that meet, ends included: a new group begins where the greatest end
    so far lies before the next beginning."""
    order = Window.partitionBy(*within).orderBy(lo, *tie)
    end = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = df.withColumn("_new", F.when(end.isNull() | (F.col(lo) > end), 1).otherwise(0))
    numbered = begins.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*within, "_group").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count("*").alias("n")).drop("_group")
