"""Operators over rows that form ordered groups: medians, prefix sums, islands, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def running_median(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Median of a group's values so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def longest_run_with_sum(rows: DataFrame, by: list[str], order: list[str], value: str, target) -> DataFrame:
    """Per group the length of the longest contiguous run that sums to target, 0 if none.

    Prefix sums meet themselves shifted by the target in an equi-join, after only the first place of each sum is kept
    on the left and only the last on the right, so a sum that recurs is never joined with all its copies.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    sums = rows.select(*by, F.row_number().over(w).alias("_i"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"))
    zero = rows.select(*by).distinct().select(*by, F.lit(0).alias("_i"), F.lit(0).cast(sums.schema["_s"].dataType).alias("_s"))
    every = sums.unionByName(zero).groupBy(*by, "_s").agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    left = every.select(*by, (F.col("_s") + target).alias("_s"), "_first")
    found = left.join(every.select(*by, "_s", "_last"), [*by, "_s"], "left")
    return found.groupBy(*by).agg(F.greatest(F.max(F.coalesce(F.col("_last") - F.col("_first"), F.lit(0))), F.lit(0)).alias("longest"))


def delivery_steps(stations: DataFrame, by: list[str], place: str, reach: int = 10) -> DataFrame:
    """Per group the place walked to last: after the last gap wider than reach, or the first station.

    With stations and target sorted, each gap wider than a flight's reach must be walked to its far end.
    """
    distinct = stations.select(*by, place).distinct()
    gap = F.col(place) - F.lag(place).over(Window.partitionBy(*by).orderBy(place))
    return distinct.withColumn("_far", gap > reach).groupBy(*by).agg(F.greatest(F.min(place), F.coalesce(F.max(F.when(F.col("_far"), F.col(place))), F.min(place))).alias("steps"))


def missing_numbers(spark: SparkSession, n: int, rows: DataFrame, value: str) -> DataFrame:
    """Numbers of [0, n) that a column lacks."""
    return spark.range(n).select(F.col("id").alias(value)).join(rows.select(value), value, "left_anti")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """A random permutation."""
    return rows.orderBy(F.rand(seed))


def overlapping_lists(spark: SparkSession, size: int, overlap: float, seed: int) -> DataFrame:
    """(list_id, pos, value): two lists of `size` distinct values that share a part of them."""
    shared = int(size * overlap)
    one = spark.range(size).select(F.lit(1).alias("list_id"), F.col("id").alias("value"))
    two = spark.range(size).select(F.lit(2).alias("list_id"), (F.col("id") + size - shared).alias("value"))
    w = Window.partitionBy("list_id").orderBy(F.rand(seed))
    return one.union(two).select("list_id", (F.row_number().over(w) - 1).alias("pos"), "value")


def union_rows(lists: DataFrame) -> DataFrame:
    """Distinct values of lists given as rows, by where they are first seen (list_id, pos)."""
    return lists.groupBy("value").agg(F.min(F.struct("list_id", "pos")).alias("first")).orderBy("first").select("value", "first.list_id", "first.pos")
