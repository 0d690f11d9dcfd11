"""Occupancy grids as rows (row, col, v); a cell is occupied if v is not 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occupied(v: str = "v") -> Column:
    return F.coalesce(F.col(v) != 0, F.lit(False))


def profile(grid: DataFrame) -> DataFrame:
    """Per column the first and the last occupied row (null where none is)."""
    here = F.when(occupied(), F.col("row"))
    return grid.groupBy("col").agg(F.min(here).alias("top"), F.max(here).alias("base"))


def tip(grid: DataFrame) -> DataFrame:
    """The first occupied cell by row, then column: one row, null coordinates in an empty grid."""
    first = F.min(F.when(occupied(), F.struct("row", "col")))
    return grid.agg(first.alias("c")).select("c.row", "c.col")
