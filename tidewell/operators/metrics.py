"""Time series of a store's counters and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window_ops(ops: DataFrame, ts: str, op: str, width: str, kinds: dict[str, Column]) -> DataFrame:
    """Operations per time window: all, and those that each condition of `kinds` counts."""
    w = F.window(ts, width)
    out = ops.groupBy(w.alias("_w")).agg(F.count(op).alias("ops_total"), *(F.count_if(c).alias(n) for n, c in kinds.items()))
    return out.select(F.col("_w.start").alias("start"), "ops_total", *kinds)


def running_average(series: DataFrame, t: str, n: str, out: str) -> DataFrame:
    """Count so far over seconds since the first row; 0 at the first row. One series: a row per sampling tick."""
    w = Window.orderBy(t)
    rows = series.withColumn("_e", F.col(t) - F.first(t).over(w)).withColumn("_s", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn(out, F.coalesce(F.try_divide(F.col("_s").cast("double"), F.col("_e")), F.lit(0.0))).drop("_e", "_s")


def relative_time(series: DataFrame, t: str, out: str) -> DataFrame:
    """Seconds since the series' first tick, from milliseconds."""
    return series.withColumn(out, (F.col(t) - F.min(t).over(Window.partitionBy())) / 1000.0)


def drops(series: DataFrame, t: str, gauge: str, share: float = 0.5) -> DataFrame:
    """Ticks at which a gauge falls under a share of the tick before: a flush of the memtable."""
    before = F.lag(gauge).over(Window.orderBy(t))
    return series.withColumn("previous", before).where(F.col(gauge) < F.col("previous") * share)


def rises(series: DataFrame, t: str, gauge: str) -> DataFrame:
    """Ticks at which a count is above the tick before; never the first: flush events."""
    before = F.lag(gauge).over(Window.orderBy(t))
    return series.withColumn("previous", before).where(F.col(gauge) > F.col("previous"))


def stacked(levels: DataFrame, t: str, level: str, value: str, out: str = "stacked") -> DataFrame:
    """Per tick the values summed from level 0 up to each level."""
    w = Window.partitionBy(t).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn(out, F.sum(value).over(w))


def schema_of(max_levels: int) -> str:
    """Columns of a metrics file."""
    fixed = [f"{c} BIGINT" for c in ("ts_ms", "ops_total", "ops_put", "ops_get", "ops_del", "memtable_bytes")]
    return ", ".join([*fixed, *(f"sst_count_L{i} BIGINT, sst_bytes_L{i} BIGINT" for i in range(max_levels)), "event STRING"])


def write_csv(series: DataFrame, path: str) -> None:
    series.write.mode("append").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, max_levels: int) -> DataFrame:
    """A metrics file; missing file: no rows, missing event: empty string."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = schema_of(max_levels)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True).withColumn("event", F.coalesce("event", F.lit("")))


def by_level(series: DataFrame, max_levels: int) -> DataFrame:
    """(ts_ms, level, segments, bytes) from the per-level columns."""
    parts = ", ".join(f"{i}, sst_count_L{i}, sst_bytes_L{i}" for i in range(max_levels))
    return series.selectExpr("ts_ms", f"stack({max_levels}, {parts}) AS (level, segments, bytes)")


def workload(spark: SparkSession, n: int, keys: int, p_put: float, p_get: float, seed: int = 1) -> DataFrame:
    """Random operations: (seq, key, op), uniform keys, the rest deletions."""
    rows = spark.range(n).select(F.col("id").alias("seq"), F.floor(F.rand(seed) * keys).cast("string").alias("key"), F.rand(seed + 1).alias("_r"))
    return rows.select("seq", "key", F.when(F.col("_r") < p_put, "PUT").when(F.col("_r") < p_put + p_get, "GET").otherwise("DELETE").alias("op"))
