"""Reads, merges and statistics of a versioned key-value log.

A log row is (key, value, ts, seq, op): op is PUT or DELETE, and of a key's rows the one with the greatest (ts, seq)
counts. Deletion is a row of its own, never a null or empty value. Keys may be of any orderable type; binary keys
order by unsigned bytes. Bounds are half-open and null means unbounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = "PUT", "DELETE"


def latest(log: DataFrame) -> DataFrame:
    """The winning version of each key, deletions included."""
    rest = [c for c in log.columns if c not in ("key", "ts", "seq")]
    best = log.groupBy("key").agg(F.max_by(F.struct("ts", "seq", *rest), F.struct("ts", "seq")).alias("_v"))
    return best.select("key", *(F.col(f"_v.{c}").alias(c) for c in log.columns if c != "key"))


def live(versions: DataFrame) -> DataFrame:
    """Versions that are not deletions."""
    return versions.where(F.col("op") == PUT)


def snapshot(log: DataFrame) -> DataFrame:
    """The latest live value of each key."""
    return live(latest(log))


def between(rows: DataFrame, start=None, end=None, key: str = "key") -> DataFrame:
    """Rows with start <= key < end; the filter reaches the scan, also from above latest()."""
    bounds = [F.col(key) >= F.lit(start)] * (start is not None) + [F.col(key) < F.lit(end)] * (end is not None)
    return rows.where(reduce(Column.__and__, bounds)) if bounds else rows


def range_scan(log: DataFrame, start=None, end=None, tombstones: bool = False) -> DataFrame:
    """Latest versions of a key range, in key order."""
    found = latest(between(log, start, end))
    return (found if tombstones else live(found)).orderBy("key")


def get(log: DataFrame, key) -> DataFrame:
    """The live value of one key: one row or none."""
    return live(get_with_meta(log, key))


def get_with_meta(log: DataFrame, key) -> DataFrame:
    """The latest version of one key, also if it is a deletion."""
    return latest(log.where(F.col("key") == F.lit(key)))


def merge(runs: list[DataFrame]) -> DataFrame:
    """Latest version of each key over several runs (memtable, levels, segments)."""
    return latest(reduce(DataFrame.unionByName, runs))


def compact(runs: list[DataFrame], now, retention, deepest: bool = True) -> DataFrame:
    """Merged runs without expired deletions; these stay unless no older version can be elsewhere (deepest)."""
    merged = merge(runs)
    return merged.where((F.col("op") == PUT) | (F.lit(now) - F.col("ts") < F.lit(retention))) if deepest else merged


def reduce_batch(batch: DataFrame) -> DataFrame:
    """One version per key of a batch by arrival (seq), whatever its ts: what a memtable holds."""
    rest = [c for c in batch.columns if c != "key"]
    best = batch.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_v"))
    return best.select("key", *(F.col(f"_v.{c}").alias(c) for c in rest))


def entry_bytes(key: str = "key", value: str = "value") -> Column:
    """Bytes that a version takes in memory: key, value, an 8-byte ts, and 32 of overhead."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 40


def record_bytes(key: str = "key", value: str = "value") -> Column:
    """Bytes that a version takes in a segment file: three 8-byte fields, key and value."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 24


def memtable_bytes(batch: DataFrame) -> DataFrame:
    return reduce_batch(batch).agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes"), F.count("*").alias("entries"))


def segment_stats(rows: DataFrame, by: list[str], key: str, ts: str, size: Column) -> DataFrame:
    """Per segment what its metadata holds: key and ts bounds, rows, bytes."""
    return rows.groupBy(*by).agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count("*").alias("n"), F.sum(size).alias("bytes")
    )


def candidate_segments(stats: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Segments whose key bounds hold each probe; stats is one row per segment, probes are a query set."""
    return probes.join(stats, (F.col(key) >= F.col("min_key")) & (F.col(key) <= F.col("max_key")))


def sparse_index(rows: DataFrame, order: list[str], size: Column, every: int = 100, by: list[str] | None = None) -> DataFrame:
    """Every `every`th row of each segment in key order, with its byte offset.

    `by` names the segment columns: positions and offsets are windows within a segment, which is a bounded file.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("pos", F.row_number().over(w).cast("bigint") - 1).withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return placed.where(F.col("pos") % every == 0).select(*by, *order, "pos", "offset")


def sparse_seek(index: DataFrame, probes: DataFrame, key: str, probe: str, by: list[str] | None = None) -> DataFrame:
    """Per probe the offset of the greatest indexed key at or below it, 0 if there is none.

    An as-of lookup: index and probes are sorted together by key once, and the last offset is carried forward. `by`
    names the segment columns, which both sides have: a probe sees the index of its own segment only.
    """
    by = by or []
    both = index.select(*by, F.col(key).alias("_k"), F.lit(0).alias("_o"), F.col("offset"), F.lit(None).cast(probes.schema[probe].dataType).alias(probe)).unionByName(
        probes.select(*by, F.col(probe).alias("_k"), F.lit(1).alias("_o"), F.lit(None).cast(index.schema["offset"].dataType).alias("offset"), probe)
    )
    carried = F.last("offset", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_k", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("offset", F.coalesce(carried, F.lit(0))).where("_o = 1").select(probe, *by, "offset")


def segment_seek(index: DataFrame, stats: DataFrame, probes: DataFrame, key: str, probe: str, by: list[str]) -> DataFrame:
    """Per probe each segment whose key bounds hold it, with the offset to read from; a probe that none holds gets null and 0."""
    held = candidate_segments(stats, probes.select(probe).distinct(), probe).select(probe, *by)
    found = sparse_seek(index, held, key, probe, by)
    return probes.select(probe).join(found, probe, "left").select(probe, *by, F.coalesce("offset", F.lit(0)).alias("offset"))


def split_by_size(rows: DataFrame, order: list[str], size: Column, limit: int, by: list[str] | None = None) -> DataFrame:
    """Output file of each row by bytes before it (floor of the running size over the limit)."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("file_no", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / limit))


def exact_split(sizes: Column, limit: int) -> Column:
    """File numbers of an array of sizes where a file ends once it holds `limit` bytes and the count restarts."""
    start = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("file"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        roll = a["size"] >= limit
        file = a["file"] + F.when(roll, 1).otherwise(0)
        return F.struct((F.when(roll, 0).otherwise(a["size"]) + s).cast("bigint").alias("size"), file.alias("file"), F.array_append(a["out"], file).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def level_gauges(stats: DataFrame) -> DataFrame:
    """Segments and bytes per level."""
    return stats.groupBy("level").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"))


#: Segments at which a level is due for compaction.
DUE = {0: 4, 1: 6, 2: 8, 3: 10, 4: 12}


def compaction_due(gauges: DataFrame, due: dict[int, int] = DUE) -> DataFrame:
    """Levels that hold as many segments as their threshold or more."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in due.items() for x in kv)), F.col("level").cast("int"))
    return gauges.withColumn("threshold", limit).where("segments >= threshold")
