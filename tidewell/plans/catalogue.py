"""Queries over the driver tables, by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import arrays, stats, text
from tidewell.operators import bloom, graphs, grids, kv, metrics, sequences, trees
from tidewell.plans.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Change log: events by user; an error deletes the user's row.

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_DAY = 86_400_000_000
LOG = "log AS (SELECT user_id AS key, value, epoch_us(ts) AS ts, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM events)"
LATEST = f"{LOG}, latest AS (SELECT key, value, ts, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM log) WHERE rn = 1)"


def log(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", kv.DELETE).otherwise(kv.PUT)
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), "value", F.expr(_MICROS).alias("ts"), F.col("event_id").alias("seq"), op.alias("op"))


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE op = 'PUT'")
def kv_snapshot(spark, d):
    return kv.snapshot(log(spark, d))


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE op = 'PUT' AND key = 7")
def kv_get_point(spark, d):
    return kv.get(log(spark, d), 7)


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest")
def kv_get_with_meta(spark, d):
    return kv.latest(log(spark, d))


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE key = 3")
def kv_get_with_meta_point(spark, d):
    return kv.get_with_meta(log(spark, d), 3)


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE op = 'PUT' AND key >= 10 AND key < 60")
def kv_range_scan(spark, d):
    return kv.range_scan(log(spark, d), 10, 60)


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE key >= 10 AND key < 60")
def kv_range_with_tombstones(spark, d):
    return kv.range_scan(log(spark, d), 10, 60, tombstones=True)


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest WHERE op = 'PUT' OR (SELECT max(ts) FROM log) - ts < {_DAY}")
def kv_compact_keep_recent_tombstones(spark, d):
    rows = log(spark, d)
    now = rows.agg(F.max("ts")).first()[0]
    return kv.compact([rows], now, _DAY)


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest")
def kv_merge_levels(spark, d):
    rows = log(spark, d)
    return kv.merge([rows.where(F.col("seq") % 3 == k) for k in range(3)])


@query("WITH log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id AS key, value FROM log WHERE rn = 1")
def kv_memtable_by_arrival(spark, d):
    return kv.reduce_batch(log(spark, d)).select("key", "value")


@query(
    "WITH m AS (SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id)"
    " SELECT sum(strlen(user_id::VARCHAR) + strlen(v) + 40)::BIGINT AS bytes, count(*) AS entries FROM m"
)
def kv_memtable_bytes(spark, d):
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return kv.memtable_bytes(rows)


def _segments(spark, d) -> DataFrame:
    rows = _t(spark, d, "events").select((F.floor(F.col("event_id") / 1000)).cast("long").alias("segment"), F.col("user_id").alias("key"), F.expr(_MICROS).alias("ts"), F.col("event_type").alias("v"))
    size = F.octet_length(F.col("key").cast("string")) + F.octet_length("v") + 24
    return kv.segment_stats(rows, ["segment"], "key", "ts", size)


SEGMENTS = (
    "seg AS (SELECT event_id // 1000 AS segment, min(user_id) AS min_key, max(user_id) AS max_key, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts,"
    " count(*) AS n, sum(strlen(user_id::VARCHAR) + strlen(event_type) + 24)::BIGINT AS bytes FROM events GROUP BY ALL)"
)


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def kv_segment_stats(spark, d):
    return _segments(spark, d)


def _levels(spark, d) -> DataFrame:
    return kv.level_gauges(_segments(spark, d).withColumn("level", (F.col("segment") % 3).cast("int")))


GAUGES = f"{SEGMENTS}, g AS (SELECT (segment % 3)::INT AS level, count(*) AS segments, sum(bytes)::BIGINT AS bytes FROM seg GROUP BY 1)"


@query(f"WITH {GAUGES} SELECT * FROM g")
def kv_level_gauges(spark, d):
    return _levels(spark, d)


@query(f"WITH {GAUGES} SELECT level, segments, bytes, threshold FROM g JOIN (VALUES (0, 4), (1, 6), (2, 8), (3, 10), (4, 12)) AS t(l, threshold) ON level = l WHERE segments >= threshold")
def kv_compaction_due(spark, d):
    return kv.compaction_due(_levels(spark, d))


_STATS = "(SELECT p_partkey // 100 AS segment, min(p_partkey) AS min_key, max(p_partkey) AS max_key FROM part GROUP BY 1)"


@query(f"SELECT s_suppkey, segment, min_key, max_key FROM supplier JOIN {_STATS} ON s_suppkey BETWEEN min_key AND max_key")
def kv_segment_pruning(spark, d):
    rows = _t(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 100).cast("long").alias("segment")).agg(F.min("p_partkey").alias("min_key"), F.max("p_partkey").alias("max_key"))
    return kv.candidate_segments(rows, _t(spark, d, "supplier").select("s_suppkey"), "s_suppkey")


_PLACED = (
    "placed AS (SELECT o_orderkey // 4096 AS segment, o_orderkey, row_number() OVER w - 1 AS pos,"
    " coalesce(sum(strlen(o_orderstatus) + strlen(o_orderpriority) + 24) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\""
    " FROM orders WINDOW w AS (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey))"
)


def _index(spark, d) -> DataFrame:
    rows = _t(spark, d, "orders").withColumn("segment", F.floor(F.col("o_orderkey") / 4096).cast("long"))
    return kv.sparse_index(rows, ["o_orderkey"], F.octet_length("o_orderstatus") + F.octet_length("o_orderpriority") + 24, by=["segment"])


@query(f'WITH {_PLACED} SELECT segment, o_orderkey, pos, "offset" FROM placed WHERE pos % 100 = 0')
def kv_sparse_index(spark, d):
    return _index(spark, d)


@query(
    f'WITH {_PLACED}, b AS (SELECT segment, min(o_orderkey) AS least, max(o_orderkey) AS most FROM placed GROUP BY 1), i AS (SELECT * FROM placed WHERE pos % 100 = 0)'
    ' SELECT p_partkey, b.segment, coalesce(max("offset") FILTER (o_orderkey <= p_partkey), 0) AS "offset" FROM part LEFT JOIN b ON p_partkey BETWEEN least AND most LEFT JOIN i ON i.segment = b.segment GROUP BY ALL'
)
def kv_sparse_seek(spark, d):
    bounds = _t(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 4096).cast("long").alias("segment")).agg(F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))
    return kv.segment_seek(_index(spark, d), bounds, _t(spark, d, "part").select("p_partkey"), "o_orderkey", "p_partkey", ["segment"])


# A second name, from when the first one read one segment.
QUERIES["kv_sparse_seek_all"], ORACLE_SQL["kv_sparse_seek_all"] = QUERIES["kv_sparse_seek"], ORACLE_SQL["kv_sparse_seek"]


@query(
    "SELECT o_custkey, o_orderkey, (coalesce(sum(strlen(o_orderpriority) + 24) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 128)::BIGINT AS file_no FROM orders"
)
def kv_size_split(spark, d):
    return kv.split_by_size(_t(spark, d, "orders"), ["o_orderkey"], F.octet_length("o_orderpriority") + 24, 128, ["o_custkey"]).select("o_custkey", "o_orderkey", "file_no")


@query(
    "WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, strlen(o_orderpriority) + 24 AS s FROM orders),"
    " f AS (SELECT o_custkey, i, s AS size, 0 AS file FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, CASE WHEN f.size >= 128 THEN 0 ELSE f.size END + o.s, f.file + CASE WHEN f.size >= 128 THEN 1 ELSE 0 END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)"
    " SELECT o_custkey, max(file)::INT AS last_file FROM f GROUP BY 1"
)
def kv_exact_split(spark, d):
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.octet_length("o_orderpriority") + 24).alias("s")))).alias("o"))
    return rows.select("o_custkey", F.array_max(kv.exact_split(F.transform("o", lambda x: x["s"]), 128)).alias("last_file"))


# Bloom filters over the part keys' decimal text.


@query(
    "SELECT n, p, greatest(1, floor(-n * ln(p) / (ln(2) * ln(2))))::BIGINT AS m, greatest(1, floor(greatest(1, floor(-n * ln(p) / (ln(2) * ln(2)))) / n * ln(2)))::BIGINT AS k"
    " FROM (SELECT unnest([1, 10, 100, 1000, 100000])::BIGINT AS n), (SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS p)"
)
def bloom_params(spark, d):
    rows = [(n, p, *bloom.parameters(n, p)) for n in (1, 10, 100, 1000, 100000) for p in (0.1, 0.01, 0.001)]
    return spark.createDataFrame(rows, "n BIGINT, p DOUBLE, m BIGINT, k BIGINT")


_BITS_M, _BITS_K = 19170, 6
_BIT = (
    "(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % {m})"
    " FROM (SELECT key, sha256(from_hex(lpad(to_hex(i), 2, '0') || '000000') || key::BLOB) AS h FROM {keys}, range({k}) AS r(i))"
)


@query("SELECT DISTINCT " + _BIT.format(m=_BITS_M, k=_BITS_K, keys="(SELECT p_partkey::VARCHAR AS key FROM part)").replace(" FROM (SELECT key", " AS bit FROM (SELECT key", 1))
def bloom_bits(spark, d):
    keys = _t(spark, d, "part").select(F.col("p_partkey").cast("string").cast("binary").alias("key"))
    return bloom.bits(keys, "key", _BITS_M, _BITS_K)


@query(
    "WITH b AS (SELECT DISTINCT " + _BIT.format(m=_BITS_M, k=_BITS_K, keys="(SELECT p_partkey::VARCHAR AS key FROM part)").replace(" FROM (SELECT key", " AS bit FROM (SELECT key", 1) + "),"
    " a AS (SELECT key, " + _BIT.format(m=_BITS_M, k=_BITS_K, keys="(SELECT 'absent' || p_partkey AS key FROM part)").replace(" FROM (SELECT key", " AS bit FROM (SELECT key", 1) + "),"
    " p AS (SELECT key, bool_and(b.bit IS NOT NULL) AS maybe FROM a LEFT JOIN b USING (bit) GROUP BY key) SELECT count(*) AS probes, count_if(maybe)::BIGINT AS false_positives, round(avg(maybe::INT), 9) AS rate FROM p"
)
def bloom_false_positive_rate(spark, d):
    part = _t(spark, d, "part")
    made = bloom.bits(part.select(F.col("p_partkey").cast("string").cast("binary").alias("key")), "key", _BITS_M, _BITS_K)
    found = bloom.probe(made, part.select(F.concat(F.lit("absent"), "p_partkey").cast("binary").alias("key")), "key", _BITS_M, _BITS_K)
    return found.agg(F.count("*").alias("probes"), F.count_if("maybe").alias("false_positives"), F.round(F.avg(F.col("maybe").cast("double")), 9).alias("rate"))


# Binary log frames.


def _frames(spark, d) -> DataFrame:
    """Log frames of the events, put together and taken apart by expressions."""
    rows = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"))

    def le(x, n):
        return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(x.cast("bigint"), 8 * b).bitwiseAND(255)), 2, "0") for b in range(n))))

    body = F.concat(F.lit(b"TWLG"), le(F.octet_length("key"), 8), F.col("key"), le(F.octet_length("value"), 8), F.col("value"), le(F.col("event_id"), 8), F.lit(b"\0"))
    return rows.withColumn("body", body).withColumn("crc", F.crc32("body"))


@query("SELECT event_id, 33 + strlen(user_id::VARCHAR) + strlen(event_type) AS frame_bytes, user_id::VARCHAR AS key, event_type AS value FROM events")
def wal_roundtrip_crc(spark, d):
    rows = _frames(spark, d).where(F.crc32("body") == F.col("crc"))
    klen = F.conv(F.hex(F.substr("body", F.lit(5), F.lit(1))), 16, 10).cast("int")
    key = F.substr("body", F.lit(13), klen)
    return rows.select("event_id", (F.octet_length("body") + 4).cast("bigint").alias("frame_bytes"), key.cast("string").alias("key"), F.substr("body", 13 + klen + 8, F.octet_length("body") - 29 - klen).cast("string").alias("value"))


@query("SELECT event_id AS ts, user_id::VARCHAR AS key, CASE WHEN event_type <> 'error' THEN event_type END AS value, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM events")
def wal_files_roundtrip(spark, d):
    """The events as log files, one or more a task, written and read again."""
    from tidewell.sources import frames

    frames.register(spark)
    op = F.when(F.col("event_type") == "error", kv.DELETE).otherwise(kv.PUT)
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), F.col("event_id").alias("ts"), op.alias("op"))
    path = new_path(spark, "wal")
    rows.write.format("wal").mode("append").save(path)
    return frames.read_log(spark, path).select("ts", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "op")


@query("SELECT user_id AS key, count(*) AS frames FROM events GROUP BY 1")
def wal_truncated_tail(spark, d):
    """Frames read back from files with a torn last frame: one file per user, the tear is ignored."""
    import pyarrow as pa

    from tidewell.sources.frames import decode_frames, encode_frame

    rows = _frames(spark, d).select("key", "event_id", "value").repartition("key").sortWithinPartitions("key", "event_id", "value")

    def run(batches):
        now, data, began = None, bytearray(), False

        def whole():
            data.extend(encode_frame(now or b"", b"torn", 0, "PUT")[:-3])
            with memoryview(data) as file:
                return None if now is None else int(now), sum(1 for _ in decode_frames(file))

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "frames"])

        for b in batches:
            out = []
            for key, ts, value in zip(*(c.to_pylist() for c in b.columns)):
                if began and key != now:
                    out.append(whole())
                    data = bytearray()
                now, began = key, True
                data += encode_frame(key or b"", value, ts, "PUT")
            if out:
                yield batch(out)
        if began:
            yield batch([whole()])

    return rows.mapInArrow(run, "key long, frames long")


@query("SELECT event_id, sha256(event_type) AS sha, upper(to_hex(event_type::BLOB)) AS hexed, strlen(event_type) AS bytes FROM events")
def scalar_hashes(spark, d):
    return _t(spark, d, "events").select("event_id", F.sha2("event_type", 256).alias("sha"), F.hex("event_type").alias("hexed"), F.octet_length("event_type").cast("bigint").alias("bytes"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_roundtrip(spark, d):
    rows = _t(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("j"))
    kinds = {f.name: f.dataType.simpleString() for f in _t(spark, d, "nation").schema}
    s = F.from_json("j", ", ".join(f"{c} {kinds[c]}" for c in ("n_nationkey", "n_name", "n_regionkey")))
    return rows.select(s.alias("s")).select("s.*")


# Metrics over the events.

_HOURLY = "h AS (SELECT date_trunc('hour', ts) AS start, count(*) AS ops_total, count_if(event_type = 'click')::BIGINT AS ops_get, count_if(event_type = 'purchase')::BIGINT AS ops_put FROM events GROUP BY 1)"


def _hourly(spark, d) -> DataFrame:
    e = _t(spark, d, "events").where("ts IS NOT NULL")
    return metrics.window_ops(e, "ts", "event_type", "1 hour", {"ops_get": F.col("event_type") == "click", "ops_put": F.col("event_type") == "purchase"})


@query(f"WITH {_HOURLY} SELECT * FROM h")
def metrics_window_ops(spark, d):
    return _hourly(spark, d)


_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start)"


@query(
    f"WITH {_HOURLY} SELECT epoch(start)::BIGINT AS t, ops_put, round(coalesce(sum(ops_put) OVER (ORDER BY start) / nullif(epoch(start) - min(epoch(start)) OVER (), 0), 0)::DOUBLE, 9) AS average FROM h"
)
def metrics_running_avg(spark, d):
    rows = _hourly(spark, d).select(F.expr(_SECONDS).alias("t"), "ops_put")
    return metrics.running_average(rows, "t", "ops_put", "average").withColumn("average", F.round("average", 9))


@query(f"WITH {_HOURLY}, p AS (SELECT start, ops_total, lag(ops_total) OVER (ORDER BY start) AS previous FROM h) SELECT start, ops_total, previous FROM p WHERE ops_total < previous * 0.8")
def metrics_drop_detect(spark, d):
    return metrics.drops(_hourly(spark, d).select("start", "ops_total"), "start", "ops_total", 0.8)


@query(f"WITH {_HOURLY}, p AS (SELECT start, ops_total, lag(ops_total) OVER (ORDER BY start) AS previous FROM h) SELECT start, ops_total, previous FROM p WHERE ops_total > previous")
def metrics_flush_events(spark, d):
    return metrics.rises(_hourly(spark, d).select("start", "ops_total"), "start", "ops_total")


@query(f"WITH {_HOURLY} SELECT start, ops_total, (epoch(start) - min(epoch(start)) OVER ())::DOUBLE AS elapsed FROM h")
def metrics_relative_time(spark, d):
    rows = _hourly(spark, d).withColumn("ms", F.expr(_SECONDS) * 1000)
    return metrics.relative_time(rows, "ms", "elapsed").select("start", "ops_total", "elapsed")


@query(
    "WITH l AS (SELECT date_trunc('hour', ts) AS start, (user_id % 4)::INT AS level, count(*) AS n FROM events GROUP BY ALL)"
    " SELECT start, level, n, sum(n) OVER (PARTITION BY start ORDER BY level)::BIGINT AS stacked FROM l"
)
def metrics_stacked(spark, d):
    e = _t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), (F.col("user_id") % 4).cast("int").alias("level")).agg(F.count("*").alias("n"))
    return metrics.stacked(e, "start", "level", "n")


@query("SELECT event_id AS ts_ms, level, ((event_id * (level + 1)) % 7)::BIGINT AS segments, (event_id * 10 + level)::BIGINT AS bytes FROM events, (SELECT unnest([0, 1, 2])::INT AS level)")
def metrics_csv_roundtrip(spark, d):
    """Metrics written as CSV and read back with their schema, one row per level."""
    e = _t(spark, d, "events")
    cols = [F.col("event_id").alias("ts_ms"), *(F.lit(0).cast("bigint").alias(c) for c in ("ops_total", "ops_put", "ops_get", "ops_del", "memtable_bytes"))]
    for i in range(3):
        cols += [((F.col("event_id") * (i + 1)) % 7).alias(f"sst_count_L{i}"), (F.col("event_id") * 10 + i).alias(f"sst_bytes_L{i}")]
    path = new_path(spark, "metrics")
    metrics.write_csv(e.select(*cols, F.lit(None).cast("string").alias("event")), path)
    return metrics.by_level(metrics.read_csv(spark, path, 3), 3)


# Sequences.


@query("SELECT event_id, user_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS median FROM events")
def running_median(spark, d):
    return sequences.running_median(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "median")


_RUNS = (
    "WITH q AS (SELECT l_suppkey, l_quantity::BIGINT AS q, row_number() OVER w AS i, sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM lineitem"
    " WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate)),"
    " z AS (SELECT l_suppkey, i, s FROM q UNION ALL SELECT DISTINCT l_suppkey, 0, 0 FROM lineitem),"
    " f AS (SELECT l_suppkey, s, min(i) AS a, max(i) AS b FROM z GROUP BY ALL)"
    " SELECT x.l_suppkey, greatest(max(coalesce(y.b - x.a, 0)), 0)::BIGINT AS longest FROM f x LEFT JOIN f y ON x.l_suppkey = y.l_suppkey AND y.s = x.s + 100 GROUP BY 1"
)


@query(_RUNS)
def prefix_sum_longest_run(spark, d):
    rows = _t(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    out = sequences.longest_run_with_sum(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"], "q", 100)
    return out.withColumn("longest", F.col("longest").cast("bigint"))


@query(
    "WITH s AS (SELECT DISTINCT l_partkey, (l_quantity * 7 % 101)::BIGINT AS place FROM lineitem), g AS (SELECT *, place - lag(place) OVER (PARTITION BY l_partkey ORDER BY place) AS gap FROM s)"
    " SELECT l_partkey, greatest(min(place), coalesce(max(place) FILTER (gap > 10), min(place))) AS steps FROM g GROUP BY 1"
)
def drone_delivery(spark, d):
    rows = _t(spark, d, "lineitem").select("l_partkey", (F.col("l_quantity") * 7 % 101).cast("bigint").alias("place"))
    return sequences.delivery_steps(rows, ["l_partkey"], "place")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT count(*) FROM orders) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_numbers(spark, d):
    n = _t(spark, d, "orders").count()
    return sequences.missing_numbers(spark, n, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(_t(spark, d, "customer").select("c_nationkey")).distinct()


@query("SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def sort_merge(spark, d):
    """A global sort with places: range-partitioned, then numbered from the partitions' counts."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = c.repartitionByRange(parts, "c_acctbal", "c_custkey").withColumn("_p", F.spark_partition_id())
    from tidewell.plans.shared import materialize

    ranged = materialize(ranged, "sorted")  # a partition's number must be the same for counts and rows
    base = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("c_acctbal", "c_custkey"))
    return ranged.withColumn("_r", inside).join(base, "_p").select("c_custkey", "c_name", "c_acctbal", (F.col("_b") + F.col("_r")).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT * FROM o WHERE place <= 3"
)
def top_k_per_group(spark, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("place", place).where("place <= 3")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def freq_sort_chars(spark, d):
    rows = _t(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return rows.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ch")


@query(
    "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL)"
    " SELECT p_partkey, string_agg(ch, '' ORDER BY n DESC, ch) AS chars FROM n GROUP BY 1"
)
def freq_sort_per_row(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(text.by_frequency(F.col("p_name")), "").alias("chars"))


@query(
    "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT array_to_string(list_sort(list_filter(string_split(w, ''), lambda x: x <> '')), '') AS letters, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS words FROM w GROUP BY 1"
)
def group_anagrams(spark, d):
    words = _t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.groupBy(text.anagram_key(F.col("w")).alias("letters")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("w")), " ").alias("words"))


# Arrays: the whole-number order prices of a customer, by order.

_PRICES = "a AS (SELECT o_custkey, list((o_totalprice / 1000)::INT ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)"


def _prices(spark, d) -> DataFrame:
    x = F.struct("o_orderkey", F.round(F.col("o_totalprice") / 1000).cast("int").alias("v"))
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(x)).alias("o"))
    return rows.select("o_custkey", F.transform("o", lambda s: s["v"]).alias("a"))


_SMALL = "a AS (SELECT o_custkey, list(o_orderkey % 7 ORDER BY o_orderkey) AS a FROM orders GROUP BY 1)"


def _small(spark, d) -> DataFrame:
    rows = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return rows.select("o_custkey", F.transform("o", lambda x: x % 7).alias("a"))


def _joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


_JOIN = "array_to_string({}, ',')"


@query(f"WITH {_SMALL} SELECT o_custkey, len(list_filter(a, lambda x: x = 3))::INT AS n FROM a")
def count_target(spark, d):
    return _small(spark, d).select("o_custkey", arrays.occurrences(F.col("a"), F.lit(3)).alias("n"))


@query(f"WITH {_SMALL} SELECT o_custkey, (list_position(a, list_max(a)) - 1)::BIGINT AS at FROM a")
def rotated_argmax(spark, d):
    return _small(spark, d).select("o_custkey", arrays.argmax(F.col("a")).alias("at"))


@query(f"WITH {_SMALL} SELECT o_custkey, (nullif(coalesce(list_position(a, 3), 0), 0) - 1)::BIGINT AS at, (coalesce(nullif(list_position(a, 3), 0), 0) - 1)::BIGINT AS at_or_minus FROM a")
def linear_search_idx(spark, d):
    return _small(spark, d).select("o_custkey", arrays.index_of(F.col("a"), F.lit(3).cast("bigint")).alias("at"), arrays.index_or_minus_one(F.col("a"), F.lit(3).cast("bigint")).alias("at_or_minus"))


@query(
    f"WITH {_SMALL}, s AS (SELECT o_custkey, list_sort(a) AS a FROM a) SELECT o_custkey, (coalesce(nullif(list_position(a, 3), 0), 0) - 1)::BIGINT AS first_at,"
    " (CASE WHEN coalesce(list_position(a, 3), 0) > 0 THEN len(a) - list_position(list_reverse(a), 3) ELSE -1 END)::BIGINT AS last_at FROM s"
)
def first_last_idx(spark, d):
    a = F.array_sort("a")
    x = F.lit(3).cast("bigint")
    return _small(spark, d).select("o_custkey", arrays.index_or_minus_one(a, x).alias("first_at"), arrays.last_index_or_minus_one(a, x).cast("bigint").alias("last_at"))


@query(
    f"WITH {_SMALL}, k AS (SELECT *, o_custkey % len(a) AS k FROM a) SELECT o_custkey, {_JOIN.format('CASE WHEN k = 0 THEN a ELSE a[len(a) - k + 1:] || a[:len(a) - k] END')} AS rotated FROM k"
)
def rotate_array(spark, d):
    return _small(spark, d).select("o_custkey", _joined(arrays.rotate(F.col("a"), F.col("o_custkey"))).alias("rotated"))


@query(f"WITH {_SMALL} SELECT o_custkey, {_JOIN.format('list_reverse(a)')} AS reversed, {_JOIN.format('list_sort(a)')} AS sorted FROM a")
def reverse_array(spark, d):
    return _small(spark, d).select("o_custkey", _joined(F.reverse("a")).alias("reversed"), _joined(F.array_sort("a")).alias("sorted"))


@query(
    f"WITH {_SMALL}, p AS (SELECT *, coalesce(list_position(a, 3), 0) AS p FROM a) SELECT o_custkey, {_JOIN.format('[99] || a')} AS prepended, {_JOIN.format('a || [99]')} AS appended,"
    f" {_JOIN.format('CASE WHEN 2 > len(a) THEN a ELSE a[:2] || [99] || a[3:] END')} AS inserted, {_JOIN.format('CASE WHEN p = 0 THEN a ELSE a[:p - 1] || a[p + 1:] END')} AS removed,"
    f" {_JOIN.format('a[:len(a) - 1]')} AS popped, {_JOIN.format('a[2:]')} AS popped_left, len(a)::INT AS n, a[4] AS fourth, {_JOIN.format('a[:2]')} AS head, CASE WHEN len(a) > 2 THEN {_JOIN.format('a[3:]')} END AS tail FROM p"
)
def list_edit_ops(spark, d):
    a, x = F.col("a"), F.lit(99).cast("bigint")
    return _small(spark, d).select(
        "o_custkey",
        _joined(arrays.prepend(a, x)).alias("prepended"),
        _joined(arrays.append(a, x)).alias("appended"),
        _joined(arrays.insert(a, F.lit(2), x)).alias("inserted"),
        _joined(arrays.remove_first(a, F.lit(3).cast("bigint"))).alias("removed"),
        _joined(arrays.pop(a)).alias("popped"),
        _joined(arrays.pop_left(a)).alias("popped_left"),
        F.size(a).alias("n"),
        arrays.element(a, F.lit(3)).alias("fourth"),
        _joined(arrays.take(a, F.lit(2))).alias("head"),
        _joined(arrays.drop(a, F.lit(2))).alias("tail"),
    )


@query(f"WITH {_SMALL} SELECT o_custkey, {_JOIN.format('list_sort(list_distinct(a || [5, 6, 7, 8]))')} AS united, {_JOIN.format('list_filter(range(9), lambda x: NOT list_contains(a, x))')} AS missing FROM a")
def array_set_ops(spark, d):
    a = F.col("a")
    other = F.array(*(F.lit(k).cast("bigint") for k in (5, 6, 7, 8)))
    return _small(spark, d).select("o_custkey", _joined(F.array_sort(arrays.union_first_seen(a, other))).alias("united"), _joined(arrays.missing(F.transform(a, lambda x: x.cast("int")), F.lit(9))).alias("missing"))


# Text and numbers.


@query(
    "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN '(a[b]{c})' WHEN l_linenumber % 3 = 1 THEN '([)]' ELSE '((x)' END AS s FROM lineitem)"
    " SELECT s, s = '(a[b]{c})' AS ok, count(*) AS n FROM t GROUP BY ALL"
)
def balanced_brackets(spark, d):
    k = F.col("l_linenumber") % 3
    rows = _t(spark, d, "lineitem").select(F.when(k == 0, "(a[b]{c})").when(k == 1, "([)]").otherwise("((x)").alias("s"))
    return rows.select("s", text.balanced(F.col("s")).alias("ok")).groupBy("s", "ok").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round((o_custkey + 3.0) * 2 - o_orderkey / 4.0, 6) AS v FROM orders")
def rpn_eval(spark, d):
    s = F.concat(F.col("o_custkey"), F.lit(" 3 + 2 * "), F.col("o_orderkey"), F.lit(" 4 / -"))
    return _t(spark, d, "orders").select("o_orderkey", F.round(text.postfix(s), 6).alias("v"))


_DAYS = "c AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS k FROM events GROUP BY ALL), l AS (SELECT user_id, day, k, avg(k) OVER (PARTITION BY user_id) AS lam FROM c)"


def _days(spark, d) -> DataFrame:
    c = _t(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("k"))
    return c.withColumn("lam", F.avg("k").over(Window.partitionBy("user_id")))


@query(f"WITH {_DAYS} SELECT user_id, day, k, round(exp(k * ln(lam) - lam - lgamma(k + 1)), 9) AS p FROM l")
def poisson_pmf(spark, d):
    return _days(spark, d).select("user_id", "day", "k", F.round(stats.pmf(F.col("lam"), F.col("k")), 9).alias("p"))


_CDF = "list_sum(list_transform(range({}), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1))))"


@query(
    f"WITH {_DAYS}, t AS (SELECT user_id, day, k, coalesce({_CDF.format('k')}, 0) AS lt, {_CDF.format('k + 1')} AS le FROM l)"
    " SELECT user_id, day, k, round(lt, 7) AS lt, round(le, 7) AS le, round(1 - le, 7) AS gt, round(1 - lt, 7) AS ge FROM t"
)
def poisson_tails(spark, d):
    lam, k = F.col("lam"), F.col("k")
    tails = {"lt": stats.less, "le": stats.at_most, "gt": stats.more, "ge": stats.at_least}
    return _days(spark, d).select("user_id", "day", "k", *(F.round(f(lam, k), 7).alias(n) for n, f in tails.items()))


@query("SELECT a AS attempt, least(0.5 * power(2, a), 60)::DOUBLE AS delay FROM (SELECT unnest(range(10)) AS a)")
def backoff_schedule(spark, d):
    return spark.range(10).select(F.col("id").alias("attempt"), stats.backoff(F.col("id"), 0.5, 60.0).alias("delay"))


# Trees: the event values of a user as insertion order.

_NODES = (
    "f AS (SELECT user_id AS tree, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),"
    " n AS (SELECT tree, seq, value, i, row_number() OVER (PARTITION BY tree ORDER BY value, seq) AS r FROM f),"
    " anc AS (SELECT a.tree, a.seq, a.r, j.seq AS a_seq, j.r AS a_r FROM n a JOIN n j ON a.tree = j.tree AND j.seq < a.seq AND NOT EXISTS"
    " (SELECT 1 FROM n x WHERE x.tree = a.tree AND x.seq < j.seq AND x.r BETWEEN least(a.r, j.r) AND greatest(a.r, j.r))),"
    " up AS (SELECT tree, seq, count(*) AS n_up, max(a_seq) AS parent_seq, count_if(a_r < r) AS up_less FROM anc GROUP BY ALL),"
    " down AS (SELECT tree, a_seq AS seq, count(*) AS n_down, count_if(r < a_r) AS down_less FROM anc GROUP BY ALL),"
    " s AS (SELECT tree, seq, value, coalesce(n_up, 0) + 1 AS depth, parent_seq, (coalesce(n_up, 0) + r - 1 - coalesce(up_less, 0) - coalesce(down_less, 0))::BIGINT AS pre, r - 1 AS ino,"
    " (coalesce(n_down, 0) + r - 1 - coalesce(up_less, 0) - coalesce(down_less, 0))::BIGINT AS post FROM n LEFT JOIN up USING (tree, seq) LEFT JOIN down USING (tree, seq))"
)


def _insertions(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("tree"), F.col("event_id").alias("seq"), "value")


@query(f"WITH {_NODES} SELECT tree, seq, value, depth, parent_seq FROM s")
def bst_shape(spark, d):
    return trees.shape(_insertions(spark, d)).select("tree", "seq", "value", "depth", "parent_seq")


@query(f"WITH {_NODES} SELECT tree, count(*) AS size, max(depth) AS height, round(sum(value), 6) AS total, min(value) AS least, max(value) AS greatest FROM s GROUP BY 1")
def bst_height(spark, d):
    return trees.summary(trees.shape(_insertions(spark, d))).select("tree", "size", "height", F.round("total", 6).alias("total"), "least", "greatest")


@query(f"WITH {_NODES}, w AS (SELECT tree, depth, count(*) AS n FROM s GROUP BY ALL) SELECT tree, max(n) AS width FROM w GROUP BY 1")
def bst_width(spark, d):
    return trees.summary(trees.shape(_insertions(spark, d))).select("tree", "width")


@query(f"WITH {_NODES} SELECT tree, seq, pre, ino FROM s")
def bst_preorder(spark, d):
    return trees.shape(_insertions(spark, d)).select("tree", "seq", "pre", F.col("ino").cast("bigint").alias("ino"))


@query(f"WITH {_NODES} SELECT tree, seq, post FROM s")
def bst_postorder(spark, d):
    return trees.shape(_insertions(spark, d)).select("tree", "seq", "post")


@query(f"WITH {_NODES} SELECT tree, string_agg(seq::VARCHAR, ',' ORDER BY pre) AS flat_pre, string_agg(seq::VARCHAR, ',' ORDER BY post) AS flat_post FROM s GROUP BY 1")
def bst_flatten(spark, d):
    s = trees.shape(_insertions(spark, d)).select("tree", F.col("seq").cast("string").alias("value"), "pre", "post")
    return trees.flatten_all(s, "pre", "post").select("tree", *(F.array_join(o, ",").alias(f"flat_{o}") for o in ("pre", "post")))


# A second name of each, from when the first ones read 30 events of a user.
for _n in ("shape", "height", "width", "preorder", "postorder", "flatten"):
    QUERIES[f"bst_all_{_n}"], ORACLE_SQL[f"bst_all_{_n}"] = QUERIES[f"bst_{_n}"], ORACLE_SQL[f"bst_{_n}"]


_HEAP = (
    "h AS (SELECT user_id AS tree, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),"
    " t AS (SELECT tree, seq, value, i, nullif(i // 2, 0) AS parent, floor(log2(i) + 1e-9)::BIGINT + 1 AS depth FROM h)"
)


def _heap(spark, d) -> DataFrame:
    return trees.level_order(_t(spark, d, "events").select(F.col("user_id").alias("tree"), F.col("event_id").alias("seq"), "value"))


@query(f"WITH {_HEAP} SELECT tree, seq, i, parent, depth FROM t")
def heap_tree_depth(spark, d):
    return _heap(spark, d).select("tree", "seq", "i", "parent", "depth")


@query(f"WITH {_HEAP} SELECT c.tree, bool_and(CASE WHEN p.i IS NULL THEN true WHEN c.i % 2 = 0 THEN c.value <= p.value ELSE c.value > p.value END) AS is_bst FROM t c LEFT JOIN t p ON c.tree = p.tree AND c.parent = p.i GROUP BY 1")
def is_bst_local(spark, d):
    return trees.is_search_tree(_heap(spark, d))


@query(
    "WITH p AS (SELECT p_name AS w, unnest(range(0, len(p_name) + 1)) AS n FROM part) SELECT w[:n] AS prefix, count(*) AS n_words, bool_or(len(w) = n) AS is_end FROM p GROUP BY 1"
)
def trie_nodes(spark, d):
    return trees.trie(_t(spark, d, "part"), "p_name")


@query(
    "WITH p AS (SELECT p_brand, p_type, unnest(range(0, len(p_type) + 1)) AS n FROM part), g AS (SELECT p_brand, p_type[:n] AS prefix, count(*) AS k FROM p GROUP BY ALL), t AS (SELECT p_brand, count(*) AS k FROM part GROUP BY 1)"
    " SELECT p_brand, arg_max(prefix, len(prefix)) AS lcp FROM g JOIN t USING (p_brand, k) GROUP BY 1"
)
def longest_common_prefix(spark, d):
    return trees.longest_common_prefix(_t(spark, d, "part"), "p_type", ["p_brand"])


# Graph: nations, with an edge from customers' to suppliers' nation where the keys differ by 1 or 6.

_EDGES = (
    "e AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
    " WHERE abs(c_nationkey - s_nationkey) IN (1, 6) GROUP BY ALL)"
)


def _edges(spark, d) -> DataFrame:
    from tidewell.plans.shared import materialize

    o, c, s = _t(spark, d, "orders"), _t(spark, d, "customer"), _t(spark, d, "supplier")
    rows = _t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where(F.abs(F.col("c_nationkey") - F.col("s_nationkey")).isin(1, 6))
    return materialize(rows.groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg(F.count("*").alias("weight")), "edges")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT 0::BIGINT AS node, 0 AS level UNION SELECT dst, level + 1 FROM r JOIN e ON src = node WHERE level < 25) SELECT node, min(level)::INT AS level FROM r GROUP BY 1")
def graph_reach(spark, d):
    return graphs.reach(_edges(spark, d), spark.range(1).select(F.col("id").alias("node")))


@query(
    f"WITH RECURSIVE {_EDGES}, m AS (SELECT src, dst, weight FROM e), r AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist, 0 AS hops UNION"
    " SELECT node, min(dist), hops FROM (SELECT dst AS node, dist + weight AS dist, hops + 1 AS hops FROM r JOIN m ON src = node WHERE hops < 25) GROUP BY node, hops) SELECT node, min(dist)::DOUBLE AS dist FROM r GROUP BY 1"
)
def graph_sssp(spark, d):
    return graphs.shortest_distances(_edges(spark, d), 0).select("node", "dist")


@query(
    f"WITH RECURSIVE {_EDGES}, r AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist, [0::BIGINT] AS path UNION ALL"
    " SELECT node, b.dist, b.path FROM (SELECT dst AS node, min({'dist': (dist + weight)::BIGINT, 'path': list_append(path, dst)}) AS b FROM r JOIN e ON src = node WHERE len(path) < 25 GROUP BY dst)),"
    " m AS (SELECT node, min({'dist': dist, 'n': len(path), 'path': path}) AS b FROM r GROUP BY 1) SELECT node, array_to_string(b.path, ' ') AS path FROM m"
)
def graph_shortest_paths(spark, d):
    return graphs.shortest_distances(_edges(spark, d), 0).select("node", F.array_join("path", " ").alias("path"))


@query(
    f"WITH {_EDGES}, p AS (SELECT o_orderkey AS path_id, o_orderkey % 25 AS a, (o_orderkey % 25 + 1) AS b, (o_orderkey % 25 + 7) AS c FROM orders)"
    " SELECT path_id, EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b) AND EXISTS (SELECT 1 FROM e WHERE src = b AND dst = c) AS valid FROM p"
)
def graph_path_valid(spark, d):
    k = F.col("o_orderkey") % 25
    paths = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path_id"), F.array(k, k + 1, k + 7).cast("array<bigint>").alias("path"))
    e = _edges(spark, d)
    return graphs.valid_path(e, paths, e.select(F.col("src").alias("node")))


@query(
    f"WITH RECURSIVE {_EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), v AS (SELECT DISTINCT a AS node FROM u), r AS (SELECT min(node) AS node FROM v UNION SELECT b FROM r JOIN u ON a = node),"
    " c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM u WHERE a < b) AS m, (SELECT count(*) FROM r) AS k) SELECT k = n AS connected, m >= n AS has_cycle_edges, k = n AND m = n - 1 AS is_tree FROM c"
)
def graph_cycle_check(spark, d):
    e = _edges(spark, d)
    return graphs.is_tree(e, e.select(F.col("src").alias("node")).union(e.select("dst")))


@query(
    f"WITH RECURSIVE {_EDGES}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM e GROUP BY ALL), k AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS i FROM o),"
    " u AS (SELECT a, b, i FROM k UNION ALL SELECT b, a, i FROM k), r AS (SELECT i, a AS node FROM k UNION SELECT r.i, u.b FROM r JOIN u ON u.a = r.node AND u.i < r.i)"
    " SELECT a AS src, b AS dst, w AS weight FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = k.i AND r.node = k.b)"
)
def graph_minimum_spanning_tree(spark, d):
    return graphs.minimum_spanning_forest(_edges(spark, d))


# A given tree, the edges between neighbouring numbers, which are a path; its least weight comes from another rule in SQL.


@query(
    f"WITH RECURSIVE {_EDGES}, o AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(weight) AS w FROM e GROUP BY ALL), k AS (SELECT a, b, w, row_number() OVER (ORDER BY w, a, b) AS i FROM o),"
    " u AS (SELECT a, b, i FROM k UNION ALL SELECT b, a, i FROM k), r AS (SELECT i, a AS node FROM k UNION SELECT r.i, u.b FROM r JOIN u ON u.a = r.node AND u.i < r.i),"
    " t AS (SELECT * FROM o WHERE b - a = 1), tn AS (SELECT a AS node FROM t UNION SELECT b FROM t), n AS (SELECT a AS node FROM o UNION SELECT b FROM o),"
    " x AS (SELECT (SELECT count(*) FROM t) = (SELECT count(*) FROM tn) - 1 AS is_tree, (SELECT sum(w) FROM t)::BIGINT AS weight,"
    " (SELECT sum(w) FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.i = k.i AND r.node = k.b))::BIGINT AS least, (SELECT count(*) FROM tn) = (SELECT count(*) FROM n) AS spans)"
    " SELECT is_tree, weight, least, is_tree AND spans AND weight = least AS ok FROM x"
)
def mst_weight_check(spark, d):
    e = _edges(spark, d)
    return graphs.verify_spanning_tree(e, e.where(F.abs(F.col("src") - F.col("dst")) == 1))


# A grid: line numbers by supplier, occupied where any quantity is above 45.

_GRID = "g AS (SELECT l_linenumber::INT AS row, l_suppkey AS col, (max(l_quantity) > 45)::INT AS v FROM lineitem GROUP BY ALL)"


def _grid(spark, d) -> DataFrame:
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("row"), F.col("l_suppkey").alias("col"))
    return rows.agg((F.max("l_quantity") > 45).cast("int").alias("v"))


@query(f"WITH {_GRID} SELECT col, min(row) FILTER (v <> 0) AS top, max(row) FILTER (v <> 0) AS base FROM g GROUP BY 1")
def grid_profile(spark, d):
    return grids.profile(_grid(spark, d))


@query(f"WITH {_GRID} SELECT row, col FROM g WHERE v <> 0 ORDER BY row, col LIMIT 1")
def grid_tip(spark, d):
    return grids.tip(_grid(spark, d))


# Streams: the same reducers over a file stream of the events.


def _stream(spark, d) -> DataFrame:
    return spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query(f"WITH {LATEST} SELECT key, value, ts, seq, op FROM latest")
def stream_upsert_latest(spark, d):
    from tidewell.streaming import upsert

    op = F.when(F.col("event_type") == "error", kv.DELETE).otherwise(kv.PUT)
    rows = _stream(spark, d).select(F.col("user_id").alias("key"), "value", F.expr(_MICROS).alias("ts"), F.col("event_id").alias("seq"), op.alias("op"))
    return upsert.run_to_table(upsert.latest(rows), "stream_upsert_latest", new_path(spark, "upsert"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_ops(spark, d):
    from tidewell.streaming import upsert

    rows = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = upsert.run_to_table(upsert.window_ops(rows, "ts", "1 hour", "10 minutes", "event_type"), "stream_window_ops", new_path(spark, "windows"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {LATEST} SELECT key::VARCHAR AS key, value::VARCHAR AS value FROM latest WHERE op = 'PUT'".replace("value::VARCHAR", "seq::VARCHAR"))
def store_write_compact_read(spark, d):
    """The change log through the durable store: three batches, flushed, compacted and read."""
    from tidewell.operators.store import Config, Store

    rows = log(spark, d).select(F.col("key").cast("string").cast("binary").alias("key"), F.col("seq").cast("string").cast("binary").alias("value"), "ts", "op", F.col("seq").alias("_s"))
    store = Store(spark, new_path(spark, "store"), Config(memtable_max_bytes=1 << 40))
    for k in range(3):
        store.apply(rows.where(F.col("_s") % 3 == k).drop("_s"))
        store.flush()
    store.compact(0)
    return store.range().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _part_store(spark, d):
    """The parts in a store: all put and flushed, those above 25 deleted, those of size 50 put again; opened anew."""
    from tidewell.operators.store import Store

    part, path = _t(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string").cast("binary")), new_path(spark, "parts")
    store = Store(spark, path)
    store.put(part.select("key", F.col("p_name").cast("binary").alias("value")))
    store.flush()
    store.delete(part.where("p_size > 25").select("key"))
    store.put(part.where("p_size = 50").select("key", F.col("p_brand").cast("binary").alias("value")))
    return Store(spark, path)


_PARTS = "SELECT p_partkey::VARCHAR AS key, CASE WHEN p_size = 50 THEN p_brand ELSE p_name END AS value FROM part WHERE (p_size <= 25 OR p_size = 50)"


@query(_PARTS)
def store_delete_recover(spark, d):
    return _part_store(spark, d).range().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(_PARTS + " AND p_partkey = 7")
def store_get_point(spark, d):
    return _part_store(spark, d).get(b"7").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT n_name AS name, '<html><body><h1>' || n_name || '</h1><p>nation' || n_nationkey || '@example.org</p><h2>Education</h2><h2>Experience</h2></body></html>' AS html FROM nation")
def resume_render(spark, d):
    from tidewell.sources import documents

    rows = _t(spark, d, "nation").select(F.to_json(F.struct(F.col("n_name").alias("name"), F.create_map(F.lit("email"), F.concat(F.lit("nation"), "n_nationkey", F.lit("@example.org"))).alias("contact"))).alias("j"))
    return documents.render_html(documents.parse_json(rows, "j"))
