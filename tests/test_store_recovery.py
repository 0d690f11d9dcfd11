"""Order within wide batches, streams that are restarted, and writes beside compactions."""

import threading

import pytest
from pyspark.sql import functions as F

from tidewell.operators.store import Compactor, Config, Store
from tidewell.plans import shared
from tidewell.streaming import upsert


def put(spark, *rows):
    return spark.createDataFrame([(k.encode(), v.encode()) for k, v in rows], "key BINARY, value BINARY")


def content(store):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in store.range().collect()}


def test_rows_of_300_partitions_keep_their_order(spark, tmp_path):
    rows = spark.range(0, 600, 1, 300).select(F.lit("k").cast("binary").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    store = Store(spark, f"file://{tmp_path}/s")
    store.put(rows)
    assert store._rows(store._pending).select("seq").distinct().count() == 600
    assert content(store) == {"k": "599"}
    store.put(put(spark, ("k", "after")))
    assert content(store) == {"k": "after"} and content(Store(spark, f"file://{tmp_path}/s")) == {"k": "after"}


def stream_of(spark, path):
    return spark.readStream.schema("key BINARY, value BINARY, op STRING").option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_that_failed_goes_on_where_it_was(spark, tmp_path):
    source, checkpoint, path = (f"file://{tmp_path}/{x}" for x in ("in", "cp", "s"))
    put(spark, ("a", "1")).withColumn("op", F.lit("PUT")).coalesce(1).write.parquet(source)
    store = Store(spark, path)
    store.put(put(spark, ("other", "x")))
    upsert.into_store(stream_of(spark, source), store, checkpoint).awaitTermination()
    store.put(put(spark, ("a", "newer")))
    put(spark, ("b", "2")).withColumn("op", F.lit("PUT")).coalesce(1).write.mode("append").parquet(source)

    class Dies(Store):
        def apply(self, rows, source=None):
            super().apply(rows, source)
            if source:
                raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception, match="before the commit"):
        upsert.into_store(stream_of(spark, source), Dies(spark, path), checkpoint).awaitTermination()
    again = Store(spark, path)
    again.put(put(spark, ("b", "newer")))
    again.flush()
    again.vacuum()
    again = Store(spark, path)  # the log is gone: the manifest knows the micro-batches
    put(spark, ("c", "3")).withColumn("op", F.lit("PUT")).coalesce(1).write.mode("append").parquet(source)
    upsert.into_store(stream_of(spark, source), again, checkpoint).awaitTermination()
    assert content(again) == {"a": "newer", "b": "newer", "c": "3", "other": "x"}


def test_flush_during_a_compaction_loses_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(memtable_max_bytes=1))
    store.put(put(spark, ("a", "1")))
    store.put(put(spark, ("b", "1")))
    began, go, write = threading.Event(), threading.Event(), store._write_segment

    def slow(rows, level):
        if level:
            began.set()
            assert go.wait(60)
        return write(rows, level)

    store._write_segment = slow
    jobs = Compactor(store)
    job = jobs.schedule(0)
    assert began.wait(60)
    store.put(put(spark, ("a", "2")))  # flushed at once, by the size of the memtable
    go.set()
    assert jobs.wait(job, 120) and jobs.status(job).error is None
    assert jobs.close() and content(store) == {"a": "2", "b": "1"}
    assert sorted(s["level"] for s in store.manifest.segments) == [0, 1]
    assert content(Store(spark, f"file://{tmp_path}/s")) == {"a": "2", "b": "1"}


def test_the_memtable_is_flushed_by_its_keys_not_by_its_writes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(memtable_max_bytes=100))
    for k in range(4):
        store.put(put(spark, ("a", str(k))))
    assert store.manifest.segments == [] and content(store) == {"a": "3"}
    store.put(put(spark, ("b", "x" * 50)))
    assert len(store.manifest.segments) == 1 and content(store)["a"] == "3"


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
