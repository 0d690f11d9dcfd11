import pytest
from pyspark.sql import functions as F

from tidewell.operators import bloom, graphs, kv, sequences, trees
from tidewell.operators.store import Compactor, Config, Store
from tidewell.streaming import upsert


def pairs(spark, *rows):
    return spark.createDataFrame([(k.encode(), None if v is None else v.encode()) for k, v in rows], "key BINARY, value BINARY")


def content(df):
    return [(bytes(r.key).decode(), bytes(r.value).decode()) for r in df.collect()]


def test_store_scenarios(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put(pairs(spark, ("key3", "c"), ("key1", "a"), ("key2", "b")))
    store.put(pairs(spark, ("key1", "a2"), ("empty", "")))
    assert content(store.range()) == [("empty", ""), ("key1", "a2"), ("key2", "b"), ("key3", "c")]
    store.flush()
    store.delete(pairs(spark, ("key2", None), ("none", None)).select("key"))
    assert content(store.get(b"key2")) == [] and store.get_with_meta(b"key2").first().op == "DELETE"
    assert content(store.range(b"key1", b"key3")) == [("key1", "a2")]
    assert content(store.get(b"empty")) == [("empty", "")]
    # recovery: unflushed batches are replayed, versions go on
    again = Store(spark, f"file://{tmp_path}/s")
    again.put(pairs(spark, ("key1", "a3")))
    assert content(again.get(b"key1")) == [("key1", "a3")]
    again.flush()
    again.compact(0)
    assert [s["level"] for s in again.manifest.segments] == [1]
    assert content(again.range()) == [("empty", ""), ("key1", "a3"), ("key3", "c")]
    again.vacuum()
    assert content(Store(spark, f"file://{tmp_path}/s").range()) == content(again.range())
    with pytest.raises(ValueError):
        again.compact(5)


def test_expired_deletions_stay_while_older_versions_exist(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(tombstone_retention_ms=0))
    store.put(pairs(spark, ("k", "v")))
    store.flush()
    store.compact(0)
    store.delete(pairs(spark, ("k", None)).select("key"))
    store.flush()
    store.compact(0, now_ms=1 << 50)
    assert content(store.range()) == [] and store.get_with_meta(b"k").count() == 1
    store.compact(1, now_ms=1 << 50)
    assert store.get_with_meta(b"k").count() == 0


def test_background_compaction(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(memtable_max_bytes=1))
    store.put(pairs(spark, ("a", "1")))
    store.put(pairs(spark, ("b", "2")))
    jobs = Compactor(store)
    job = jobs.schedule(0)
    assert jobs.wait(job, 120) and jobs.status(job).status == "completed" and jobs.pending() == []
    with pytest.raises(ValueError):
        jobs.schedule(5)
    jobs.close()
    assert content(store.range()) == [("a", "1"), ("b", "2")]


def test_stream_into_store(spark, tmp_path):
    pairs(spark, ("a", "1"), ("b", "2")).withColumn("op", F.lit("PUT")).write.parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema("key BINARY, value BINARY, op STRING").parquet(str(tmp_path / "in"))
    upsert.into_store(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert content(store.range()) == [("a", "1"), ("b", "2")]


def test_key_order_is_unsigned(spark):
    keys = [b"", b"\0", b"\0\0", b"\0\1", b"\1", b"\xff", b"a", b"z"]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "key BINARY")
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == sorted(keys)


def test_exact_split(spark):
    df = spark.createDataFrame([([40, 40, 40, 100, 10, 10],)], "s ARRAY<INT>")
    assert df.select(kv.exact_split(F.col("s"), 100)).first()[0] == [0, 0, 0, 1, 2, 2]


def test_bloom(spark):
    m, k = bloom.parameters(1000, 0.01)
    assert (m, k) == (9585, 6)
    keys = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("key"))
    made = bloom.bits(keys, "key", m, k)
    assert bloom.probe(made, keys, "key", m, k).where("NOT maybe").isEmpty()
    absent = spark.range(1000, 2000).select(F.col("id").cast("string").cast("binary").alias("key"))
    assert bloom.probe(made, absent, "key", m, k).where("maybe").count() <= 20
    data = bloom.serialize([1, 5, 9000], 1000, 0.01)
    assert bloom.deserialize(data) == ({1, 5, 9000}, 1000, 0.01, m, k)
    with pytest.raises(ValueError):
        bloom.deserialize(b"\2" + data[1:])


def test_trees(spark):
    rows = [(1, i, v) for i, v in enumerate([5, 3, 8, 1, 4, 8, 9])]
    shape = trees.shape(spark.createDataFrame(rows, "tree INT, seq INT, value INT"))
    assert trees.flatten(shape, "pre").first()["values"] == [5, 3, 1, 4, 8, 8, 9]
    assert trees.flatten(shape, "post").first()["values"] == [1, 4, 3, 9, 8, 8, 5]
    assert trees.flatten(shape, "ino").first()["values"] == [1, 3, 4, 5, 8, 8, 9]
    assert trees.summary(shape).select("size", "height", "width").first() == (7, 4, 3)
    heap = trees.level_order(spark.createDataFrame([(1, i, v) for i, v in enumerate([10, 5, 15, 1, 12])], "tree INT, seq INT, value INT"))
    assert trees.is_search_tree(heap).first().is_bst and not trees.is_search_tree(heap, strict=True).first().is_bst


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 4.0), ("a", "c", 1.0), ("c", "b", 2.0), ("b", "d", 5.0)], "src STRING, dst STRING, weight DOUBLE")
    got = {r.node: (r.dist, r.path) for r in graphs.shortest_distances(e, "a").collect()}
    assert got == {"a": (0.0, ["a"]), "b": (3.0, ["a", "c", "b"]), "c": (1.0, ["a", "c"]), "d": (8.0, ["a", "c", "b", "d"])}
    assert graphs.depth_first_path(e, "a", "d") == ["a", "b", "d"] and graphs.depth_first_path(e, "d", "a") is None and graphs.depth_first_path(e, "a", "a") == ["a"]
    mst = graphs.minimum_spanning_forest(e)
    assert sorted(map(tuple, mst.collect())) == [("a", "c", 1.0), ("b", "c", 2.0), ("b", "d", 5.0)]
    assert graphs.verify_spanning_tree(e, mst).first().ok and not graphs.verify_spanning_tree(e, e.limit(3)).first().ok
    paths = spark.createDataFrame([(1, ["a", "c", "b"]), (2, ["b", "a"]), (3, []), (4, ["d"]), (5, ["x"])], "path_id INT, path ARRAY<STRING>")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node STRING")
    assert {r.path_id: r.valid for r in graphs.valid_path(e, paths, nodes).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    with pytest.raises(Exception, match="negative weight"):
        graphs.shortest_distances(e.withColumn("weight", -F.col("weight")), "a").collect()


@pytest.mark.parametrize("stations, target, steps", [([7, 4, 14], 23, 4), ([7, 4, 14, 40], 40, 40), ([1], 1, 1), ([5, 30], 31, 30)])
def test_delivery(spark, stations, target, steps):
    df = spark.createDataFrame([(1, s) for s in [*stations, target] if s <= target], "g INT, p INT")
    assert sequences.delivery_steps(df, ["g"], "p").first().steps == steps


def test_lists(spark):
    two = sequences.overlapping_lists(spark, 10, 0.3, 1)
    assert two.count() == 20 and sequences.union_rows(two).count() == 17
    assert sorted(r.id for r in sequences.shuffled(spark.range(20), 3).collect()) == list(range(20))
