import pytest

from tidewell.sources import frames

ROWS = [(b"a", b"1", 5, "PUT"), (b"", b"", 6, "PUT"), (b"b", None, 7, "DELETE"), (b"\xff\x00", b"x" * 10_000, 8, "PUT")]


def log(rows=ROWS):
    return b"".join(frames.encode_frame(*r) for r in rows)


def test_frames_round_trip():
    assert [r[1:] for r in frames.decode_frames(log())] == ROWS
    assert len(frames.encode_frame(b"key", b"value", 1, "PUT")) == 33 + 8


@pytest.mark.parametrize("cut", [1, 3, 4, 12, 20, 30])
def test_truncated_tail_is_ignored(cut):
    data = log()
    tail = len(frames.encode_frame(*ROWS[-1]))
    assert len(list(frames.decode_frames(data[: len(data) - tail + cut]))) == 3
    assert len(list(frames.decode_frames(data[:-1]))) == 3


def test_damage_raises():
    data = bytearray(log())
    data[14] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        list(frames.decode_frames(bytes(data)))
    data = bytearray(log())
    data[0] ^= 1
    with pytest.raises(ValueError, match="magic"):
        list(frames.decode_frames(bytes(data)))
    assert list(frames.decode_frames(bytes(data), permissive=True)) == []


def test_log_source(spark, tmp_path):
    frames.register(spark)
    df = spark.createDataFrame(ROWS, "key BINARY, value BINARY, ts BIGINT, op STRING").coalesce(1)
    df.write.format("wal").mode("append").save(str(tmp_path / "log"))
    got = frames.read_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(bytes(r.key), r.value if r.value is None else bytes(r.value), r.ts, r.op) for r in got] == ROWS


def test_segment_source(spark, tmp_path):
    frames.register(spark)
    rows = [(bytes([k]), bytes([k, k]), k) for k in (0, 1, 127, 128, 255)]
    df = spark.createDataFrame(rows, "key BINARY, value BINARY, ts BIGINT").coalesce(1).sortWithinPartitions("key")
    df.write.format("segment").mode("append").save(str(tmp_path / "seg"))
    got = frames.read_segment(spark, str(tmp_path / "seg")).where("key >= X'01' AND key < X'80'").orderBy("key").collect()
    assert [r.ts for r in got] == [1, 127]
    with pytest.raises(Exception, match="must increase"):
        df.sortWithinPartitions("ts", ascending=False).write.format("segment").mode("append").save(str(tmp_path / "bad"))


def test_log_files_and_batches_are_bounded(spark, tmp_path):
    """Before: a task's log was one file, decoded into one batch."""
    frames.register(spark)
    rows = [(str(k).encode(), b"v" * (k % 90), k, "PUT" if k % 7 else "DELETE") for k in range(3000)]
    df = spark.createDataFrame(rows, "key BINARY, value BINARY, ts BIGINT, op STRING").coalesce(1)
    df.write.format("wal").mode("append").option("fileBytes", 20_000).save(str(tmp_path / "log"))
    sizes = [p.stat().st_size for p in (tmp_path / "log").glob("part-*.bin")]
    assert len(sizes) > 5 and max(sizes) < 20_200 and not list((tmp_path / "log").glob(".*[!c]"))
    got = frames.read_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r.ts, bytes(r.key), r.op) for r in got) == [(t, k, op) for k, _, t, op in rows]
    assert all(r.value == (None if r.op == "DELETE" else b"v" * (r.ts % 90)) for r in got)
    df.limit(0).write.format("wal").mode("append").save(str(tmp_path / "none"))
    assert frames.read_log(spark, str(tmp_path / "none")).count() == 0
    some = list(frames._some(frames.decode_frames(log(ROWS * 5000))))
    assert max(map(len, some)) <= frames.BATCH_ROWS and max(sum(len(r[2] or b"") for r in x) for x in some) < frames.BATCH_BYTES + 10_001
    assert [r[1:] for x in some for r in x] == ROWS * 5000


def test_torn_logs_are_streamed(spark, tmp_path):
    """Before: all frames of a batch of users were Python objects at once, and a null user failed."""
    from tidewell.plans import catalogue

    rows = [(k, None if k % 5 == 0 else k % 3, None if k % 4 == 0 else "view") for k in range(400)]
    spark.createDataFrame(rows, "event_id BIGINT, user_id BIGINT, event_type STRING").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["wal_truncated_tail"](spark, str(tmp_path))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = [(u, sum(r[1] == u for r in rows)) for u in (None, 0, 1, 2)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
