"""Lookups in the sparse index of many segments against a plain search."""

from pyspark.sql import functions as F

from tidewell.operators import kv


def test_every_segment_is_probed(spark):
    keys = [(k // 1000, k) for k in range(3, 4500, 3) if not 2000 <= k < 3000]
    rows = spark.createDataFrame(keys, "segment BIGINT, key BIGINT")
    index = kv.sparse_index(rows, ["key"], F.lit(10), every=7, by=["segment"])
    stats = rows.groupBy("segment").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    probes = spark.range(0, 5000, 11).select(F.col("id").alias("probe"))
    want = set()
    for p in range(0, 5000, 11):
        own = sorted(k for s, k in keys if s == p // 1000)
        held = bool(own) and own[0] <= p <= own[-1]
        at = sum(k <= p for k in own) - 1
        want.add((p, p // 1000, at // 7 * 7 * 10) if held else (p, None, 0))
    got = kv.segment_seek(index, stats, probes, "key", "probe", ["segment"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len({r.segment for r in got if r.segment is not None}) == 4
