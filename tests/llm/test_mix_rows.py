"""The mix keeps every column, and takes equal rows as the plan says."""

import collections

from pyspark.sql import functions as F

from tidewell.llm import mixing


def test_columns_of_any_name_and_type(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    for c in ("_key", "_n", "_times", "_copy", "_copies", "_each", "key", "row", "times", "chunk", "copy", "part", "n"):
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    df = df.withColumn("m", F.create_map(F.lit("a"), "doc_id")).withColumn("deep", F.array(F.struct(F.create_map(F.lit("b"), "doc_id").alias("x"))))
    got = mixing.mix(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    rows = got.collect()
    assert rows and all(r["_key"] == f"_key{r.doc_id}" and r.m == {"a": r.doc_id} and r.deep[0].x == {"b": r.doc_id} for r in rows)
    want = collections.Counter({r.doc_id: r.copies for r in mixing.plan(df).collect() if r.copies})
    assert collections.Counter(r.doc_id for r in rows) == want


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 10)
    df = spark.range(400).select((F.col("id") * 0 + 1).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    df = df.union(spark.range(50).select(F.col("id") + 5, F.lit("d e"), F.lit("y"))).union(spark.range(2).select(F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    plans = [sorted(map(tuple, mixing.plan(x).collect()), key=repr) for x in (df.repartition(5), df.coalesce(1))]
    assert plans[0] == plans[1] and len(plans[0]) == 452
    ones = [r for r in plans[0] if r[2] == 1]
    assert sorted(r[1] for r in ones) == list(range(1, 401))
    mixed = collections.Counter(r.doc_id for r in mixing.mix(df).collect())
    assert mixed[1] == sum(r[-1] for r in ones) and mixed[None] == 0
