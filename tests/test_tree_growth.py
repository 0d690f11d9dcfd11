"""Tree queries make no pairs of nodes, on trees of any size and with nulls."""

import random
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from test_trees import built

from tidewell.operators import trees
from tidewell.plans import catalogue

NODES = "tree BIGINT, seq BIGINT, value DOUBLE"


def test_shape_joins_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 1.0)], NODES)
    assert "Join" not in trees.shape(rows)._jdf.queryExecution().toString()


def test_large_trees(spark):
    """Before: 400 million pairs for a tree of 20,000 nodes."""
    n, some = 20_000, random.Random(1)
    mixed = [(s, float(some.randrange(2_000))) for s in range(4_000)]
    rows = [(0, s, float(s)) for s in range(n)] + [(1, s, float(-s)) for s in range(n)] + [(2, s, v) for s, v in mixed]
    some.shuffle(rows)
    got = {(r.tree, r.seq): r for r in trees.shape(spark.createDataFrame(rows, NODES)).collect()}
    for s in range(n):
        up = s - 1 if s else None
        assert got[0, s][3:] == (s + 1, up, s, s, n - 1 - s)
        assert got[1, s][3:] == (s + 1, up, s, n - 1 - s, n - 1 - s)
    at, pre, post = built(mixed)
    assert {s: got[2, s][3:5] for s in at} == at
    assert [got[2, s].pre for s in pre] == [got[2, s].post for s in post] == list(range(len(mixed)))


@pytest.mark.parametrize("name", ["shape", "height", "width", "preorder", "postorder", "flatten"])
def test_nulls_as_in_sql(spark, tmp_path, name):
    some = random.Random(2)
    rows = [(s, some.choice([None, 1, 2]), some.choice([None, 0.0, -0.0, 1.5, 2.5, 3.5])) for s in range(60)]
    spark.createDataFrame(rows, "event_id BIGINT, user_id BIGINT, value DOUBLE").write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES[f"bst_{name}"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLE_SQL[f'bst_{name}']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


class Held:
    """Rows whose mapInArrow gives back the function."""

    schema = T.StructType().add("tree", "long").add("seq", "long").add("value", "double")

    def mapInArrow(self, run, schema):
        return run


def test_stack_of_a_path_is_small():
    """Before: a list of integers, 10 MB here; now 4 MB."""
    n, size = 200_000, 2_000
    batches = [pa.record_batch({"tree": [1] * size, "seq": list(range(at, at + size)), "value": [0.0] * size}) for at in range(1 << 40, (1 << 40) + n, size)]
    run = trees._stacked(Held(), "a")
    list(run(batches[:1]))
    tracemalloc.start()
    for out in run(batches):
        last = out.slice(out.num_rows - 1).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (last["a_r"], last["a_up"], last["a_seq"], last["a_below"]) == (n, n - 1, (1 << 40) + n - 2, 0)
    assert peak < 6e6


@pytest.mark.parametrize("name", ["shape", "preorder", "postorder"])
@pytest.mark.parametrize("kind", ["bst", "bst_all"])
def test_events_are_dealt_once(spark, kind, name):
    """Before: joins of all pairs of a tree's events, dealt out again."""
    plan = catalogue.QUERIES[f"{kind}_{name}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
