"""Regions of leaks against an exhaustive alignment, for short and very long items."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontaminate
from tidewell.llm.decontaminate import RATE, Benchmark, normalise


def made(r, n):
    out = ""
    while len(out) < n:
        out += "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) + " "
    return out[:n].strip()


def least_edits(text, item):
    """Least edit distance between the item and any region of the text."""
    t, p = (normalise([x])[0][:-1] for x in (text, item))
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(p, 1):
        best = np.minimum(row[:-1] + (t != c), row[1:] + 1)
        best = np.concatenate(([i], best))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row.min())


def test_leaks_match_exhaustive_alignment():
    r, items, texts = random.Random(1), [], []
    items = [(k, made(r, n)) for k, n in enumerate((45, 60, 90, 150, 300, 700))]
    for k in range(40):
        s = list(r.choice(items)[1])
        for _ in range(r.randrange(int(len(s) * RATE * 1.6) + 1)):
            at = r.randrange(len(s))
            s[at : at + r.choice([0, 1])] = r.choice(["", "z", "q9"])
        texts.append(made(r, r.randrange(200)) + " " + "".join(s) + " " + made(r, r.randrange(200)))
    found = {(d, i): e for d, i, _, _, e in Benchmark(items).find(texts)}
    for d, t in enumerate(texts):
        for i, item in items:
            least, size = least_edits(t, item), len(normalise([item])[0]) - 1
            if least <= int(RATE * size):
                assert found.get((d, i)) == least, (d, i)
            else:
                assert (d, i) not in found


@pytest.mark.parametrize("size", [400, 3600, 8000, 20000])
def test_regions_of_long_items(size):
    r = random.Random(size)
    item, other = made(r, size), made(r, 60000 if size == 400 else 500)
    for lead in (0, 102, 5001):
        before = made(r, lead) + " " if lead else ""
        s = list(item)
        for k in range(size // 100):
            s[50 + 97 * k] = "z"
        changed = sum(a != b for a, b in zip(s, item))
        (_, i, start, end, edits), = Benchmark([(7, item), (8, other)]).find([before + "".join(s) + " " + made(r, 300)])
        assert i == 7 and abs(start - len(before)) <= 2 and abs(end - len(before) - size) <= 2 and edits <= changed


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, "x", 5, {"a": 1}), (1, None, 6, None), (None, "", 7, {})], "doc_id BIGINT, text STRING, edits INT, item_id MAP<STRING, INT>")
    bench = spark.createDataFrame([(1, "some item of the benchmark that is long enough")], "item_id BIGINT, text STRING")
    assert decontaminate.clean(df, bench).columns == df.columns and decontaminate.clean(df, bench).count() == 3
    twice = spark.createDataFrame([(1, bench.first().text), (1, bench.first().text)], "doc_id BIGINT, text STRING").withColumn("edits", F.lit(1))
    assert decontaminate.leaks(twice, bench).count() == 2 and decontaminate.clean(twice, bench).isEmpty()
