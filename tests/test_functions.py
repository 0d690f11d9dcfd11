import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import arrays, retry, stats, text


def one(spark, column, **values):
    names, kinds = zip(*((f"{k} {t}", v) for (k, (t, v)) in values.items())) if values else (("x INT",), (0,))
    return spark.createDataFrame([kinds], ", ".join(names)).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("s, ok", [("", True), ("()[]{}", True), ("([{}])", True), ("(a[b]{c})", True), ("(]", False), ("((", False), ("))", False), ("([)]", False), ("}{", False)])
def test_balanced(spark, s, ok):
    assert one(spark, text.balanced(F.col("s")), s=("STRING", s)) is ok


@pytest.mark.parametrize("s, v", [("3 4 +", 7.0), ("5 1 2 + 4 * + 3 -", 14.0), ("8 2 /", 4.0), ("2 3 -", -1.0), ("7", 7.0), ("1.5 2 *", 3.0)])
def test_postfix(spark, s, v):
    assert one(spark, text.postfix(F.col("s")), s=("STRING", s)) == v


def test_postfix_divides_by_zero(spark):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, text.postfix(F.col("s")), s=("STRING", "1 0 /"))


@pytest.mark.parametrize("s, out", [("tree", "ert"), ("cccaaa", "ac"), ("Aabb", "bAa"), ("", "")])
def test_by_frequency(spark, s, out):
    assert "".join(one(spark, text.by_frequency(F.col("s")), s=("STRING", s))) == out


@pytest.mark.parametrize("a, k, out", [([1, 2, 3, 4], 1, [4, 1, 2, 3]), ([1, 2, 3, 4], 6, [3, 4, 1, 2]), ([1, 2, 3], -1, [2, 3, 1]), ([], 3, []), ([1, 2], 0, [1, 2]), ([1, 2], 2, [1, 2])])
def test_rotate(spark, a, k, out):
    assert one(spark, arrays.rotate(F.col("a"), F.col("k")), a=("ARRAY<INT>", a), k=("INT", k)) == out


def test_array_edits(spark):
    a = dict(a=("ARRAY<INT>", [1, 2, 3, 2]))
    assert one(spark, arrays.index_of(F.col("a"), F.lit(2)), **a) == 1
    assert one(spark, arrays.index_of(F.col("a"), F.lit(9)), **a) is None
    assert one(spark, arrays.index_or_minus_one(F.col("a"), F.lit(9)), **a) == -1
    assert one(spark, arrays.last_index_or_minus_one(F.col("a"), F.lit(2)), **a) == 3
    assert one(spark, arrays.insert(F.col("a"), F.lit(1), F.lit(7)), **a) == [1, 7, 2, 3, 2]
    assert one(spark, arrays.insert(F.col("a"), F.lit(9), F.lit(7)), **a) == [1, 2, 3, 2]
    assert one(spark, arrays.remove_first(F.col("a"), F.lit(1)), **a) == [2, 3, 2]
    assert one(spark, arrays.remove_first(F.col("a"), F.lit(2)), **a) == [1, 3, 2]
    assert one(spark, arrays.pop(F.col("a")), **a) == [1, 2, 3]
    assert one(spark, arrays.pop_left(F.col("a")), **a) == [2, 3, 2]
    assert one(spark, arrays.drop(F.col("a"), F.lit(4)), **a) is None
    assert one(spark, arrays.missing(F.col("a"), F.lit(6)), **a) == [0, 4, 5]
    assert one(spark, arrays.first_n(F.lit(3))) == [0, 1, 2] and one(spark, arrays.first_n(F.lit(0))) == []
    with pytest.raises(Exception, match="empty array"):
        one(spark, arrays.pop(F.col("a")), a=("ARRAY<INT>", []))


@pytest.mark.parametrize("lam, k", [(2.0, 0), (2.0, 3), (0.5, 1), (10.0, 30), (3.3, 7)])
def test_poisson(spark, lam, k):
    p = [math.exp(-lam) * lam**i / math.factorial(i) for i in range(k + 1)]
    for f, v in ((stats.pmf, p[-1]), (stats.at_most, sum(p)), (stats.less, sum(p[:-1])), (stats.more, 1 - sum(p)), (stats.at_least, 1 - sum(p[:-1]))):
        assert one(spark, f(F.col("l"), F.col("k")), l=("DOUBLE", lam), k=("INT", k)) == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_retry():
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert retry.retry(fails, 5, 1.0, 10.0, False, waits.append) == "done" and waits == [1.0, 2.0]
    assert retry.retry(fails, 0) is None
    with pytest.raises(ZeroDivisionError):
        retry.retry(lambda: 1 / 0, 2, sleep=waits.append)
    assert retry.delay(10, 1.0, 60.0) == 60.0
