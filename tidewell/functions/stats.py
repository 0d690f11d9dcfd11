"""Poisson probabilities and retry delays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _terms(lam: Column, k: Column) -> Column:
    """Sum of the probabilities of 0 .. k, for k >= 0, each from the one before."""
    start = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("s"))
    many = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * lam / i
        return F.struct(p.alias("p"), (a["s"] + p).alias("s"))

    return F.aggregate(many, start, step)


def pmf(lam: Column, k: Column) -> Column:
    """Probability of k events, 0 for k < 0."""
    return F.when(k < 0, 0.0).otherwise(_terms(lam, k)["p"])


def at_most(lam: Column, k: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(_terms(lam, k)["s"])


def less(lam: Column, k: Column) -> Column:
    return at_most(lam, k - 1)


def more(lam: Column, k: Column) -> Column:
    return 1 - at_most(lam, k)


def at_least(lam: Column, k: Column) -> Column:
    return 1 - less(lam, k)


def backoff(attempt: Column, base: float, cap: float, jitter: int | None = None) -> Column:
    """Delay before a retry: base doubled each attempt up to cap; jitter (a seed) then scales it by 0.5 to 1.5."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))
    return delay if jitter is None else delay * (F.rand(jitter) + 0.5)
