"""Searches, edits and folds over array columns, as expressions. Positions are zero-based."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(a: Column, x: Column) -> Column:
    """First position of x, null if absent (also for a sorted array: there is nothing to bisect in one row)."""
    return F.nullif(F.array_position(a, x), F.lit(0)) - 1


def index_or_minus_one(a: Column, x: Column) -> Column:
    return F.coalesce(index_of(a, x), F.lit(-1))


def last_index_or_minus_one(a: Column, x: Column) -> Column:
    at = F.array_position(F.reverse(a), x)
    return F.when(at > 0, F.size(a) - at).otherwise(-1)


def occurrences(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def argmax(a: Column) -> Column:
    """Position of the greatest element; an empty array is an error."""
    return F.when(F.size(a) == 0, F.raise_error(F.lit("argmax of an empty array"))).otherwise(F.array_position(a, F.array_max(a)) - 1)


def rotate(a: Column, k: Column) -> Column:
    """k places to the right (negative: left); an empty array stays empty."""
    n = F.size(a)
    s = F.pmod(k, F.greatest(n, F.lit(1))).cast("int")
    return F.when((n == 0) | (s == 0), a).otherwise(F.concat(F.slice(a, n - s + 1, F.greatest(s, F.lit(1))), F.slice(a, F.lit(1), n - s)))


def prepend(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def append(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def insert(a: Column, at: Column, x: Column) -> Column:
    """x at a position; past the end nothing happens."""
    return F.when(at > F.size(a), a).otherwise(F.concat(F.slice(a, F.lit(1), at), F.array(x), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))))


def remove_first(a: Column, x: Column) -> Column:
    """Without the first x, at the head too."""
    at = F.array_position(a, x).cast("int")
    return F.when(at == 0, a).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))))


def take(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def drop(a: Column, n: Column) -> Column:
    """After the first n; null when nothing is left to split off."""
    return F.when(n >= F.size(a), F.lit(None)).otherwise(F.slice(a, (n + 1).cast("int"), F.size(a)))


def pop(a: Column) -> Column:
    """Without its last element; an empty array is an error."""
    return F.when(F.size(a) == 0, F.raise_error(F.lit("pop from an empty array"))).otherwise(F.slice(a, F.lit(1), F.size(a) - 1))


def pop_left(a: Column) -> Column:
    return F.when(F.size(a) == 0, F.raise_error(F.lit("pop from an empty array"))).otherwise(F.slice(a, F.lit(2), F.size(a)))


def element(a: Column, at: Column) -> Column:
    """Element at a position, null past the end."""
    return F.get(a, at)


def union_first_seen(a: Column, b: Column) -> Column:
    """Distinct elements of both, in the order first seen."""
    return F.array_union(a, b)


def missing(a: Column, n: Column) -> Column:
    """Numbers of [0, n) that the array lacks."""
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_except(all_, a)


def first_n(n: Column) -> Column:
    """0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
