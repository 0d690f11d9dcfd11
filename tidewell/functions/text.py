"""String functions: bracket balance, postfix arithmetic, character counts, anagram keys, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brackets by the one that closes them.
PAIRS = {")": "(", "]": "[", "}": "{"}


def balanced(s: Column) -> Column:
    """Whether ()[]{} nest properly; other characters are ignored."""
    only = F.filter(F.split(F.regexp_replace(s, r"[^()\[\]{}]", ""), ""), lambda c: c != "")
    opener = F.create_map(*(F.lit(x) for kv in PAIRS.items() for x in kv))

    def step(stack: Column, c: Column) -> Column:
        shut = F.try_element_at(opener, c)
        fits = F.endswith(stack, shut)
        return F.when(stack == "!", stack).when(shut.isNull(), F.concat(stack, c)).when(fits, F.substr(stack, F.lit(1), F.length(stack) - 1)).otherwise("!")

    return F.aggregate(only, F.lit(""), step) == ""


def postfix(s: Column) -> Column:
    """Value of a postfix expression of + - * / over numbers; the second operand popped is the left one."""
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")

    def step(stack: Column, w: Column) -> Column:
        b, a = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        under = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0)))
        value = F.when(w == "+", a + b).when(w == "-", a - b).when(w == "*", a * b).when(w == "/", a / b)
        return F.when(w.isin("+", "-", "*", "/"), F.array_append(under, value)).otherwise(F.array_append(stack, w.try_cast("double")))

    return F.get(F.aggregate(words, F.expr("cast(array() as array<double>)"), step), F.lit(0))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def by_frequency(s: Column) -> Column:
    """Distinct characters, the most frequent first, ties by code point."""
    chars = characters(s)
    counted = F.transform(F.array_distinct(chars), lambda c: F.struct((-F.size(F.filter(chars, lambda d: d == c))).alias("n"), c.alias("c")))
    return F.transform(F.array_sort(counted), lambda x: x["c"])


def anagram_key(s: Column) -> Column:
    return F.array_join(F.array_sort(characters(s)), "")


def prefixes(s: Column) -> Column:
    """All prefixes, from the empty one to the whole string."""
    return F.transform(F.sequence(F.lit(0), F.length(s)), lambda n: F.substr(s, F.lit(1), n))
