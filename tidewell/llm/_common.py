"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans.shared import materialize, new_path

__all__ = ["hash_words", "materialize", "mix64", "new_path", "pieces_by_bytes", "prefix_sums", "slices_by_bytes", "text_or_empty", "word_codes", "words_of"]

#: Bytes that end a word: everything in ASCII but letters and digits; upper case becomes lower case.
_WORD_TABLE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of a text, as UTF-8; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces_by_bytes(texts: list, most: int = 4_000_000):
    """Index ranges of consecutive texts of about `most` characters together (a longer text stands alone)."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def slices_by_bytes(batch, column: int, most: int):
    """Slices of an Arrow batch with about `most` bytes of a text column together (a longer text stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def word_codes(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of all texts as codes into a list of distinct words, and how many each text has."""
    seen: dict[bytes, int] = {}
    put, codes, counts = seen.setdefault, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        counts[i] = len(w)
        codes.extend([put(x, len(seen)) for x in w])
    return np.array(codes, np.int64), counts, list(seen)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, fan: int = 4096) -> DataFrame:
    """Exclusive prefix sums of `value` over few rows (one per shard), in two levels so that no window holds them all.

    `order` must name a dense integer first column; blocks of `fan` of it are summed apart.
    """
    from pyspark.sql import Window

    block = F.floor(F.col(order[0]) / fan)
    within = Window.partitionBy("_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_blk", block)
    over = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_blk").agg(F.sum(value).alias("_s")).select(
        F.col("_blk").alias("_b"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_off")
    )
    return (
        rows.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(base, F.col("_blk") == F.col("_b"))
        .withColumn(out, F.col(out) + F.col("_off"))
        .drop("_blk", "_b", "_off")
    )
