"""Bloom filters as expressions: bit positions, filters as bit tables, probes."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n keys at false-positive rate p."""
    n = max(1, n)
    m = max(1, int(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, int(m / n * math.log(2)))


def position(key: Column, i: Column, m: int) -> Column:
    """Bit of hash i: the first 4 bytes of SHA-256(i as u32 little-endian, key), little-endian, modulo m."""
    le = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(i, 8 * b).bitwiseAND(255)), 2, "0") for b in range(4))))
    digest = F.sha2(F.concat(le, key), 256)
    first = F.concat(*(F.substring(digest, 7 - 2 * b, 2) for b in range(4)))
    return F.pmod(F.conv(first, 16, 10).cast("bigint"), F.lit(m))


def bits(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """Distinct set bits of the filter of a key column (binary)."""
    return keys.select(F.col(key).alias("_key")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(position(F.col("_key"), F.col("_i"), m).alias("bit")).distinct()


def probe(filter_bits: DataFrame, keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """Per key whether all its bits are set (maybe), never false for a key of the filter."""
    asked = keys.select(F.col(key).alias("key")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("key", position(F.col("key"), F.col("_i"), m).alias("bit"))
    hit = asked.join(filter_bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg(F.bool_and(F.col("_set").isNotNull()).alias("maybe"))


_HEADER = struct.Struct("<BIQII")  # version, keys, rate x 1e9, bits, hashes: 21 bytes


def serialize(bit_positions: list[int], n: int, p: float) -> bytes:
    """A filter as bytes: a 21-byte header, then the bit array."""
    m, k = parameters(n, p)
    data = bytearray((m + 7) // 8)
    for b in bit_positions:
        data[b >> 3] |= 1 << (b & 7)
    return _HEADER.pack(1, n, int(p * 1e9), m, k) + bytes(data)


def deserialize(data: bytes) -> tuple[set[int], int, float, int, int]:
    """(set bits, n, p, m, k); ValueError for another version."""
    version, n, p, m, k = _HEADER.unpack_from(data)
    if version != 1:
        raise ValueError(f"filter version {version} is not supported")
    raw = data[_HEADER.size :]
    return {b for b in range(m) if raw[b >> 3] >> (b & 7) & 1}, n, p / 1e9, m, k
