"""Bloom filters over keys, as one row with the bits packed in a binary column."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.scalars import bloom_positions, bloom_size


def build(keys: DataFrame, key: str = "key", *, n: int | None = None, p: float = 0.01) -> tuple[int, int, DataFrame]:
    """(bits, hashes, set words): words of 32 bits, one row for each word that isn't zero.

    The filter stays a distributed table, so its size has no bound. ``n`` is the number of keys if
    it is known; else they are counted.
    """
    count = keys.select(key).distinct().count() if n is None else n
    bits, hashes = bloom_size(count, p)
    at = keys.select(F.explode(bloom_positions(F.col(key), bits, hashes)).alias("bit"))
    words = at.groupBy(F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("mask"))
    return bits, hashes, words


def may_contain(probes: DataFrame, bits: int, hashes: int, words: DataFrame, key: str = "key") -> DataFrame:
    """``probes`` with ``may_contain``: false means that the key isn't in the set."""
    at = probes.select(key).distinct().select(key, F.explode(bloom_positions(F.col(key), bits, hashes)).alias("bit"))
    at = at.select(key, F.floor(F.col("bit") / 32).alias("word"), (F.col("bit") % 32).cast("int").alias("shift"))
    hit = F.coalesce(F.expr("shiftright(mask, shift)").bitwiseAND(1), F.lit(0))
    found = at.join(words, "word", "left").groupBy(key).agg((F.min(hit) == 1).alias("may_contain"))
    return probes.join(found, key, "left").withColumn("may_contain", F.coalesce("may_contain", F.lit(False)))  # a null key is in no set


def encode(bits: int, hashes: int, words: dict[int, int]) -> bytes:
    """Bits and hashes as little-endian 32-bit numbers, then the bits; for filters of one run."""
    body = bytearray(-(-bits // 8))
    for word, mask in words.items():
        for i, b in enumerate(mask.to_bytes(4, "little")):
            if b:
                body[word * 4 + i] = b
    return struct.pack("<II", bits, hashes) + bytes(body)


def decode(raw: bytes) -> tuple[int, int, dict[int, int]]:
    if len(raw) < 8:
        raise ValueError("a filter has a header of 8 bytes")
    bits, hashes = struct.unpack_from("<II", raw)
    body = raw[8:]
    if len(body) != -(-bits // 8):
        raise ValueError("the number of bits doesn't fit the data")
    words = {i // 4: int.from_bytes(body[i : i + 4], "little") for i in range(0, len(body), 4)}
    return bits, hashes, {w: m for w, m in words.items() if m}


def contains(key: Column, encoded: bytes) -> Column:
    """Membership in one encoded filter, as an expression; for a filter of a run that is being pruned."""
    bits, hashes, _ = decode(encoded)
    body = F.lit(encoded[8:].hex().upper())
    digit = lambda b: F.conv(F.substring(body, (F.floor(b / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return F.forall(bloom_positions(key, bits, hashes), lambda b: (F.floor(digit(b) / F.pow(F.lit(2), b % 8)) % 2) == 1)
