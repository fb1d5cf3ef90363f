"""Scalar functions as Spark expressions: hashes, checksums, encoded sizes, key formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithms.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME_LOW = 14695981039346656037, 435
SHARDS = 256
HASH_HEADER, WAL_HEADER, SST_HEADER, MEMTABLE_OVERHEAD, PAGE_SIZE, PAGE_HEADER, SLOT = 20, 21, 9, 16, 4096, 10, 2


def byte_values(text: Column) -> Column:
    """The bytes of a string or binary as an array of longs; empty for an empty one."""
    digits = F.hex(text.cast("binary"))
    n = F.octet_length(text)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a32(text: Column) -> Column:
    return F.aggregate(byte_values(text), F.lit(FNV32_OFFSET).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(0xFFFFFFFF))


def shard(key: Column, shards: int = SHARDS) -> Column:
    return (fnv1a32(key) % shards).cast("int")


def _limbs(value: int) -> Column:
    return F.struct(F.lit(value >> 32).cast("long").alias("hi"), F.lit(value & 0xFFFFFFFF).cast("long").alias("lo"))


def _times_prime64(h: Column) -> Column:
    """h * (2**40 + 435) modulo 2**64, in 32-bit limbs: no product leaves a long."""
    low = h["lo"] * FNV64_PRIME_LOW
    high = h["hi"] * FNV64_PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(h["lo"].bitwiseAND(0xFFFFFF), 8)
    return F.struct(high.bitwiseAND(0xFFFFFFFF).alias("hi"), low.bitwiseAND(0xFFFFFFFF).alias("lo"))


def _with_byte(h: Column, b: Column) -> Column:
    return F.struct(h["hi"].alias("hi"), h["lo"].bitwiseXOR(b).alias("lo"))


def fnv64_limbs(text: Column, *, xor_first: bool) -> Column:
    """FNV-1a (xor first) or FNV-1 with 64 bits, as a struct (hi, lo) of unsigned 32-bit halves."""
    step = (lambda h, b: _times_prime64(_with_byte(h, b))) if xor_first else (lambda h, b: _with_byte(_times_prime64(h), b))
    return F.aggregate(byte_values(text), _limbs(FNV64_OFFSET), step)


def _limbs_mod(h: Column, m: Column | int) -> Column:
    """(hi * 2**32 + lo) modulo m, for m below 2**31."""
    m = m if isinstance(m, Column) else F.lit(m)
    return ((h["hi"] % m) * (F.lit(1 << 32) % m) + h["lo"] % m) % m


def bloom_positions(key: Column, n_bits: int, n_hashes: int) -> Column:
    """Bit positions of a key: (h1 + i * h2) mod 2**64 mod n_bits, with h1 FNV-1a and h2 FNV-1."""
    a, b = fnv64_limbs(key, xor_first=True), fnv64_limbs(key, xor_first=False)

    def at(i: Column) -> Column:
        low = a["lo"] + i * b["lo"]
        high = (a["hi"] + i * b["hi"] + F.shiftright(low, 32)).bitwiseAND(0xFFFFFFFF)
        return _limbs_mod(F.struct(high.alias("hi"), low.bitwiseAND(0xFFFFFFFF).alias("lo")), n_bits)

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n_hashes - 1).cast("long")), at)


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes of a filter for n keys at a false-positive rate p; at least 1 each."""
    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / max(n, 1) * math.log(2)))


def bloom_bits(n: Column, p: Column | float) -> Column:
    p = p if isinstance(p, Column) else F.lit(p)
    return F.greatest(F.lit(1), F.ceil(-n * F.ln(p) / F.pow(F.ln(F.lit(2.0)), F.lit(2)))).cast("long")


def bloom_hashes(n: Column, bits: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(bits / n * F.ln(F.lit(2.0)))).cast("long")


def crc32(payload: Column) -> Column:
    return F.crc32(payload.cast("binary"))


def varint_size(n: Column) -> Column:
    """Bytes of an unsigned LEB128 of up to three bytes."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).otherwise(3)


def uvarint(n: Column) -> Column:
    """The LEB128 bytes of an unsigned int of up to five groups, as upper-case hex."""
    groups = [F.shiftright(n.cast("long"), 7 * i) for i in range(5)]
    parts = [F.when((n >= 1 << 7 * i) | F.lit(i == 0), F.lpad(F.hex(g.bitwiseAND(0x7F) + F.when(g >= 128, 128).otherwise(0)), 2, "0")) for i, g in enumerate(groups)]
    return F.concat_ws("", *parts)


def key_bytes(key: Column) -> Column:
    return F.coalesce(F.octet_length(key), F.lit(0)).cast("long")


def hash_record_size(key: Column, value: Column) -> Column:
    return key_bytes(key) + key_bytes(value) + HASH_HEADER


def wal_record_size(key: Column, value: Column) -> Column:
    return key_bytes(key) + key_bytes(value) + WAL_HEADER


def sst_entry_size(key: Column, value: Column) -> Column:
    return key_bytes(key) + key_bytes(value) + SST_HEADER


def memtable_size(key: Column, value: Column) -> Column:
    return key_bytes(key) + key_bytes(value) + MEMTABLE_OVERHEAD


def leaf_cell_size(key: Column, value: Column) -> Column:
    k, v = key_bytes(key), key_bytes(value)
    return varint_size(k) + varint_size(v) + k + v


def internal_cell_size(key: Column) -> Column:
    k = key_bytes(key)
    return varint_size(k) + 4 + k


def page_fits(used_cell_bytes: Column, n_cells: Column, cell: Column) -> Column:
    """Has a page with n cells room for one more and its directory slot."""
    free = F.lit(PAGE_SIZE) - used_cell_bytes - (F.lit(PAGE_HEADER) + SLOT * (n_cells + 1))
    return free >= cell


def user_key(number: Column, width: int = 10) -> Column:
    return F.concat(F.lit("user:"), F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(F.lpad(number.cast("string"), width, "0")))


def fixed_width(key: Column, size: int) -> Column:
    """Padded with zero characters or cut to a number of bytes (ASCII keys)."""
    return F.rpad(key, size, "0")


def shorten(text: Column, width: int) -> Column:
    """For display: at most ``width`` characters, the last three dots."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
