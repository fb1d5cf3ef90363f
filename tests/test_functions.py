"""Scalars, Bloom filters, statistics and workloads against plain Python."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from logstrata.functions import bloom
from logstrata.functions import scalars as S
from logstrata.operators import ordered, stats, workload
from tests.kvmodel import frame, log


def fnv32(text):
    h = S.FNV32_OFFSET
    for b in text.encode():
        h = (h ^ b) * S.FNV32_PRIME & 0xFFFFFFFF
    return h


def fnv64(raw, xor_first):
    h = S.FNV64_OFFSET
    for b in raw:
        h = (h ^ b) * 1099511628211 & (1 << 64) - 1 if xor_first else (h * 1099511628211 & (1 << 64) - 1) ^ b
    return h


KEYS = ["", "a", "key1", "user:0000000042", "é~", "x" * 40]


def test_hashes(spark):
    df = spark.createDataFrame([(k,) for k in KEYS], "key string")
    row = df.select("key", S.fnv1a32(F.col("key")).alias("h"), S.shard(F.col("key")).alias("s"), S.crc32(F.col("key")).alias("c"), S.fnv64_limbs(F.col("key"), xor_first=True).alias("a"), S.fnv64_limbs(F.col("key"), xor_first=False).alias("b"), S.bloom_positions(F.col("key"), 9586, 7).alias("p"))
    for r in row.collect():
        raw = r.key.encode()
        assert r.h == fnv32(r.key)
        assert r.s == fnv32(r.key) % 256
        assert r.c == zlib.crc32(raw)
        one, two = fnv64(raw, True), fnv64(raw, False)
        assert (r.a.hi << 32 | r.a.lo, r.b.hi << 32 | r.b.lo) == (one, two)
        assert r.p == [(one + i * two) % (1 << 64) % 9586 for i in range(7)]
    assert fnv32("key1") == 927623783


def test_varints(spark):
    values = [0, 127, 128, 16383, 16384, 65535, 1 << 21]

    def leb(n):
        out = b""
        while n >= 128:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", S.varint_size(F.col("n")).alias("size"), S.uvarint(F.col("n")).alias("hex")).collect()
    assert [r.size for r in got][:6] == [1, 1, 2, 2, 3, 3]
    assert all(r.hex == leb(r.n).hex().upper() for r in got)


def test_sizes(spark):
    assert S.bloom_size(1000, 0.01) == (9586, 7)
    df = spark.createDataFrame([("é1", "v" * 200), ("k", None)], "k string, v string")
    k, v = F.col("k"), F.col("v")
    got = df.select(S.hash_record_size(k, v), S.wal_record_size(k, v), S.sst_entry_size(k, v), S.memtable_size(k, v), S.leaf_cell_size(k, v), S.internal_cell_size(k)).collect()
    assert list(got[0]) == [223, 224, 212, 219, 1 + 2 + 203, 1 + 4 + 3]
    assert list(got[1]) == [21, 22, 10, 17, 3, 6]
    shown = spark.createDataFrame([("abcdefghij",), ("abc",)], "t string").select(S.shorten(F.col("t"), 8)).collect()
    assert [r[0] for r in shown] == ["abcde...", "abc"]
    assert spark.range(1).select(S.user_key(F.lit(42)), S.user_key(F.lit(12345678901)), S.fixed_width(F.lit("abc"), 5)).first()[:] == ("user:0000000042", "user:12345678901", "abc00")


def test_bloom(spark):
    keys = spark.range(2000).select(S.user_key(F.col("id")).alias("key"))
    bits, hashes, words = bloom.build(keys, p=0.01)
    assert bloom.may_contain(keys, bits, hashes, words).where("not may_contain").count() == 0
    others = spark.range(2000, 6000).select(S.user_key(F.col("id")).alias("key"))
    assert bloom.may_contain(others, bits, hashes, words).where("may_contain").count() < 4000 * 0.03
    raw = bloom.encode(bits, hashes, {r.word: r.mask for r in words.collect()})
    assert struct.unpack_from("<II", raw) == (bits, hashes)
    assert bloom.decode(raw)[:2] == (bits, hashes)
    few = keys.limit(20)
    assert few.where(~bloom.contains(F.col("key"), raw)).count() == 0
    with pytest.raises(ValueError):
        bloom.decode(raw[:-1])


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "at long, n long")
    got = ordered.running_sum(df, "at", F.col("n"), "s", blocks=5).orderBy("at").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.s == total
    assert [r.k for r in ordered.row_numbers(df, "at", "k", base=3).orderBy("at").collect()] == list(range(4, 105))

    nxt = {r.at: r.m for r in ordered.following(df, "at", "n", "m", blocks=5).collect()}
    by = {r.at: r.n for r in df.collect()}
    assert nxt == {a: by.get(a + 1) for a in by}


def test_statistics(spark):
    ops = log(*[(f"key{i}", f"value{i}") for i in range(100)], *[(f"key{i}", f"updated-value{i}") for i in range(50)])
    row = stats.amplification(frame(spark, ops)).first()
    assert (row.n_ops, row.n_keys) == (150, 100)
    assert row.space_amp >= 1
    assert row.write_amp >= 1
    empty = stats.amplification(frame(spark, [])).first()
    assert (empty.space_amp, empty.write_amp) == (1.0, 1.0)
    many = log(*[(f"key{i}", f"round{r}-value{i}") for r in range(11) for i in range(50)])
    assert stats.amplification(frame(spark, many)).first().space_amp > 3
    used = stats.within_budget(spark.createDataFrame([(1, 5), (2, 6), (3, -4)], "at long, n long"), 8, order="at", size="n").orderBy("at").collect()
    assert [(r.in_use, r.fits) for r in used] == [(5, True), (11, False), (7, True)]
    spread = stats.shard_distribution(spark.range(10_000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))).collect()
    assert len(spread) == 256


def test_percentiles(spark):
    df = spark.range(100).select(F.lit("w").alias("w"), F.col("id").cast("double").alias("x"))
    row = workload.latency_stats(df, "x", "w").first()
    assert (row.p50, row.p95, row.p99, row.p999, row.min, row.max, row.mean, row.n) == (50, 95, 99, 99, 0, 99, 49.5, 100)


def test_key_distributions(spark):
    n = 1000
    ids = spark.range(20_000)
    for kind in ("sequential", "uniform", "zipfian", "latest"):
        keys = [r[0] for r in ids.select(workload.key_number(F.col("id"), kind, n)).collect()]
        assert min(keys) >= 0
        assert max(keys) < n
        if kind == "sequential":
            assert keys[:3] == [1, 2, 3]
        if kind == "zipfian":
            assert keys.count(0) > 20 * keys.count(500)
        if kind == "latest":
            assert sum(k > n - 2 * 100 for k in keys) > 0.9 * len(keys)


def test_workloads(spark):
    assert workload.find("write-heavy").name == "write-heavy-uniform"
    with pytest.raises(ValueError):
        workload.find("no-such")
    made = workload.trace(spark, workload.find("balanced"), 10_000)
    assert abs(made.where("op = 'put'").count() / 10_000 - 0.5) < 0.03
    results = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "w string, e string, v double")
    table = {r.w: (r.x, r.y) for r in workload.compare(results, "w", "e", ["x", "y"], F.col("v")).collect()}
    assert table == {"a": (1.0, 2.0), "b": (3.0, None)}
