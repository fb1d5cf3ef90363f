"""Workloads without a clock: deterministic keys and operations, latency figures, comparison tables.

An operation is a function of its number, so a workload is the same on any
cluster and can be made by SQL elsewhere. ``u`` is a uniform number from a
linear congruential step of the operation's number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.scalars import user_key

_MODULUS = 1 << 31


@dataclass(frozen=True)
class Workload:
    name: str
    write_share: float
    distribution: str = "uniform"
    n_keys: int = 50_000
    value_size: int = 100


#: Names with and without the distribution are known.
QUICK = [Workload("write-heavy-uniform", 0.95), Workload("read-heavy-zipfian", 0.05, "zipfian"), Workload("balanced-uniform", 0.5)]
STANDARD = [
    Workload("write-heavy-uniform", 0.95, n_keys=1_000_000), Workload("read-heavy-zipfian", 0.05, "zipfian", n_keys=1_000_000), Workload("balanced-uniform", 0.5, n_keys=1_000_000), Workload("write-only-sequential", 1.0, "sequential", n_keys=1_000_000, value_size=1000)
]
MIXES = {"write-heavy": 0.95, "read-heavy": 0.05, "balanced": 0.5, "read-only": 0.0, "write-only": 1.0}


def find(name: str, suite: list[Workload] | None = None) -> Workload:
    for w in suite or QUICK + STANDARD:
        if w.name == name or w.name.startswith(name + "-"):
            return w
    raise ValueError(f"no workload {name!r}")


def uniform(number: Column, salt: int = 0) -> Column:
    """In [0, 1), from the number alone."""
    x = (number * 1103515245 + 12345 + salt * 7919) % _MODULUS
    x = (x * 69069 + 1) % _MODULUS
    return x / float(_MODULUS)


def key_number(number: Column, distribution: str, n: int, salt: int = 0) -> Column:
    """Which of n keys an operation takes.

    sequential goes round from 1; uniform is even; zipfian (s = 1.1) inverts the continuous
    distribution function, with 0 the most frequent; latest is a half-normal distance back from the last key.
    """
    u = uniform(number, salt)
    if distribution == "sequential":
        return (number + 1) % n
    if distribution == "uniform":
        return F.floor(u * n)
    if distribution == "zipfian":
        e = 1 - 1.1
        return F.least(F.floor(F.pow(u * (math.pow(n + 1, e) - 1) + 1, F.lit(1 / e))) - 1, F.lit(n - 1)).cast("long")
    if distribution == "latest":
        sigma = max(n // 10, 100)
        back = F.sqrt(-2 * F.ln(1 - u)) * F.abs(F.cos(2 * math.pi * uniform(number, salt + 1))) * sigma
        return F.greatest(F.lit(n - 1) - F.floor(back), F.lit(0)).cast("long")
    raise ValueError(f"no distribution {distribution!r}")


def trace(spark: SparkSession, workload: Workload, n_ops: int, *, partitions: int | None = None) -> DataFrame:
    """(op_id, workload, op, key): operations by number."""
    ids = spark.range(n_ops, numPartitions=partitions).withColumnRenamed("id", "op_id")
    write = uniform(F.col("op_id"), 17) < workload.write_share
    key = user_key(key_number(F.col("op_id"), workload.distribution, workload.n_keys))
    return ids.select("op_id", F.lit(workload.name).alias("workload"), F.when(write, "put").otherwise("get").alias("op"), key.alias("key"))


def latency_stats(samples: DataFrame, latency: str, *by: str) -> DataFrame:
    """n, min, max, mean and the samples at floor(n * p) of the sorted ones, counted from 0.

    Samples are counted by value first, so a group is as large as its distinct latencies, and the
    positions are found by running counts of those.
    """
    from pyspark.sql.window import Window

    counted = samples.groupBy(*by, F.col(latency).alias("x")).agg(F.count("*").alias("k"))
    before = Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    placed = counted.withColumn("upto", F.sum("k").over(before)).withColumn("n", F.sum("k").over(whole))
    at = {name: F.least(F.expr(f"n * {p} div 1000"), F.col("n") - 1) for name, p in (("p50", 500), ("p95", 950), ("p99", 990), ("p999", 999))}
    picks = [F.min(F.when(F.col("upto") > pos, F.col("x"))).alias(name) for name, pos in at.items()]
    return placed.groupBy(*by).agg(F.first("n").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("k")) / F.first("n")).alias("mean"), *picks)


def throughput(samples: DataFrame, seconds: Column, *by: str) -> DataFrame:
    """Operations and operations per second, all and by kind; missing keys count as reads."""
    kinds = {"writes": F.col("op").isin("put", "delete"), "reads": F.col("op") == "get"}
    counted = samples.groupBy(*by).agg(F.count("*").alias("ops"), *[F.sum(c.cast("long")).alias(k) for k, c in kinds.items()], seconds.alias("seconds"))
    return counted.withColumns({f"{k}_per_s": F.col(k) / F.col("seconds") for k in ("ops", "writes", "reads")})


def compare(results: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """One row for each workload, one column for each engine, null where an engine has no result."""
    return results.groupBy(row).pivot(column, columns).agg(F.first(value, ignorenulls=True))
