"""Storage statistics of an op log and of its layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions import scalars as S
from logstrata.operators.ordered import running_sum
from logstrata.operators.resolve import latest


def ratio(part: Column, whole: Column) -> Column:
    """1.0 where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 1.0).otherwise(part / whole)


def amplification(ops: DataFrame) -> DataFrame:
    """One row: operations, live keys, logical bytes of the live rows, bytes of the whole log, and their ratios."""
    key, value = F.col("key"), F.col("value")
    last = F.max_by(F.struct("value", "deleted"), "seq")
    per_key = ops.groupBy("key").agg(
        last.alias("row"), F.count("*").alias("n"), F.sum(F.col("deleted").cast("long")).alias("deletes"), F.sum(S.hash_record_size(key, value)).alias("disk"), F.sum(F.when(~F.col("deleted"), S.key_bytes(key) + S.key_bytes(value))).alias("user")
    )
    is_live = ~F.col("row.deleted")
    total = per_key.agg(
        F.sum("n").alias("n_ops"), F.sum("deletes").alias("n_deletes"), F.count("*").alias("n_keys_seen"), F.sum(is_live.cast("long")).alias("n_keys"),
        F.sum(F.when(is_live, S.key_bytes(key) + S.key_bytes(F.col("row.value"))).otherwise(0)).alias("logical_bytes"), F.sum("disk").alias("disk_bytes"), F.sum("user").alias("user_bytes"),
    )
    return total.withColumns({"space_amp": ratio(F.col("disk_bytes"), F.col("logical_bytes")), "write_amp": ratio(F.col("disk_bytes"), F.col("user_bytes"))})


def levelled_heuristics(counters: DataFrame) -> DataFrame:
    """(flushes, compactions, l0_files) to the amplification that a levelled store reports without measuring."""
    write = F.when(F.col("flushes") == 0, 1.0).otherwise(F.least(F.lit(5.0), 1.5 + 0.5 * F.col("compactions") / F.col("flushes")))
    space = F.when(F.col("flushes") == 0, 1.0).when(F.col("l0_files") > 2, F.least(F.lit(3.0), 1.5 + 0.1 * F.col("l0_files"))).otherwise(1.2)
    return counters.withColumns({"write_amp": write, "space_amp": space})


def paged(ops: DataFrame, fill: float = 0.7) -> DataFrame:
    """One row: leaf pages that the live rows fill, their bytes, and disk over user bytes."""
    cells = latest(ops).where(~F.col("deleted")).agg(F.count("*").alias("n_keys"), F.sum(S.leaf_cell_size(F.col("key"), F.col("value")) + S.SLOT).alias("cell_bytes"), F.sum(S.key_bytes(F.col("key")) + S.key_bytes(F.col("value"))).alias("user_bytes"))
    room = (S.PAGE_SIZE - S.PAGE_HEADER) * fill
    pages = F.ceil(F.coalesce("cell_bytes", F.lit(0)) / room)
    return cells.withColumn("n_pages", pages).withColumn("disk_bytes", F.col("n_pages") * S.PAGE_SIZE).withColumn("space_amp", ratio(F.col("disk_bytes"), F.col("user_bytes")))


def shard_distribution(keys: DataFrame, shards: int = S.SHARDS) -> DataFrame:
    return keys.groupBy(S.shard(F.col("key"), shards).alias("shard")).agg(F.count("*").alias("n_keys"))


def key_count(ops: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Live keys; or about how many keys were ever written, in one pass without a shuffle of keys."""
    if approximate:
        return ops.agg(F.approx_count_distinct("key").alias("n_keys"))
    return latest(ops).agg(F.coalesce(F.sum((~F.col("deleted")).cast("long")), F.lit(0)).alias("n_keys"))


def within_budget(allocations: DataFrame, budget: int, *, order: str, size: str) -> DataFrame:
    """Adds what is in use after each allocation and whether it stays in the budget, with frees as negative sizes."""
    return running_sum(allocations, order, F.col(size).cast("long"), "in_use").withColumn("fits", F.col("in_use") <= budget)
