"""Batches of operations: puts, deletes, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstrata.functions.model import require_keys
from logstrata.operators.ordered import row_numbers
from logstrata.operators.resolve import latest, live


def puts(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    return rows.select(key.alias("key"), value.alias("value"), F.lit(False).alias("deleted"))


def deletes(rows: DataFrame, key: Column) -> DataFrame:
    """Blind tombstones: the key need not be there."""
    return rows.select(key.alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))


def absent_deletes(batch: DataFrame, ops: DataFrame) -> DataFrame:
    """Keys that a batch deletes though they aren't live: those a strict delete refuses."""
    wanted = batch.where("deleted").select("key").distinct()
    return wanted.join(live(ops.join(wanted, "key", "left_semi")), "key", "left_anti")


def sequenced(batch: DataFrame, order: str, *, base: int = 0, ties: list[str] | None = None) -> DataFrame:
    """The batch as an op log, numbered from base + 1 in the order of a numeric column."""
    return row_numbers(require_keys(batch), order, "seq", base=base, ties=ties).select("key", "seq", "value", "deleted")


def squeezed(batch: DataFrame) -> DataFrame:
    """The last operation of each key of a batch: what a memtable holds when it is flushed."""
    return latest(batch)
