"""Schemas of the key-value log and the checks that rows must pass.

An op log holds one row per put or delete. ``seq`` is a total order; ``deleted``
marks a tombstone. Everything else is derived from these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OP_LOG = "key string, seq bigint, value string, deleted boolean"
RUN = OP_LOG + ", level int, file_num bigint"
MANIFEST = "level int, file_num bigint, path string, min_key string, max_key string, n_entries bigint, n_tombstones bigint, bytes bigint, min_seq bigint, max_seq bigint"
PAGE_LOG = "log_id bigint, type string, page_id int, offset int, length int, data binary, crc bigint"
OP_TRACE = "op_id bigint, engine string, workload string, op string, key string, latency_us double, ok boolean"


class KeyEmpty(ValueError):
    """A put or delete of an empty or null key."""


class KeyNotFound(KeyError):
    """A lookup or strict delete of a key that isn't live."""


class Closed(RuntimeError):
    """A call on a closed table."""


class Corrupt(ValueError):
    """A record whose checksum or length doesn't hold, in the mode that fails on it."""


class LateOperation(ValueError):
    """An operation that is older than a tombstone which a compaction has dropped."""


class DiskFull(RuntimeError):
    """A write beyond the disk budget."""


def op_log(df: DataFrame, *, key: Column, seq: Column, value: Column, deleted: Column | None = None, empty_is_delete: bool = False) -> DataFrame:
    """Rows of any table as an op log. ``empty_is_delete`` makes a null or empty value a tombstone."""
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    if empty_is_delete:
        gone = gone | value.isNull() | (value == "")
    return df.select(key.alias("key"), seq.cast("long").alias("seq"), F.when(~gone, value).alias("value"), gone.alias("deleted"))


def valid_key(key: Column) -> Column:
    return F.coalesce(F.octet_length(key) > 0, F.lit(False))


def require_keys(ops: DataFrame) -> DataFrame:
    """Fails when a row with an empty key is read; checked inside the plan, without an action of its own."""
    bad = F.raise_error(F.lit("empty key in an operation"))
    return ops.withColumn("key", F.when(valid_key(F.col("key")), F.col("key")).otherwise(bad))
