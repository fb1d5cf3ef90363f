"""Replay of logs: last images before a checkpoint, damaged tails, index rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.functions.model import Corrupt
from logstrata.operators.resolve import latest, live

WRITE, CHECKPOINT, COMMIT = "write", "checkpoint", "commit"


def up_to_checkpoint(log: DataFrame) -> DataFrame:
    """Records up to and with the first checkpoint; all of a log without one."""
    first = log.where(F.col("type") == CHECKPOINT).agg(F.min("log_id").alias("__cut"))
    return log.join(F.broadcast(first), (F.col("log_id") <= F.col("__cut")) | F.col("__cut").isNull()).drop("__cut")  # of one row


def replay_pages(log: DataFrame) -> DataFrame:
    """The last image of each page."""
    images = log.where(F.col("type") == WRITE)
    return latest(images, "page_id", "log_id").select("page_id", "log_id", "data")


def checked(log: DataFrame, *, order: str, payload: str, crc: str, mode: str = "truncate") -> DataFrame:
    """Records whose checksum holds. ``truncate`` ends the log before the first bad one, ``skip`` leaves bad
    ones out, ``fail`` raises when a bad one is read."""
    good = F.coalesce(F.crc32(F.col(payload).cast("binary")) == F.col(crc), F.lit(False))
    if mode == "skip":
        return log.where(good)
    if mode == "fail":
        return log.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("checksum mismatch")).cast("boolean")))  # a filter, which no choice of columns prunes
    if mode != "truncate":
        raise ValueError(f"no mode {mode!r}")
    first = log.where(~good).agg(F.min(order).alias("__bad"))
    return log.join(F.broadcast(first), F.col("__bad").isNull() | (F.col(order) < F.col("__bad"))).drop("__bad")  # of one row


def replay(ops: DataFrame) -> tuple[DataFrame, int]:
    """The snapshot after a log, and its last seq (0 for an empty log)."""
    return live(ops), ops.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def rebuild_index(records: DataFrame) -> DataFrame:
    """(key, file_num, offset, size, deleted): the last record of each key in the order of files and offsets."""
    return latest(records.select("key", "file_num", "offset", "size", "deleted"), "key", ["file_num", "offset"])


def require_sound(log: DataFrame, *, payload: str, crc: str) -> DataFrame:
    """The log, or Corrupt if any checksum fails; an action."""
    bad = log.where(~F.coalesce(F.crc32(F.col(payload).cast("binary")) == F.col(crc), F.lit(False))).limit(1).count()
    if bad:
        raise Corrupt("checksum mismatch")
    return log
