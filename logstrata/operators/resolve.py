"""Last-writer-wins resolution of an op log.

A key's row of greatest ``seq`` decides, tombstones included; tombstones are
dropped only afterwards. The aggregation combines on the map side, and a filter
on ``key`` or ``seq`` set before it reaches the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(ops: DataFrame, key: str | list[str] = "key", order: str | list[str] = "seq") -> DataFrame:
    """The last row of each key, tombstones included, with the columns of ``ops``. ``order`` is a total order."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    rest = [c for c in ops.columns if c not in keys]
    picked = ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*orders)).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in ops.columns])


def live(ops: DataFrame) -> DataFrame:
    """The snapshot: last rows without the tombstones."""
    return latest(ops).where(~F.col("deleted"))


def as_of(ops: DataFrame, seq: int) -> DataFrame:
    """The snapshot after the operation ``seq``."""
    return live(ops.where(F.col("seq") <= seq))


def tombstones(ops: DataFrame) -> DataFrame:
    return latest(ops).where("deleted")


def history(ops: DataFrame, key: str) -> DataFrame:
    """All versions of one key, oldest first."""
    return ops.where(F.col("key") == key).orderBy("seq")


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs)


def merge_by_seq(runs: list[DataFrame]) -> DataFrame:
    """One run from many: the row of greatest seq for each key, tombstones kept."""
    return latest(union_runs(runs))


def merge_by_priority(runs: list[DataFrame]) -> DataFrame:
    """One run from many without regard to seq: for each key the row of the first run that has it."""
    ranked = [r.withColumn("priority", F.lit(i)) for i, r in enumerate(runs)]
    whole = union_runs(ranked)
    rest = [c for c in runs[0].columns if c != "key"]
    return whole.groupBy("key").agg(F.min_by(F.struct(*rest), "priority").alias("row")).select("key", *[F.col(f"row.{c}").alias(c) for c in rest])


def compact(runs: list[DataFrame], *, bottom: bool) -> DataFrame:
    """Merged runs; at the bottom level, under which no older version can be, without tombstones."""
    merged = merge_by_seq(runs)
    return merged.where(~F.col("deleted")) if bottom else merged


def diff(ops: DataFrame, before: int, after: int) -> DataFrame:
    """Keys whose value differs between two snapshots: change is added, removed or changed.

    One pass: both snapshots come from a single aggregation of the log.
    """
    upto = ops.where(F.col("seq") <= after)
    old = F.max_by(F.struct("seq", "value", "deleted"), F.when(F.col("seq") <= before, F.col("seq")))
    both = upto.groupBy("key").agg(old.alias("o"), F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("n"))
    was, now = (F.coalesce(~F.col(f"{c}.deleted"), F.lit(False)) for c in "on")
    change = F.when(was & ~now, "removed").when(~was & now, "added").when(was & now & ~F.col("o.value").eqNullSafe(F.col("n.value")), "changed")
    return both.select("key", change.alias("change"), F.when(was, F.col("o.value")).alias("old_value"), F.when(now, F.col("n.value")).alias("new_value")).where("change is not null")


def apply_batch(index: DataFrame, updates: DataFrame, deletions: DataFrame) -> DataFrame:
    """An index (key, ...) with rows replaced or added from ``updates`` and the keys of ``deletions`` gone."""
    changed = updates.select("key").unionByName(deletions.select("key"))
    return index.join(changed, "key", "left_anti").unionByName(updates.join(deletions.select("key"), "key", "left_anti"))


def apply_compaction(index: DataFrame, compacted: DataFrame, replaced: Column) -> DataFrame:
    """The fate of each index row after a compaction: kept, updated (to the new place) or deleted.

    ``replaced`` says which rows point into a compacted segment; ``compacted`` is (key, new_segment).
    """
    joined = index.join(compacted, "key", "left")
    action = F.when(~replaced, "kept").when(F.col("new_segment").isNotNull(), "updated").otherwise("deleted")
    return joined.select("key", "segment", action.alias("action"), F.when(replaced, F.col("new_segment")).otherwise(F.col("segment")).alias("now"))
