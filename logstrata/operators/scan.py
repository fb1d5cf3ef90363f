"""Point lookups, range and prefix scans over an op log.

Filters on the key come first, so they reach the scan of a stored log; the
resolution then sees the versions of those keys only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstrata.operators.resolve import live

#: Ranges that are counted in one pass.
FEW_RANGES = 64


def get(ops: DataFrame, key: str) -> DataFrame:
    """The live row of a key, or no row."""
    return live(ops.where(F.col("key") == key))


def multi_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """The live rows of a table of keys. A semi-join, broadcast by the optimiser if the keys are few."""
    return live(ops.join(keys.select("key").distinct(), "key", "left_semi"))


def missing(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Those keys that aren't live."""
    wanted = keys.select("key").distinct()
    return wanted.join(live(ops.join(wanted, "key", "left_semi")), "key", "left_anti")


def range_scan(ops: DataFrame, start: str | None = None, end: str | None = None, *, end_inclusive: bool = False, ordered: bool = True) -> DataFrame:
    """Live rows with start <= key < end (or <=); None is no bound."""
    if start is not None:
        ops = ops.where(F.col("key") >= start)
    if end is not None:
        ops = ops.where(F.col("key") <= end if end_inclusive else F.col("key") < end)
    found = live(ops)
    return found.orderBy("key") if ordered else found


def prefix_scan(ops: DataFrame, prefix: str, *, ordered: bool = True) -> DataFrame:
    """Live rows whose key starts with ``prefix``, whatever bytes follow."""
    found = live(ops.where(F.col("key").startswith(prefix)))
    return found.orderBy("key") if ordered else found


def tilde_scan(ops: DataFrame, prefix: str) -> DataFrame:
    """The idiom of a scan up to ``prefix~``: without keys that go on with a byte of 0x7E or above."""
    return range_scan(ops, prefix, prefix + "~")


def first_keys(ops: DataFrame, n: int) -> DataFrame:
    return live(ops).orderBy("key").limit(n)


def key_bounds(ops: DataFrame) -> DataFrame:
    """The least and the greatest live key."""
    return live(ops).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def range_counts(ops: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n): live keys in each half-open range of (range_id, start, end); null is no bound.

    Up to ``FEW_RANGES`` ranges are counted in one pass without a join: a range has the keys below its end
    without those below its start. More of them are joined, and the pairs counted before anything is shuffled.
    """
    keys = live(ops).select("key")
    few = ranges.select("start", "end").limit(FEW_RANGES + 1).collect()
    if len(few) <= FEW_RANGES:
        bounds = sorted({b for r in few for b in r if b is not None})
        below = keys.agg(F.count("*").alias("all"), F.array(F.lit(0).cast("long"), *[F.count_if(F.col("key") < b) for b in bounds]).alias("below"))
        at = F.create_map(*[x for i, b in enumerate(bounds) for x in (F.lit(b), F.lit(i + 1))]) if bounds else F.lit(None).cast("map<string,int>")
        upper = F.when(F.col("end").isNull(), F.col("all")).otherwise(F.get("below", at[F.col("end")]))
        lower = F.when(F.col("start").isNull(), F.lit(0)).otherwise(F.get("below", at[F.col("start")]))
        return ranges.join(F.broadcast(below), F.lit(True)).select("range_id", F.greatest(upper - lower, F.lit(0)).alias("n"))  # of one row
    inside = (F.col("start").isNull() | (F.col("key") >= F.col("start"))) & (F.col("end").isNull() | (F.col("key") < F.col("end")))
    counted = keys.join(ranges, inside).groupBy("range_id").agg(F.count("*").alias("n"))
    return ranges.select("range_id").join(counted, "range_id", "left").select("range_id", F.coalesce("n", F.lit(0)).alias("n"))


def blind_deletes(ops: DataFrame) -> DataFrame:
    """Keys whose first operation is a delete: those a strict table would have refused."""
    first = ops.groupBy("key").agg(F.min_by("deleted", "seq").alias("deleted"))
    return first.where("deleted").select("key")

