"""Running sums and row numbers over a whole table, without putting it in one partition.

The order column is cut at quantiles into blocks. Block totals go to the driver
(one number for each block) and come back as offsets; a window runs inside
each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _blocks(df: DataFrame, order: str, blocks: int | None) -> Column:
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return F.lit(0)
    cuts = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], 1 / (4 * n))))
    return sum(((F.col(order) > c).cast("int") for c in cuts), F.lit(0)) if cuts else F.lit(0)


def running_sum(df: DataFrame, order: str, value: Column, name: str, *, ties: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one. ``order`` is numeric, and unique unless ``ties`` break it."""
    placed = df.withColumn("__block", _blocks(df, order, blocks)).withColumn("__value", value)
    totals = {r[0]: r[1] for r in placed.groupBy("__block").agg(F.sum("__value")).collect()}  # a row for each block
    before, offsets = 0, []
    for b in sorted(totals):
        offsets.append((b, before))
        before += totals[b] or 0
    table = df.sparkSession.createDataFrame(offsets, "__block int, __before long")
    inside = Window.partitionBy("__block").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("__inside", F.sum("__value").over(inside)).join(F.broadcast(table), "__block")
    return summed.withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__block", "__value", "__inside", "__before")


def row_numbers(df: DataFrame, order: str, name: str, *, base: int = 0, ties: list[str] | None = None) -> DataFrame:
    """Adds base + 1, base + 2, ... in the order of a column."""
    numbered = running_sum(df, order, F.lit(1).cast("long"), name, ties=ties)
    return numbered.withColumn(name, F.col(name) + base)


def following(df: DataFrame, order: str, value: str, name: str, *, blocks: int | None = None) -> DataFrame:
    """Adds ``value`` of the next row in the order of a numeric, unique column; null for the last."""
    placed = df.withColumn("__block", _blocks(df, order, blocks))
    firsts = sorted(placed.groupBy("__block").agg(F.min_by(value, order)).collect())  # a row for each block
    after = [(b, n) for (b, _), (_, n) in zip(firsts, firsts[1:], strict=False)]
    table = df.sparkSession.createDataFrame(after, f"__block int, __after {df.schema[value].dataType.simpleString()}")
    inside = Window.partitionBy("__block").orderBy(order)
    led = placed.withColumn("__lead", F.lead(F.struct(F.col(value).alias("v"))).over(inside)).join(F.broadcast(table), "__block", "left")
    return led.withColumn(name, F.when(F.col("__lead").isNotNull(), F.col("__lead.v")).otherwise(F.col("__after"))).drop("__block", "__lead", "__after")
