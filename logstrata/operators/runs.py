"""Sorted runs and their manifest: assignment by size, overlap, sparse index, compaction planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.functions import scalars as S
from logstrata.operators.ordered import running_sum

# Defaults of the layouts.
MEMTABLE_BYTES = SEGMENT_BYTES = 4 << 20
BLOCK_BYTES, RUN_ENTRIES, L0_RUNS, LEVELS, LEVEL1_BYTES, LEVEL_FACTOR = 4096, 100_000, 4, 5, 40 << 20, 10
MAX_SEGMENTS, SPACE_AMP_LIMIT = 10, 3.0
MERGE_BELOW_CELLS, LEAF_CELLS = 6, 25


def assign_by_bytes(ops: DataFrame, limit: int, *, size: Column | None = None, order: str = "seq", name: str = "run") -> DataFrame:
    """Adds the run that a log row falls in when runs are cut at each ``limit`` bytes of the running total."""
    summed = running_sum(ops, order, S.memtable_size(F.col("key"), F.col("value")) if size is None else size, "__end")
    return summed.withColumn(name, F.expr(f"(__end - 1) div {limit}")).drop("__end")


def assign_by_entries(run: DataFrame, limit: int = RUN_ENTRIES, *, order: str = "key", name: str = "file") -> DataFrame:
    """Adds the output file of each row of one merged run: ``limit`` rows in key order, inside each first character of the key."""
    head = F.substring(F.col(order), 1, 1)
    nth = F.row_number().over(Window.partitionBy(head).orderBy(order)) - 1
    return run.withColumn(name, F.concat(F.hex(head), F.lit("-"), F.floor(nth / limit).cast("string")))


def summarise(run: DataFrame, *by: str) -> DataFrame:
    """Manifest figures of rows that are grouped by ``by``."""
    return run.groupBy(*by).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_entries"), F.sum(F.col("deleted").cast("long")).alias("n_tombstones"), F.sum(S.sst_entry_size(F.col("key"), F.col("value"))).alias("bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def overlapping(manifest: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Runs that may hold a key of [start, end], both inclusive; None is no bound."""
    found = manifest
    if start is not None:
        found = found.where(F.col("max_key") >= start)
    if end is not None:
        found = found.where(F.col("min_key") <= end)
    return found


def covering(manifest: DataFrame, key: str) -> DataFrame:
    return manifest.where(F.lit(key).between(F.col("min_key"), F.col("max_key")))


def overlap_pairs(manifest: DataFrame, id: str = "file_num") -> DataFrame:
    """Pairs of runs whose key ranges overlap. A manifest is small: a row for each file."""
    a, b = manifest.alias("a"), manifest.alias("b")
    on = (F.col(f"a.{id}") < F.col(f"b.{id}")) & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key"))
    return a.join(b, on).select(F.col(f"a.{id}").alias("a"), F.col(f"b.{id}").alias("b"))


def sparse_index(run: DataFrame, every: int, *, order: str = "key", head: int = 8) -> DataFrame:
    """(block, first_key): the first key of each block of ``every`` rows of a sorted run.

    Rows are numbered inside the heads of their keys (``head`` characters), on the totals of the heads before.
    """
    keys = run.select(F.col(order).alias("first_key"), F.substring(F.col(order), 1, head).alias("__head"))
    earlier = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = keys.groupBy("__head").agg(F.count("*").alias("__n")).select("__head", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))  # a row for each head
    nth = F.row_number().over(Window.partitionBy("__head").orderBy("first_key")) - 1
    placed = keys.withColumn("__nth", nth).join(heads, "__head").withColumn("__at", F.col("__before") + F.col("__nth"))
    return placed.where(F.col("__at") % every == 0).select(F.expr(f"__at div {every}").alias("block"), "first_key")


def block_of(probes: DataFrame, index: DataFrame, key: str = "key", *, head: int = 8) -> DataFrame:
    """Probes with the last block whose first key isn't above them; null below the first block.

    An as-of join without a range join: entries and probes are sorted together inside the heads of
    their keys, and the last block of the heads before is carried over. Blocks grow with keys, so
    the last one is the greatest.
    """
    entries = index.select(F.col("first_key").alias("__k"), F.col("block").alias("__b"), F.lit(None).cast(probes.schema).alias("__row"))
    asked = probes.select(F.col(key).alias("__k"), F.lit(None).cast("long").alias("__b"), F.struct(*probes.columns).alias("__row"))
    both = entries.unionByName(asked).withColumn("__head", F.substring("__k", 1, head))
    inside = Window.partitionBy("__head").orderBy("__k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = both.groupBy("__head").agg(F.max("__b").alias("__last")).select("__head", F.max("__last").over(earlier).alias("__carried"))  # a row for each head
    found = both.withColumn("__in", F.max("__b").over(inside)).where("__row is not null").join(heads, "__head")
    return found.select("__row.*", F.coalesce("__in", "__carried").alias("block"))


def level_limit(level: Column) -> Column:
    return F.lit(LEVEL1_BYTES) * F.pow(F.lit(LEVEL_FACTOR), F.greatest(level - 1, F.lit(0)))


def level_shape(manifest: DataFrame) -> DataFrame:
    """Files, bytes and entries of each level, and of all (level null)."""
    return manifest.rollup("level").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.sum("n_entries").alias("n_entries"))


def to_compact(manifest: DataFrame, *, l0_runs: int = L0_RUNS) -> DataFrame:
    """Levels that are due: level 0 by its number of runs, others by their bytes; not the last."""
    by = manifest.where(F.col("level") < LEVELS - 1).groupBy("level").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
    due = F.when(F.col("level") == 0, F.col("n_files") >= l0_runs).otherwise(F.col("bytes") >= level_limit(F.col("level")))
    return by.withColumn("due", due)


def pick_files(manifest: DataFrame, level: int) -> DataFrame:
    """The inputs of one compaction: all of level 0, or the first file by key of a higher level, with what they overlap one level down."""
    own = manifest.where(F.col("level") == level)
    if level:
        own = own.orderBy("min_key", "file_num").limit(1)
    hull = own.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))
    below = manifest.where(F.col("level") == level + 1).join(hull, (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))).drop("lo", "hi")
    return own.unionByName(below)


def oldest_half(segments: DataFrame, order: str = "max_seq") -> DataFrame:
    """Closed segments to merge: the oldest half (rounded up, two at least) of more than three, else all of two or three.

    Age is that of the rows, not of the file: a merged segment is written last and has the oldest rows.
    """
    n = segments.count()
    take = 0 if n < 2 else max(2, -(-n // 2)) if n > 3 else n
    return segments.orderBy(order, "file_num").limit(take)


def hash_compaction_due(segments: DataFrame, logical_bytes: int, *, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """One row: is a merge due, by the number of segments or by disk over logical bytes."""
    seen = segments.agg(F.count("*").alias("n_segments"), F.sum("bytes").alias("disk_bytes"))
    amp = F.col("disk_bytes") / F.lit(max(logical_bytes, 1))
    return seen.withColumn("due", (F.col("n_segments") >= max_segments) | (F.col("n_segments") >= 2) & (amp > SPACE_AMP_LIMIT))


def split_leaves(pages: DataFrame, order: str = "key", by: str = "page_id") -> DataFrame:
    """Adds which half of its page a row goes to when each page is split at half its rows: 1 keeps the smaller half."""
    n, at = Window.partitionBy(by), Window.partitionBy(by).orderBy(order)
    return pages.withColumn("half", F.when(F.row_number().over(at) <= F.floor(F.count("*").over(n) / 2), 1).otherwise(2))


def merge_plan(pages: DataFrame) -> DataFrame:
    """(page_id, n_cells, next_cells) to what becomes of a page: kept, redistributed with the next one, or merged into it."""
    total = F.col("n_cells") + F.col("next_cells")
    spare = (F.col("next_cells") > MERGE_BELOW_CELLS) & (total >= 2 * MERGE_BELOW_CELLS)
    action = F.when(F.col("n_cells") >= MERGE_BELOW_CELLS, "kept").when(F.col("next_cells").isNull(), "kept").when(spare, "redistributed").otherwise("merged")
    return pages.withColumn("action", action)
