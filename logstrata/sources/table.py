"""A stored key-value table: sorted Parquet runs in levels under a manifest.

Three layouts share one meaning. ``append`` keeps runs by age and merges the
oldest half; ``levelled`` merges level by level; ``clustered`` keeps a single
sorted run. Every row keeps its ``seq``, which alone says what is older: a
tombstone goes only when no run that is left out of a merge can hold an older
row of its key, and not before ``lateness`` operations have come after it. An
operation older than a dropped tombstone is refused, so any schedule of flushes
and compactions that is accepted gives the same snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.model import OP_LOG, Closed, DiskFull, LateOperation
from logstrata.operators import runs as R
from logstrata.operators import scan, stats
from logstrata.operators.oplog import squeezed
from logstrata.operators.resolve import as_of, compact, live
from logstrata.sources.manifest import Manifest

LAYOUTS = ("append", "levelled", "clustered")
# The filter of a file takes the size that its keys need: 128 KB for RUN_ENTRIES of them, down to 1 KB. Without
# these settings each takes 1 MB, however few keys a partition has.
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(128 << 10), "parquet.bloom.filter.candidates.number#key": "12"}


class KVTable:
    """Reads are DataFrames over the files of the version that was current when they were made."""

    def __init__(self, spark: SparkSession, root: str, *, layout: str = "levelled", l0_runs: int = R.L0_RUNS, max_segments: int = R.MAX_SEGMENTS, disk_budget: int | None = None, lateness: int = 0):
        if layout not in LAYOUTS:
            raise ValueError(f"no layout {layout!r}")
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout
        self.l0_runs, self.max_segments, self.disk_budget, self.lateness = l0_runs, max_segments, disk_budget, lateness
        self.manifest = Manifest(spark, self.root)
        self.manifest.recover()
        self.closed = False

    def __enter__(self) -> KVTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    def _files(self) -> list:
        if self.closed:
            raise Closed(self.root)
        return self.manifest.read().orderBy("file_num").collect()  # a row for each run

    def _read(self, files: list) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], OP_LOG)
        return self.spark.read.schema(OP_LOG).parquet(*[f"{self.root}/{f.path}" for f in files])

    def _write_run(self, rows: DataFrame, level: int, number: int) -> tuple | None:
        """One sorted run in files of a bounded number of entries; its manifest row, or None if it has no rows."""
        path = f"runs/L{level}-{number:06d}"
        ordered = rows.select("key", "seq", "value", "deleted").repartitionByRange("key").sortWithinPartitions("key")
        ordered.write.mode("overwrite").options(**BLOOM).option("maxRecordsPerFile", R.RUN_ENTRIES).parquet(f"{self.root}/{path}")
        figures = R.summarise(self.spark.read.schema(OP_LOG).parquet(f"{self.root}/{path}")).first()
        if not figures or not figures.n_entries:
            self.manifest.delete(f"{self.root}/{path}")
            return None
        return (level, number, path, figures.min_key, figures.max_key, figures.n_entries, figures.n_tombstones, figures.bytes, figures.min_seq, figures.max_seq)

    # writes
    def flush(self, ops: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """Stores a batch of operations as a run; the table's version after it. A ``batch`` (stream, number) that was
        stored before isn't stored again."""
        files = self._files()
        if batch and self.manifest.last_batch(batch[0]) >= batch[1]:
            return self.manifest.version()
        number = max((f.file_num for f in files), default=0) + 1
        row = self._write_run(squeezed(ops), 0, number)
        if row is None:
            return self.manifest.version()
        if self.disk_budget is not None and sum(f.bytes for f in files) + row[7] > self.disk_budget:
            self.manifest.delete(f"{self.root}/{row[2]}")
            raise DiskFull(f"{self.root}: more than {self.disk_budget} bytes")
        low_water = self.manifest.low_water()
        if low_water is not None and row[8] <= low_water:
            self.manifest.delete(f"{self.root}/{row[2]}")
            raise LateOperation(f"{self.root}: operation {row[8]} is older than a dropped tombstone")
        version = self.manifest.commit([tuple(f) for f in files] + [row], batch=batch)
        if self.layout == "clustered" and files:
            return self._merge(self._files(), 0)
        return version

    def _merge(self, inputs: list, level: int) -> int:
        """Replaces runs by their merge. Tombstones go if no run that is left has an older row in their key range."""
        files = self._files()
        number, gone = max(f.file_num for f in files) + 1, {f.file_num for f in inputs}
        left = [f for f in files if f.file_num not in gone]
        low, high, newest = min(f.min_key for f in inputs), max(f.max_key for f in inputs), max(f.max_seq for f in inputs)
        rows, low_water = self._read(inputs), None
        horizon = max(f.max_seq for f in files) - self.lateness
        drop = any(f.n_tombstones for f in inputs) and not any(f.max_key >= low and f.min_key <= high and f.min_seq < newest for f in left)
        if drop:
            low_water = rows.where(F.col("deleted") & (F.col("seq") <= horizon)).agg(F.max("seq")).first()[0]
        merged = compact([rows], bottom=False)
        if drop:
            merged = merged.where(~F.col("deleted") | (F.col("seq") > horizon))
        row = self._write_run(merged, level, number)
        return self.manifest.commit([tuple(f) for f in left] + ([row] if row else []), low_water=low_water)

    def compact(self, *, force: bool = False) -> bool:
        """One pass of the layout's policy, if it is due; was there one."""
        files = self._files()
        if len(files) < 2:
            return False
        table = self.spark.createDataFrame([tuple(f) for f in files], self.manifest.read().schema)
        if self.layout != "levelled":
            logical = self.statistics().first().logical_bytes or 0
            if not force and not R.hash_compaction_due(table, logical, max_segments=self.max_segments).first().due:
                return False
            self._merge(files if self.layout == "clustered" else R.oldest_half(table).collect(), 0)
            return True
        due = [r.level for r in R.to_compact(table, l0_runs=self.l0_runs).orderBy("level").collect() if r.due or force]
        if not due:
            return False
        self._merge(R.pick_files(table, due[0]).collect(), due[0] + 1)
        return True

    def vacuum(self) -> list[str]:
        """Deletes run folders that the current version doesn't name; readers of older versions lose them."""
        named = {f.path.split("/")[-1] for f in self._files()}
        gone = [n for n in self.manifest.list_runs() if n not in named]
        for name in gone:
            self.manifest.delete(f"{self.root}/runs/{name}")
        return gone

    # reads
    def ops(self) -> DataFrame:
        """The rows of all runs."""
        return self._read(self._files())

    def snapshot(self, seq: int | None = None) -> DataFrame:
        """Live rows; with ``seq`` those after that operation, as far as compactions kept its versions."""
        return live(self.ops()) if seq is None else as_of(self.ops(), seq)

    def get(self, key: str) -> DataFrame:
        """The live row of a key, from the runs whose key range holds it; inside them the filter on the key reaches the
        Bloom filters of the files, so that row groups without the key aren't read."""
        return scan.get(self._read([f for f in self._files() if f.min_key <= key <= f.max_key]), key)

    def range_scan(self, start: str | None = None, end: str | None = None, **options) -> DataFrame:
        files = [f for f in self._files() if (start is None or f.max_key >= start) and (end is None or f.min_key <= end)]
        return scan.range_scan(self._read(files), start, end, **options)

    def prefix_scan(self, prefix: str) -> DataFrame:
        files = [f for f in self._files() if f.max_key >= prefix and (f.min_key <= prefix or f.min_key.startswith(prefix))]
        return scan.prefix_scan(self._read(files), prefix)

    def last_seq(self) -> int:
        return max((f.max_seq for f in self._files()), default=0)

    def statistics(self) -> DataFrame:
        return stats.amplification(self.ops())

    def level_shape(self) -> DataFrame:
        return R.level_shape(self.manifest.read())

    def files_read(self, key: str) -> int:
        """How many runs a lookup of a key opens."""
        return len([f for f in self._files() if f.min_key <= key <= f.max_key])


def count_files(table: KVTable) -> int:
    return table.manifest.read().agg(F.count("*")).first()[0]
