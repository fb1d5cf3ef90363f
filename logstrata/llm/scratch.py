"""Intermediate tables in the folder that driver and executors share.

A stage whose result is read more than once is written there as Parquet: that
cuts its lineage, survives lost executors and is computed once. The folder is
the session's ``spark.checkpoint.dir``; only where that is unset and the session
is in local mode (tests) a temporary folder is set as the checkpoint folder.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if found is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="logstrata-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Written tables of one operator call. ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/logstrata-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # results read from it as long as the session lives

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        # The schema is given: an empty table may have no file to read it from.
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()  # lets the context cleaner drop shuffle files of finished stages


def join_back(rows: DataFrame, summary: DataFrame, key: str, *, beside: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """Joins an aggregate of rows to them by its long ``key`` (and the columns ``beside``).

    The aggregate is already partitioned by its key, and Spark would join it where it is; then a hot
    key is one task, as only joins whose two sides were both shuffled for them are split when they
    are skewed. Joining by another form of the key has both shuffled.
    """
    other = F.col(key).bitwiseXOR(F.lit(1))
    return rows.withColumn("__join_key", other).join(summary.withColumn("__join_key", other).drop(key), ["__join_key", *beside], how).drop("__join_key")


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system: the worker lives on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
