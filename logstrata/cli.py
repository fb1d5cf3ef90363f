"""Command line: compare layouts under a workload, or walk through a table.

    python -m logstrata.cli bench [--quick] [--workload NAME] [--layout NAME] [--ops N] [--root DIR]
    python -m logstrata.cli demo [--root DIR]
"""

from __future__ import annotations

import argparse
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.scalars import shorten, user_key
from logstrata.operators import oplog, workload
from logstrata.sources.table import LAYOUTS, KVTable


def _timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def run_workload(spark: SparkSession, w: workload.Workload, layout: str, root: str, n_ops: int, batches: int = 4) -> DataFrame:
    """One result row: bulk puts by batches, then bulk reads, with amplification from the stored bytes."""
    made = workload.trace(spark, w, n_ops)
    writes, reads = 0.0, 0.0
    with KVTable(spark, f"{root}/{w.name}-{layout}", layout=layout) as table:
        for b in range(batches):
            part = made.where((F.col("op") == "put") & (F.col("op_id") % batches == b))
            ops = oplog.sequenced(oplog.puts(part.withColumn("value", F.rpad(F.lit("v"), w.value_size, "v")), F.col("key"), F.col("value")).withColumn("__at", F.monotonically_increasing_id()), "__at", base=table.last_seq())
            writes += _timed(lambda ops=ops, table=table: table.flush(ops))
            while table.compact():
                pass
        keys = made.where("op = 'get'").select("key")
        reads = _timed(lambda: table.ops().join(keys.distinct(), "key", "left_semi").write.format("noop").mode("overwrite").save())
        figures = table.statistics().first()
    n = {r.op: r["count"] for r in made.groupBy("op").count().collect()}
    row = (w.name, layout, n.get("put", 0) / writes if writes else None, n.get("get", 0) / reads if n.get("get") else None, figures.space_amp)
    return spark.createDataFrame([row], "workload string, layout string, writes_per_s double, reads_per_s double, space_amp double")


def bench(spark: SparkSession, args: argparse.Namespace) -> None:
    suite = workload.QUICK if args.quick else workload.STANDARD
    if args.workload:
        suite = [workload.find(args.workload, suite)]
    layouts = [args.layout] if args.layout else list(LAYOUTS)
    results = None
    for w in suite:
        for layout in layouts:
            row = run_workload(spark, w, layout, args.root, args.ops)
            results = row if results is None else results.unionByName(row)
    results = results.cache()
    for column in ("writes_per_s", "reads_per_s", "space_amp"):
        print(column)
        workload.compare(results, "workload", "layout", layouts, F.round(column, 2)).orderBy("workload").show(truncate=False)


def range_bench(spark: SparkSession, root: str, n: int = 10_000) -> DataFrame:
    """Keys found in ranges of 100, 1,000, 5,000 and all of a table of users, and the seconds it took."""
    rows = spark.range(n).select(user_key(F.col("id"), 6).alias("key"), (F.col("id") + 1).alias("seq"), F.format_string('{"id": %d, "name": "user%d"}', "id", "id").alias("value"), F.lit(False).alias("deleted"))
    found = []
    with KVTable(spark, f"{root}/ranges") as table:
        table.flush(rows)
        for size in (100, 1000, 5000, n):
            held = {}
            took = _timed(lambda size=size, held=held, table=table: held.update(n=table.range_scan("user:000000", f"user:{size:06d}").count()))
            found.append((size, held["n"], took))
    return spark.createDataFrame(found, "size long, found long, seconds double")


def demo(spark: SparkSession, root: str) -> None:
    rows = [("bird:heron", 1, '{"legs":"long"}'), ("bird:robin", 2, '{"legs":"thin"}'), ("bird:stork", 3, '{"legs":"red"}'), ("tree:alder", 4, '{"leaf":"round"}'), ("tree:birch", 5, '{"leaf":"small"}'), ("bird:heron", 6, '{"legs":"long","neck":"long"}'), ("tree:birch", 7, None)]
    log = spark.createDataFrame([(k, s, v, v is None) for k, s, v in rows], "key string, seq long, value string, deleted boolean")
    with KVTable(spark, f"{root}/demo") as table:
        table.flush(log.where("seq <= 4"))
        table.flush(log.where("seq > 4"))
        for title, found in (("birds", table.prefix_scan("bird:")), ("trees", table.prefix_scan("tree:")), ("[bird:heron, bird:stork)", table.range_scan("bird:heron", "bird:stork")), ("all", table.range_scan())):
            print(title, found.count())
            found.select("key", shorten(F.col("value"), 24).alias("value")).show(3, truncate=False)
        table.statistics().show()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="logstrata")
    sub = parser.add_subparsers(dest="what", required=True)
    b = sub.add_parser("bench")
    b.add_argument("--quick", action="store_true")
    b.add_argument("--workload")
    b.add_argument("--layout", choices=LAYOUTS)
    b.add_argument("--ops", type=int, default=100_000)
    d = sub.add_parser("demo")
    r = sub.add_parser("ranges")
    for p in (b, d, r):
        p.add_argument("--root", default=None)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.root is None and not spark.sparkContext.master.startswith("local"):
        parser.error("--root has to name a folder that driver and executors share")
    args.root = args.root or tempfile.mkdtemp(prefix="logstrata-")
    if args.what == "bench":
        bench(spark, args)
    elif args.what == "ranges":
        range_bench(spark, args.root).show()
    else:
        demo(spark, args.root)


if __name__ == "__main__":
    main()
