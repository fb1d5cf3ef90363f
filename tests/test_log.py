"""The scenarios of a key-value log, held against the plain model."""

import random

import pytest
from pyspark.sql import functions as F

from logstrata.functions import model
from logstrata.operators import oplog, resolve, scan
from logstrata.operators import runs as R
from logstrata.operators.recover import checked, rebuild_index, replay, replay_pages, up_to_checkpoint
from tests.kvmodel import as_dict, frame, log, snapshot


def test_crud_as_of(spark):
    ops = log(("key1", "value1"), ("key1", "value2"), ("key1",))
    df = frame(spark, ops)
    assert as_dict(resolve.as_of(df, 1)) == {"key1": "value1"}
    assert as_dict(resolve.as_of(df, 2)) == {"key1": "value2"}
    assert as_dict(resolve.live(df)) == {}


def test_empty_keys_and_values(spark):
    rows = spark.createDataFrame([("", 1, "v"), ("key1", 2, "value1"), ("key2", 3, "")], "k string, s long, v string")
    assert as_dict(resolve.live(model.op_log(rows, key=F.col("k"), seq=F.col("s"), value=F.col("v")).where("seq > 1"))) == {"key1": "value1", "key2": ""}
    assert as_dict(resolve.live(model.op_log(rows, key=F.col("k"), seq=F.col("s"), value=F.col("v"), empty_is_delete=True).where("seq > 1"))) == {"key1": "value1"}
    with pytest.raises(Exception, match="empty key"):
        model.require_keys(rows.select(F.col("k").alias("key"))).collect()


def test_large_value(spark):
    df = frame(spark, [("k" * 1024, 1, "x" * (1 << 20), False)])
    assert resolve.live(df).select(F.length("value")).first()[0] == 1 << 20


def test_tombstones(spark):
    ops = log(*[(f"key{i:04d}", "value") for i in range(10)], *[(f"key{i:04d}",) for i in range(0, 10, 2)])
    df = frame(spark, ops)
    assert set(as_dict(resolve.live(df))) == {f"key{i:04d}" for i in range(1, 10, 2)}
    assert resolve.tombstones(df).count() == 5


def test_updates_win(spark):
    ops = log(*[(f"key{i:04d}", f"v1-{i:04d}") for i in range(100)], *[(f"key{i:04d}", f"v2-{i:04d}") for i in range(100)])
    assert as_dict(resolve.live(frame(spark, ops))) == {f"key{i:04d}": f"v2-{i:04d}" for i in range(100)}


def test_mixed_puts_updates_deletes(spark):
    ops = log(*[(f"key{i}", f"value{i}") for i in range(100)], *[(f"key{i}", f"updated{i}") for i in range(50)], *[(f"key{i}",) for i in range(50, 100)], *[(f"key{i}", f"value{i}") for i in range(100, 200)])
    found = as_dict(resolve.live(frame(spark, ops)))
    assert len(found) == 150
    assert sum(v.startswith("updated") for v in found.values()) == 50


def test_range_is_half_open(spark):
    df = frame(spark, log(*[(f"key{i:03d}", f"value{i:03d}") for i in range(100)]))
    assert [r.key for r in scan.range_scan(df, "key020", "key030").collect()] == [f"key{i:03d}" for i in range(20, 30)]
    assert scan.range_scan(df, "key020", "key030", end_inclusive=True).count() == 11
    assert scan.range_scan(df).count() == 100


def test_prefix_and_tilde(spark):
    df = frame(spark, log(("user:1", "a"), ("user:~", "b"), ("user:é", "c"), ("usez", "d")))
    assert {r.key for r in scan.prefix_scan(df, "user:").collect()} == {"user:1", "user:~", "user:é"}
    assert {r.key for r in scan.tilde_scan(df, "user:").collect()} == {"user:1"}


def test_delete_then_reinsert(spark):
    ops = log(*[(f"key{i:03d}", f"value{i:03d}") for i in range(50)], *[(f"key{i:03d}",) for i in range(25)], *[(f"key{i:03d}", f"UPDATED{i:03d}") for i in range(25)])
    found = as_dict(resolve.live(frame(spark, ops)))
    assert len(found) == 50
    assert sum(v.startswith("UPDATED") for v in found.values()) == 25


def test_lookups(spark):
    df = frame(spark, log(("a", "1"), ("b", "2"), ("b",), ("c", "3")))
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert as_dict(scan.get(df, "a")) == {"a": "1"}
    assert as_dict(scan.get(df, "b")) == {}
    assert as_dict(scan.multi_get(df, keys)) == {"a": "1"}
    assert {r.key for r in scan.missing(df, keys).collect()} == {"b", "x"}


def test_diff(spark):
    df = frame(spark, log(("a", "1"), ("b", "2"), ("c", "3"), ("a", "9"), ("b",), ("d", "4")))
    assert {r.key: r.change for r in resolve.diff(df, 3, 6).collect()} == {"a": "changed", "b": "removed", "d": "added"}


@pytest.mark.parametrize("seed", range(4))
def test_any_schedule_gives_the_same_snapshot(spark, seed):
    """Flushes and merges of any runs in any grouping, with tombstones dropped only at the bottom."""
    rng = random.Random(seed)
    ops = log(*[(f"k{rng.randrange(12)}", f"v{i}") if rng.random() < 0.7 else (f"k{rng.randrange(12)}",) for i in range(120)])
    cuts = sorted(rng.sample(range(1, 120), 5))
    runs = [ops[a:b] for a, b in zip([0, *cuts], [*cuts, 120], strict=True)]
    frames = [resolve.latest(frame(spark, r)) for r in runs]
    while len(frames) > 1:
        i = rng.randrange(len(frames) - 1)
        frames[i : i + 2] = [resolve.compact(frames[i : i + 2], bottom=i == 0)]
    assert as_dict(resolve.live(frames[0])) == snapshot(ops)


def test_newer_tombstone_hides_older_runs(spark):
    older, newer = frame(spark, [("a", 1, "old", False)]), frame(spark, [("a", 2, None, True)])
    assert as_dict(resolve.live(resolve.merge_by_seq([newer, older]))) == {}
    assert resolve.merge_by_priority([newer, older]).first().deleted


def test_batches(spark):
    rows = spark.createDataFrame([("b", "1", 10), ("a", "2", 20), ("b", "3", 30)], "k string, v string, at long")
    batch = oplog.puts(rows, F.col("k"), F.col("v")).withColumn("at", F.monotonically_increasing_id())
    ops = oplog.sequenced(batch, "at", base=7)
    assert sorted(r.seq for r in ops.collect()) == [8, 9, 10]
    assert as_dict(oplog.squeezed(ops)) == {"a": "2", "b": "3"}
    gone = oplog.deletes(spark.createDataFrame([("a",), ("zz",)], "k string"), F.col("k"))
    assert [r.key for r in oplog.absent_deletes(gone, ops).collect()] == ["zz"]


def test_apply_batch_and_compaction(spark):
    index = spark.createDataFrame([(f"key{i}", 1) for i in range(100)], "key string, segment long")
    updates = spark.createDataFrame([(f"key{i}", 2) for i in range(50)], "key string, segment long")
    deletions = spark.createDataFrame([(f"key{i}",) for i in range(50, 100)], "key string")
    left = resolve.apply_batch(index, updates, deletions)
    assert {(r.key, r.segment) for r in left.collect()} == {(f"key{i}", 2) for i in range(50)}
    compacted = spark.createDataFrame([("key1", 9)], "key string, new_segment long")
    fate = {r.key: r.action for r in resolve.apply_compaction(index.where("key in ('key1', 'key2')"), compacted, F.col("segment") < 5).collect()}
    assert fate == {"key1": "updated", "key2": "deleted"}


def test_runs(spark):
    df = frame(spark, log(*[(f"key{i:03d}", "x" * 10) for i in range(40)]))
    sizes = [r.run for r in R.assign_by_bytes(df, 100).orderBy("seq").collect()]
    assert sizes == [((i + 1) * 32 - 1) // 100 for i in range(40)]
    manifest = spark.createDataFrame([(0, 1, "a", "f"), (0, 2, "e", "k"), (1, 3, "c", "d"), (1, 4, "x", "z")], "level int, file_num long, min_key string, max_key string")
    assert {r.file_num for r in R.overlapping(manifest, "d", "e").collect()} == {1, 2, 3}
    assert {r.file_num for r in R.covering(manifest, "f").collect()} == {1, 2}
    assert {(r.a, r.b) for r in R.overlap_pairs(manifest).collect()} == {(1, 2), (1, 3)}
    assert {r.file_num for r in R.pick_files(manifest, 0).collect()} == {1, 2, 3}
    files = {r.file for r in R.assign_by_entries(df, 15).collect()}
    assert len(files) == 3


def test_sparse_index(spark):
    df = resolve.live(frame(spark, log(*[(f"key{i:03d}", "v") for i in range(0, 100, 2)])))
    index = R.sparse_index(df, 8, head=4)
    assert {(r.block, r.first_key) for r in index.collect()} == {(b, f"key{b * 16:03d}") for b in range(7)}
    probes = spark.createDataFrame([("a",), ("key000",), ("key015",), ("key016",), ("zz",)], "key string")
    assert {r.key: r.block for r in R.block_of(probes, index, head=4).collect()} == {"a": None, "key000": 0, "key015": 0, "key016": 1, "zz": 6}


def test_recovery(spark):
    ops = frame(spark, log(*[(f"key{i}", "v") for i in range(100)], *[(f"key{i}",) for i in range(50)]))
    found, last = replay(ops)
    assert (found.count(), last, resolve.latest(ops).count()) == (50, 150, 100)
    assert replay(ops.where("seq < 0"))[1] == 0
    pages = spark.createDataFrame([(1, "write", 7, "a"), (2, "write", 7, "b"), (3, "checkpoint", 0, None), (4, "write", 7, "c")], "log_id long, type string, page_id long, data string")
    assert [r.data for r in replay_pages(up_to_checkpoint(pages)).collect()] == ["b"]
    assert [r.data for r in replay_pages(up_to_checkpoint(pages.where("log_id != 3"))).collect()] == ["c"]
    records = spark.createDataFrame([("k", 1, 0, 30, False), ("k", 2, 0, 31, False), ("k", 1, 90, 32, False)], "key string, file_num long, offset long, size long, deleted boolean")
    assert rebuild_index(records).first().size == 31


def test_checksums(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "at long, payload string").withColumn("crc", F.crc32(F.col("payload").cast("binary")) + (F.col("at") == 2).cast("long"))

    def of(mode):
        return [r.at for r in checked(rows, order="at", payload="payload", crc="crc", mode=mode).orderBy("at").collect()]

    assert of("truncate") == [1]
    assert of("skip") == [1, 3]
    with pytest.raises(Exception, match="checksum"):
        of("fail")


def test_fail_mode_fails_whatever_columns_are_read(spark):
    log = spark.createDataFrame([(1, "a", 3904355907), (2, "b", 0)], "id long, p string, crc long")
    with pytest.raises(Exception, match="checksum mismatch"):
        checked(log, order="id", payload="p", crc="crc", mode="fail").select("id", "p").collect()
    assert checked(log.where("id = 1"), order="id", payload="p", crc="crc", mode="fail").select("id").count() == 1


def test_range_counts_with_few_and_many_ranges(spark, monkeypatch):
    ops = frame(spark, log(*[(f"k{i:03d}", "v") for i in range(50)], ("k010",)))
    ranges = [("all", None, None), ("low", None, "k005"), ("high", "k045", None), ("mid", "k008", "k012"), ("empty", "k9", "k1"), ("same", "k003", "k003"), ("mid", "k008", "k012")]
    df = spark.createDataFrame(ranges, "range_id string, start string, end string")
    want = {"all": 49, "low": 5, "high": 5, "mid": 3, "empty": 0, "same": 0}
    assert {r.range_id: r.n for r in scan.range_counts(ops, df).collect()} == want
    assert scan.range_counts(ops, df.limit(0)).count() == 0
    monkeypatch.setattr(scan, "FEW_RANGES", 2)
    assert {r.range_id: r.n for r in scan.range_counts(ops, df.dropDuplicates()).collect()} == want
