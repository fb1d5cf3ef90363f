"""Stored tables, framed files and streams."""

import random

import pytest

from logstrata.functions.model import Closed, Corrupt, DiskFull, LateOperation
from logstrata.sources import records
from logstrata.sources.manifest import Manifest
from logstrata.sources.table import LAYOUTS, KVTable
from logstrata.streaming.ingest import store_batch, unordered_stream, upsert_stream
from tests.kvmodel import as_dict, frame, log, snapshot


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_agree_with_the_model(spark, tmp_path, layout):
    rng = random.Random(layout)
    ops = log(*[(f"k{rng.randrange(30):02d}", f"v{i}") if rng.random() < 0.7 else (f"k{rng.randrange(30):02d}",) for i in range(150)])
    table = KVTable(spark, str(tmp_path / layout), layout=layout, l0_runs=2, max_segments=3)
    for a in range(0, 150, 30):
        table.flush(frame(spark, ops[a : a + 30]))
        table.compact()
        assert as_dict(table.snapshot()) == snapshot(ops[: a + 30])
    key = next(iter(snapshot(ops)))
    assert as_dict(table.get(key)) == {key: snapshot(ops)[key]}
    assert [r.key for r in table.range_scan("k05", "k20").collect()] == sorted(k for k in snapshot(ops) if "k05" <= k < "k20")
    assert {r.key for r in table.prefix_scan("k1").collect()} == {k for k in snapshot(ops) if k.startswith("k1")}
    table.vacuum()
    assert as_dict(KVTable(spark, str(tmp_path / layout), layout=layout).snapshot()) == snapshot(ops)


def test_reopen_close_budget(spark, tmp_path):
    root = str(tmp_path / "t")
    with KVTable(spark, root) as table:
        table.flush(frame(spark, [("key1", 1, "value1", False)]))
    with pytest.raises(Closed):
        table.snapshot()
    table.close()
    table = KVTable(spark, root)
    table.flush(frame(spark, [("key2", 2, "value2", False), ("key1", 3, "updated1", False)]))
    assert as_dict(KVTable(spark, root).snapshot()) == {"key1": "updated1", "key2": "value2"}
    assert table.files_read("key2") == 1
    small = KVTable(spark, str(tmp_path / "small"), disk_budget=10)
    with pytest.raises(DiskFull):
        small.flush(frame(spark, [("key", 1, "a long value", False)]))
    assert small.snapshot().count() == 0
    assert KVTable(spark, str(tmp_path / "none")).snapshot().count() == 0


def test_manifest(spark, tmp_path):
    (tmp_path / "CURRENT").write_text("something else")
    with pytest.raises(Corrupt):
        Manifest(spark, str(tmp_path)).version()
    fresh = Manifest(spark, str(tmp_path / "m"))
    assert fresh.version() == 0
    row = (0, 1, "runs/L0-000001", "a", "b", 1, 0, 10, 1, 1)
    assert (fresh.commit([row]), fresh.commit([row])) == (1, 2)
    assert fresh.read().count() == 1
    (tmp_path / "m" / "CURRENT").rename(tmp_path / "m" / "CURRENT.2")  # a crash before the rename
    assert Manifest(spark, str(tmp_path / "m")).recover() == 2


def test_segments(spark, tmp_path):
    gull, tern, auk = records.segment_record(5, b"gull", b"grey"), records.segment_record(6, b"tern", b""), records.segment_record(7, b"gull", b"white")
    (tmp_path / "3.seg").write_bytes(gull + tern)
    (tmp_path / "8.seg").write_bytes(auk + gull + tern[:-1])
    (tmp_path / "40.seg").write_bytes(b"")
    for stray in ("8.seg.old", "x8.seg", "seg"):
        (tmp_path / stray).write_text("x")
    found = records.read_segments(spark, str(tmp_path))
    assert found.count() == 4
    from logstrata.operators.resolve import live

    assert as_dict(live(records.as_ops(found))) == {"gull": "grey"}
    with pytest.raises(Exception, match="damaged"):
        records.read_segments(spark, str(tmp_path), mode="fail").collect()
    hurt = bytearray(gull)
    hurt[-1] ^= 1
    (tmp_path / "40.seg").write_bytes(bytes(hurt) + tern)
    assert records.read_segments(spark, str(tmp_path), mode="skip").where("file_num = 40").count() == 1
    places = found.select("file_num", "offset", "size").unionByName(spark.createDataFrame([(40, 0, len(gull)), (3, 1, 9)], "file_num long, offset long, size long"))
    at = {(r.file_num, r.offset): r for r in records.read_at(spark, str(tmp_path), places).collect()}
    assert len(at) == 6 and [k for k, r in at.items() if not r.ok] == [k for k in at if k in ((40, 0), (3, 1))]
    assert (bytes(at[8, 0].key), bytes(at[8, 0].value), at[8, 0].ts) == (b"gull", b"white", 7)
    assert at[3, len(gull)].value is None


def test_opaque_bytes(spark, tmp_path):
    raws = [b"\xff\x00", b"\xfe\x00", "é".encode()]
    (tmp_path / "1.seg").write_bytes(b"".join(records.segment_record(1, r, r) for r in raws))
    (tmp_path / "1.wal").write_bytes(b"".join(records.log_record(i, r, r, False) for i, r in enumerate(raws)))
    for read in (records.read_segments, records.read_log):
        assert sorted(bytes(r.key) for r in read(spark, str(tmp_path), binary=True).collect()) == sorted(raws)
        with pytest.raises(Exception, match="UTF-8"):
            read(spark, str(tmp_path)).collect()


def test_log_files(spark, tmp_path):
    ops = log(("a", "1"), ("b", "é"), ("a",))
    framed = records.encode_log(frame(spark, ops)).orderBy("seq").collect()
    raw = b"".join(bytes(r.record) for r in framed)
    assert raw == b"".join(records.log_record(s, k.encode(), (v or "").encode(), d) for k, s, v, d in ops)
    (tmp_path / "x.wal").write_bytes(raw)
    assert [(r.key, r.seq, r.value, r.deleted) for r in records.read_log(spark, str(tmp_path)).orderBy("seq").collect()] == ops
    (tmp_path / "x.wal").write_bytes(raw[:-1])
    assert records.read_log(spark, str(tmp_path), mode="truncate").count() == 2


def test_streams(spark, tmp_path):
    ops = log(*[(f"k{i % 7}", f"v{i}") for i in range(40)], ("k3",))
    source = tmp_path / "in"
    table = KVTable(spark, str(tmp_path / "table"), l0_runs=2)
    for a, b in ((0, 20), (20, 41)):
        frame(spark, ops[a:b]).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(source))
        upsert_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
        assert as_dict(table.snapshot()) == snapshot(ops[:b])
    files = len(table._files())
    store_batch(table, frame(spark, ops[20:41]), number=(str(tmp_path / "cp"), 1))  # the same batch again
    assert as_dict(table.snapshot()) == snapshot(ops) and len(table._files()) == files


def test_a_stream_may_begin_with_operation_0(spark, tmp_path):
    ops = [(f"k{i}", i, f"v{i}", False) for i in range(6)]
    table = KVTable(spark, str(tmp_path / "table"))
    frame(spark, ops).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
    upsert_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert as_dict(table.snapshot()) == snapshot(ops)


def test_a_stream_in_many_partitions_takes_little_room(spark, tmp_path):
    ops = [(f"k{i:02d}", i, f"v{i}", False) for i in range(32)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = KVTable(spark, str(tmp_path / "table"))
        frame(spark, ops).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(str(tmp_path / "in"))
        upsert_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
        written = list((tmp_path / "table" / "runs").rglob("*.parquet"))
        assert len(written) > 8 and sum(f.stat().st_size for f in written) < 10_000 * len(written)
        assert as_dict(table.snapshot()) == snapshot(ops)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_late_operations_are_stored(spark, tmp_path):
    ops = log(("a", "1"), ("b", "2"), ("c", "3"), ("a", "4"))
    table = KVTable(spark, str(tmp_path / "t"))
    store_batch(table, frame(spark, [ops[0], ops[3]]), number=("s", 0))
    store_batch(table, frame(spark, ops[1:3]), number=("s", 1))
    assert as_dict(table.snapshot()) == snapshot(ops)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_random_schedules_of_flushes_merges_and_late_rows(spark, tmp_path, layout):
    """Out of order by up to ``lateness`` operations, with many half merges."""
    rng = random.Random(layout + "!")
    ops = log(*[(f"k{rng.randrange(8)}", f"v{i}") if rng.random() < 0.5 else (f"k{rng.randrange(8)}",) for i in range(100)])
    order = sorted(range(100), key=lambda i: i + rng.randrange(20))
    table = KVTable(spark, str(tmp_path / layout), layout=layout, l0_runs=2, max_segments=4, lateness=100)
    tight = KVTable(spark, str(tmp_path / "tight"), layout=layout, l0_runs=2, max_segments=4)
    for a in range(0, 100, 10):
        part = [ops[i] for i in order[a : a + 10]]
        table.flush(frame(spark, part))
        tight.flush(frame(spark, ops[a : a + 10]))
        if rng.random() < 0.7:
            table.compact(force=True)
            tight.compact(force=True)
        assert as_dict(table.snapshot()) == snapshot(sorted((ops[i] for i in order[: a + 10]), key=lambda r: r[1]))
        assert as_dict(tight.snapshot()) == snapshot(ops[: a + 10])
    if layout == "clustered":
        assert not any(f.n_tombstones for f in tight._files())


def test_deleted_keys_stay_deleted_through_half_merges(spark, tmp_path):
    ops = log(("k", "1"), ("a", "2"), ("b", "3"), ("c", "4"), ("k",), ("d", "6"), ("e", "7"), ("f", "8"))
    table = KVTable(spark, str(tmp_path / "t"), layout="append")
    for op in ops:
        table.flush(frame(spark, [op]))
    for _ in range(4):
        table.compact(force=True)
        assert as_dict(table.snapshot()) == snapshot(ops)


def test_the_first_operation_may_have_any_number(spark, tmp_path):
    for first in (0, -5):
        table = KVTable(spark, str(tmp_path / f"t{first}"), l0_runs=2)
        table.flush(frame(spark, [("a", first, "x", False), ("b", first + 1, "y", False)]))
        table.flush(frame(spark, [("c", first + 2, "z", False)]))
        table.compact()
        assert as_dict(table.snapshot()) == {"a": "x", "b": "y", "c": "z"}
        table.flush(frame(spark, [("d", first - 1, "late", False)]))  # no tombstone was dropped
        assert as_dict(table.snapshot()) == {"a": "x", "b": "y", "c": "z", "d": "late"}


def test_a_dropped_tombstone_may_have_number_0(spark, tmp_path):
    table = KVTable(spark, str(tmp_path / "t"))
    table.flush(frame(spark, [("k", 0, None, True)]))
    table.flush(frame(spark, [("a", 1, "x", False)]))
    table.compact(force=True)
    assert [r.key for r in table.ops().collect()] == ["a"]
    with pytest.raises(LateOperation):
        table.flush(frame(spark, [("k", -1, "old", False)]))


def test_half_merges_of_runs_that_begin_with_operation_0(spark, tmp_path):
    ops = [(f"k{i}", i, f"v{i}", False) for i in range(4)] + [("k0", 4, None, True), ("k1", 5, "new", False)]
    table = KVTable(spark, str(tmp_path / "t"), layout="append")
    for at in range(0, 6, 2):
        table.flush(frame(spark, ops[at : at + 2]))
    table.compact(force=True)
    assert as_dict(table.snapshot()) == snapshot(ops)


@pytest.mark.parametrize("layout", ("append", "levelled"))
def test_runs_in_many_partitions_take_little_room(spark, tmp_path, layout):
    ops = [(f"k{i:02d}", i, f"v{i}", i % 5 == 4) for i in range(64)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = KVTable(spark, str(tmp_path / "t"), layout=layout)
        table.flush(frame(spark, ops[:32]))
        table.flush(frame(spark, ops[32:]))
        table.compact(force=True)
        written = list((tmp_path / "t" / "runs").rglob("*.parquet"))
        assert len(written) > 32 and sum(f.stat().st_size for f in written) < 10_000 * len(written)
        assert as_dict(table.snapshot()) == snapshot(ops)
        assert as_dict(table.get("k07")) == {"k07": "v7"} and table.get("k04").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_operations_older_than_a_dropped_tombstone_are_refused(spark, tmp_path):
    table = KVTable(spark, str(tmp_path / "t"), l0_runs=1)
    table.flush(frame(spark, [("k", 10, None, True), ("a", 11, "x", False)]))
    table.flush(frame(spark, [("a", 12, "y", False)]))
    table.compact(force=True)
    assert [r.deleted for r in table.ops().collect()] == [False]
    with pytest.raises(LateOperation):
        table.flush(frame(spark, [("k", 5, "old", False)]))
    assert as_dict(KVTable(spark, str(tmp_path / "t")).snapshot()) == {"a": "y"}
    kept = KVTable(spark, str(tmp_path / "kept"), lateness=10)
    kept.flush(frame(spark, [("k", 10, None, True)]))
    kept.flush(frame(spark, [("a", 12, "y", False)]))
    kept.compact(force=True)
    kept.flush(frame(spark, [("k", 5, "old", False)]))
    assert as_dict(kept.snapshot()) == {"a": "y"}


def test_unordered_stream(spark, tmp_path):
    ops = log(*[(f"k{i % 3}", f"v{i}") for i in range(9)])
    seen = []
    source = str(tmp_path / "in")
    for part in (ops[4:], ops[:4]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(spark, []).schema).parquet(source)
        unordered_stream(stream, lambda batch, _: seen.extend((r.key, r.seq) for r in batch.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("k0", 7), ("k1", 8), ("k2", 9)]
