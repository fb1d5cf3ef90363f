"""Queries over the driver tables, one or more for each operator, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions import bloom
from logstrata.functions import scalars as S
from logstrata.operators import oplog, ordered, recover, resolve, scan, stats, workload
from logstrata.operators import runs as R
from logstrata.plans.logs import EVENTS_SQL, ORDERS_SQL, customer_key, events_log, last_sql, orders_log, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EV = f"with {EVENTS_SQL}"
OD = f"with {ORDERS_SQL}"
EV_LAST = f"{EV}, {last_sql('ev', 'lt')}"
OD_LAST = f"{OD}, {last_sql('od', 'lt')}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- resolution ---------------------------------------------------------------------------------------


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted")
def snapshot_latest(spark, sf_dir):
    return resolve.live(events_log(spark, sf_dir))


AS_OF = 5000


@query(f"{EV}, {last_sql('ev', 'lt', f'seq <= {AS_OF}')} select key, seq, value, deleted from lt where not deleted")
def snapshot_as_of(spark, sf_dir):
    return resolve.as_of(events_log(spark, sf_dir), AS_OF)


@query(f"{EV_LAST} select key, seq from lt where deleted")
def tombstones(spark, sf_dir):
    return resolve.tombstones(events_log(spark, sf_dir)).select("key", "seq")


@query(f"{EV_LAST} select count(*) as n_index, count(*) filter (where not deleted) as n_live from lt")
def raw_index_count(spark, sf_dir):
    last = resolve.latest(events_log(spark, sf_dir))
    return last.agg(F.count("*").alias("n_index"), F.count(F.when(~F.col("deleted"), 1)).alias("n_live"))


@query(f"{EV} select key, seq, value, deleted from ev where key = 'user:0000000042'")
def key_history(spark, sf_dir):
    return resolve.history(events_log(spark, sf_dir, user=42), "user:0000000042")


@query(
    f"{EV}, {last_sql('ev', 'a', 'seq <= 2000')}, {last_sql('ev', 'b', 'seq <= 8000')}"
    " select * from (select b.key, case when coalesce(not a.deleted, false) and b.deleted then 'removed' when not coalesce(not a.deleted, false) and not b.deleted then 'added'"
    " when not a.deleted and not b.deleted and a.value is distinct from b.value then 'changed' end as change, case when not a.deleted then a.value end as old_value, case when not b.deleted then b.value end as new_value"
    " from b left join a on a.key = b.key) where change is not null"
)
def snapshot_diff(spark, sf_dir):
    return resolve.diff(events_log(spark, sf_dir), 2000, 8000)


@query(
    "select * exclude (rn) from (select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, row_number() over (partition by l_orderkey, l_linenumber"
    " order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_returnflag desc) as rn from lineitem) where rn = 1 and l_returnflag <> 'R'"
)
def lineitem_upsert(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *order)
    return resolve.latest(rows, ["l_orderkey", "l_linenumber"], order).where("l_returnflag != 'R'")


@query(
    "select c_custkey, c_name, o_orderkey, o_totalprice from customer left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1) on c_custkey = o_custkey"
)
def customer_last_order(spark, sf_dir):
    last = resolve.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"])
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


# --- lookups and scans ----------------------------------------------------------------------------------


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted and key = 'user:0000000007'")
def point_get(spark, sf_dir):
    return scan.get(events_log(spark, sf_dir, user=7), "user:0000000007")


@query(f"{OD_LAST} select key, seq, value, deleted from lt where not deleted and key in (select printf('cust:%08d', c_custkey) from customer where c_mktsegment = 'BUILDING')")
def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(customer_key(F.col("c_custkey")).alias("key"))
    return scan.multi_get(orders_log(spark, sf_dir), keys)


@query(f"{OD_LAST} select k as key from (select printf('cust:%08d', c_custkey) as k from customer) where k not in (select key from lt where not deleted)")
def negative_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(customer_key(F.col("c_custkey")).alias("key"))
    return scan.missing(orders_log(spark, sf_dir), keys)


@query(f"{OD_LAST} select key, value from lt where not deleted and key >= 'cust:00000020' and key < 'cust:00000300'")
def range_scan_half_open(spark, sf_dir):
    return scan.range_scan(orders_log(spark, sf_dir, low=20, high=300), "cust:00000020", "cust:00000300").select("key", "value")


@query(f"{OD_LAST} select key, value from lt where not deleted and key >= 'cust:00000020' and key <= 'cust:00000300'")
def range_scan_closed(spark, sf_dir):
    return scan.range_scan(orders_log(spark, sf_dir, low=20, high=300), "cust:00000020", "cust:00000300", end_inclusive=True).select("key", "value")


@query(f"{OD_LAST} select key, value from lt where not deleted")
def range_scan_unbounded(spark, sf_dir):
    return scan.range_scan(orders_log(spark, sf_dir)).select("key", "value")


@query(f"{OD_LAST} select key, value from lt where not deleted and starts_with(key, 'cust:000001')")
def prefix_scan(spark, sf_dir):
    return scan.prefix_scan(orders_log(spark, sf_dir, low=100, high=199), "cust:000001").select("key", "value")


@query(f"{OD_LAST} select key, value from lt where not deleted and key >= 'cust:0000' and key < 'cust:0000~'")
def prefix_scan_tilde(spark, sf_dir):
    return scan.tilde_scan(orders_log(spark, sf_dir), "cust:0000").select("key", "value")


RANGES = [("100", "cust:00000000", "cust:00000100"), ("1000", "cust:00000000", "cust:00001000"), ("5000", "cust:00000000", "cust:00005000"), ("full", None, None), ("none", "d", "e")]


@query(
    f"{OD_LAST}, ranges(range_id, lo, hi) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in RANGES) + ")"
    " select range_id, count(lt.key) as n from ranges left join lt on not deleted and (lo is null or key >= lo) and (hi is null or key < hi) group by range_id"
)
def range_counts(spark, sf_dir):
    return scan.range_counts(orders_log(spark, sf_dir), spark.createDataFrame(RANGES, "range_id string, start string, end string"))


@query(f"{OD_LAST} select key, value from lt where not deleted order by key limit 5")
def first_k_keys(spark, sf_dir):
    return scan.first_keys(orders_log(spark, sf_dir), 5).select("key", "value")


@query(f"{OD_LAST} select min(key) as min_key, max(key) as max_key from lt where not deleted")
def key_bounds(spark, sf_dir):
    return scan.key_bounds(orders_log(spark, sf_dir))


@query(f"{EV} select key from (select key, deleted, row_number() over (partition by key order by seq) as rn from ev) where rn = 1 and deleted")
def blind_deletes(spark, sf_dir):
    return scan.blind_deletes(events_log(spark, sf_dir))


# --- batches ----------------------------------------------------------------------------------------------


@query("select printf('user:%010d', user_id) as key, row_number() over (order by event_id) + 100 as seq, props as value, event_type = 'error' as deleted from events")
def sequence_assignment(spark, sf_dir):
    batch = table(spark, sf_dir, "events").select(S.user_key(F.col("user_id")).alias("key"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("deleted"), "event_id")
    return oplog.sequenced(batch, "event_id", base=100)


@query(f"{EV} select seq // 1000 as batch, key, max(seq) as seq from ev group by 1, 2")
def memtable_dedup(spark, sf_dir):
    batched = events_log(spark, sf_dir).withColumn("batch", F.expr("seq div 1000"))
    return resolve.latest(batched, ["batch", "key"]).select("batch", "key", "seq")


@query(f"{EV}, {last_sql('ev', 'lt', 'seq < 5000')} select distinct key from ev where seq >= 5000 and deleted and key not in (select key from lt where not deleted)")
def strict_delete_errors(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return oplog.absent_deletes(log.where("seq >= 5000"), log.where("seq < 5000"))


@query(
    f"{EV}, {last_sql('ev', 'idx', 'seq < 5000')}, {last_sql('ev', 'new', 'seq >= 5000')}"
    " select key, seq from idx where key not in (select key from new) union all select key, seq from new where not deleted"
)
def index_batch_update(spark, sf_dir):
    log = events_log(spark, sf_dir)
    batch = resolve.latest(log.where("seq >= 5000"))
    index = resolve.latest(log.where("seq < 5000")).select("key", "seq")
    return resolve.apply_batch(index, batch.where(~F.col("deleted")).select("key", "seq"), batch.where("deleted").select("key"))


# --- runs, merge, compaction -------------------------------------------------------------------------------


def _levels(log: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` operations: the three newest are level 0, the older ones level 1."""
    top = log.agg(F.expr(f"max(seq) div {size}").alias("top"))
    files = log.withColumn("file_num", F.expr(f"seq div {size}")).join(F.broadcast(top), F.lit(True))  # of one row
    return files.withColumn("level", F.when(F.col("file_num") > F.col("top") - 3, 0).otherwise(1)).drop("top")


def _manifest(spark, sf_dir, size: int = 1000) -> DataFrame:
    return R.summarise(_levels(events_log(spark, sf_dir), size), "level", "file_num")


MANIFEST_SQL = (
    f"{EV}, files as (select *, seq // 1000 as file_num, case when seq // 1000 > (select max(seq) // 1000 from ev) - 3 then 0 else 1 end as level from ev),"
    " mf as (select level, file_num, min(key) as min_key, max(key) as max_key, count(*) as n_entries, cast(sum(case when deleted then 1 else 0 end) as bigint) as n_tombstones,"
    " cast(sum(strlen(key) + coalesce(strlen(value), 0) + 9) as bigint) as bytes, min(seq) as min_seq, max(seq) as max_seq from files group by 1, 2)"
)


@query(f"{MANIFEST_SQL} select * from mf")
def run_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"{EV_LAST} select key, seq, value, deleted from lt")
def merge_two_runs(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.merge_by_seq([log.where("seq < 5000"), log.where("seq >= 5000")])


@query(f"{EV}, {last_sql('ev', 'a', 'seq >= 9000')}, {last_sql('ev', 'b', 'seq < 9000')} select * from a union all select * from b where key not in (select key from a)")
def merge_by_priority(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.merge_by_priority([resolve.latest(log.where("seq >= 9000")), resolve.latest(log.where("seq < 9000"))])


@query(
    f"{MANIFEST_SQL}, hull as (select min(min_key) as lo, max(max_key) as hi from mf where level = 0), picked as (select level, file_num from mf, hull where level = 0 or level = 1 and max_key >= lo and min_key <= hi),"
    f" own as (select files.* from files join picked using (level, file_num)), {last_sql('own', 'lt')} select key, seq, value, deleted from lt"
)
def compaction_l0(spark, sf_dir):
    """All runs of level 0 and those of level 1 that they overlap, merged; deeper levels may hold what tombstones hide."""
    rows, picked = _levels(events_log(spark, sf_dir), 1000), R.pick_files(_manifest(spark, sf_dir), 0).select("level", "file_num")
    return resolve.compact([rows.join(picked, ["level", "file_num"], "left_semi").select("key", "seq", "value", "deleted")], bottom=False)


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted")
def compaction_bottom(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return resolve.compact([log.where("seq < 3000"), log.where("seq >= 3000 and seq < 6000"), log.where("seq >= 6000")], bottom=True)


@query(
    f"{EV}, idx as (select key, max(seq) // 1000 as segment from ev group by key), {last_sql('ev', 'lt', 'seq < 8000')}, new as (select key, 99 as new_segment from lt where not deleted)"
    " select key, segment, case when segment >= 8 then 'kept' when new_segment is not null then 'updated' else 'deleted' end as action, cast(case when segment >= 8 then segment else new_segment end as bigint) as now from idx left join new using (key)"
)
def index_apply_compaction(spark, sf_dir):
    log = events_log(spark, sf_dir)
    index = log.groupBy("key").agg(F.expr("max(seq) div 1000").alias("segment"))
    compacted = resolve.live(log.where("seq < 8000")).select("key", F.lit(99).cast("long").alias("new_segment"))
    return resolve.apply_compaction(index, compacted, F.col("segment") < 8)


@query(f"{MANIFEST_SQL} select a.file_num as a, b.file_num as b from mf a join mf b on a.file_num < b.file_num and a.min_key <= b.max_key and b.min_key <= a.max_key")
def run_overlap_pairs(spark, sf_dir):
    return R.overlap_pairs(_manifest(spark, sf_dir))


@query(f"{MANIFEST_SQL} select file_num, min_key, max_key from mf where max_key >= 'user:0000000148' and min_key <= 'user:0000000149'")
def run_prune(spark, sf_dir):
    return R.overlapping(_manifest(spark, sf_dir), "user:0000000148", "user:0000000149").select("file_num", "min_key", "max_key")


@query(f"{MANIFEST_SQL} select file_num from mf where 'user:0000000149' between min_key and max_key")
def run_covers_key(spark, sf_dir):
    return R.covering(_manifest(spark, sf_dir), "user:0000000149").select("file_num")


@query(f"{EV} select seq, (cast(sum(strlen(key) + coalesce(strlen(value), 0) + 16) over (order by seq) as bigint) - 1) // 65536 as run from ev")
def run_assignment(spark, sf_dir):
    return R.assign_by_bytes(events_log(spark, sf_dir), 65536).select("seq", "run")


@query(f"{EV} select seq, (cast(sum(strlen(key) + coalesce(strlen(value), 0) + 20) over (order by seq) as bigint) - 1) // 16384 as segment from ev")
def segment_rotation(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return R.assign_by_bytes(log, 16384, size=S.hash_record_size(F.col("key"), F.col("value")), name="segment").select("seq", "segment")


@query(f"{OD_LAST}, ks as (select key, row_number() over (order by key) - 1 as n from lt where not deleted), ix as (select n // 64 as block, min(key) as first_key from ks group by 1) select block, first_key from ix")
def sparse_index(spark, sf_dir):
    return R.sparse_index(resolve.live(orders_log(spark, sf_dir)), 64, head=10)


@query(
    f"{OD_LAST}, ks as (select key, row_number() over (order by key) - 1 as n from lt where not deleted), ix as (select n // 64 as block, min(key) as first_key from ks group by 1),"
    " pr as (select printf('cust:%08d', c_custkey) as key from customer) select pr.key, ix.block from pr asof left join ix on pr.key >= ix.first_key"
)
def sparse_index_lookup(spark, sf_dir):
    index = R.sparse_index(resolve.live(orders_log(spark, sf_dir)), 64, head=10)
    probes = table(spark, sf_dir, "customer").select(customer_key(F.col("c_custkey")).alias("key"))
    return R.block_of(probes, index, head=10)


@query(f"{MANIFEST_SQL} select level, count(*) as n_files, cast(sum(bytes) as bigint) as bytes, cast(sum(n_entries) as bigint) as n_entries from mf group by rollup (level)")
def level_shape(spark, sf_dir):
    return R.level_shape(_manifest(spark, sf_dir))


@query(f"{MANIFEST_SQL} select level, count(*) as n_files, cast(sum(bytes) as bigint) as bytes, case when level = 0 then count(*) >= 3 else sum(bytes) >= 41943040 end as due from mf group by level")
def compaction_triggers(spark, sf_dir):
    return R.to_compact(_manifest(spark, sf_dir), l0_runs=3)


@query(f"{MANIFEST_SQL} select level, file_num from mf where level = 0 or max_key >= (select min(min_key) from mf where level = 0) and min_key <= (select max(max_key) from mf where level = 0)")
def compaction_inputs(spark, sf_dir):
    return R.pick_files(_manifest(spark, sf_dir), 0).select("level", "file_num")


@query(f"{MANIFEST_SQL} select file_num from mf where level = 1 order by min_key, file_num limit 1")
def level_compaction_pick(spark, sf_dir):
    return R.pick_files(_manifest(spark, sf_dir), 1).select("file_num")


@query(f"{MANIFEST_SQL} select file_num from mf order by file_num limit (select case when count(*) > 3 then greatest(2, cast(ceil(count(*) / 2.0) as bigint)) when count(*) < 2 then 0 else count(*) end from mf)")
def segments_to_merge(spark, sf_dir):
    return R.oldest_half(_manifest(spark, sf_dir)).select("file_num")


@query(f"{OD_LAST}, pg as (select key, cast(substr(key, 6) as bigint) // 50 as page_id from lt where not deleted) select page_id, key, case when row_number() over (partition by page_id order by key) <= count(*) over (partition by page_id) // 2 then 1 else 2 end as half from pg")
def leaf_split(spark, sf_dir):
    pages = resolve.live(orders_log(spark, sf_dir)).select("key", F.expr("cast(substring(key, 6) as bigint) div 50").alias("page_id"))
    return R.split_leaves(pages).select("page_id", "key", "half")


@query(
    f"{EV_LAST}, pg as (select cast(substr(key, 6) as bigint) // 10 as page_id, count(*) as n_cells from lt where not deleted group by 1), nx as (select *, lead(n_cells) over (order by page_id) as next_cells from pg)"
    " select page_id, n_cells, next_cells, case when n_cells >= 6 or next_cells is null then 'kept' when next_cells > 6 and n_cells + next_cells >= 12 then 'redistributed' else 'merged' end as action from nx"
)
def leaf_merge_plan(spark, sf_dir):
    pages = resolve.live(events_log(spark, sf_dir)).groupBy(F.expr("cast(substring(key, 6) as bigint) div 10").alias("page_id")).agg(F.count("*").alias("n_cells"))
    return R.merge_plan(ordered.following(pages, "page_id", "n_cells", "next_cells"))


# --- recovery -----------------------------------------------------------------------------------------------


def _page_log(spark, sf_dir) -> DataFrame:
    """Events as a page log: a user's events are images of its page, a large signup is a checkpoint."""
    events = table(spark, sf_dir, "events")
    mark = (F.col("event_type") == "signup") & (F.col("value") > 120)
    return events.select(F.col("event_id").alias("log_id"), F.when(mark, recover.CHECKPOINT).otherwise(recover.WRITE).alias("type"), F.col("user_id").alias("page_id"), F.col("props").alias("data"))


PAGES_SQL = "with pl as (select event_id as log_id, case when event_type = 'signup' and value > 120 then 'checkpoint' else 'write' end as type, user_id as page_id, props as data from events)"


@query(f"{PAGES_SQL} select page_id, log_id, data from (select *, row_number() over (partition by page_id order by log_id desc) as rn from pl where type = 'write' and log_id <= coalesce((select min(log_id) from pl where type = 'checkpoint'), 9223372036854775807)) where rn = 1")
def replay_checkpoint(spark, sf_dir):
    return recover.replay_pages(recover.up_to_checkpoint(_page_log(spark, sf_dir)))


@query(f"{EV_LAST} select count(*) filter (where not deleted) as n_live, (select max(seq) from ev) as last_seq from lt")
def wal_replay(spark, sf_dir):
    found, last = recover.replay(events_log(spark, sf_dir))
    return found.agg(F.count("*").alias("n_live"), F.lit(last).cast("long").alias("last_seq"))


@query(f"{EV} select key, file_num, \"offset\", size, deleted from (select key, seq // 500 as file_num, seq % 500 as \"offset\", strlen(key) + coalesce(strlen(value), 0) + 20 as size, deleted, row_number() over (partition by key order by seq desc) as rn from ev) where rn = 1")
def index_rebuild(spark, sf_dir):
    log = events_log(spark, sf_dir)
    records = log.select("key", F.expr("seq div 500").alias("file_num"), (F.col("seq") % 500).alias("offset"), S.hash_record_size(F.col("key"), F.col("value")).alias("size"), "deleted")
    return recover.rebuild_index(records)


@query("select event_id, props from events where event_id < (select min(event_id) from events where event_type = 'purchase' and value > 60)")
def truncate_damaged(spark, sf_dir):
    """Records up to the first whose checksum is wrong: that of a large purchase was damaged."""
    events = table(spark, sf_dir, "events")
    return recover.checked(_damaged_file(spark, events), order="event_id", payload="props", crc="crc").select("event_id", "props")


def _damaged_file(spark, events):
    """Payloads with checksums in a file; after the checksum was taken, payloads of large purchases lost their last character."""
    bad = (F.col("event_type") == "purchase") & (F.col("value") > 60)
    path = f"{_root(spark, 'log')}/log"
    sound = events.select("event_id", "props", S.crc32(F.col("props")).alias("crc"), bad.alias("bad"))
    sound.select("event_id", F.when(F.col("bad"), F.expr("left(props, length(props) - 1)")).otherwise(F.col("props")).alias("props"), "crc").write.parquet(path)
    return spark.read.parquet(path)


@query("select event_id, props from events where not (event_type = 'purchase' and value > 60)")
def crc_check(spark, sf_dir):
    """The records whose checksum holds, when the others are skipped."""
    return recover.checked(_damaged_file(spark, table(spark, sf_dir, "events")), order="event_id", payload="props", crc="crc", mode="skip").select("event_id", "props")


# --- scalars ------------------------------------------------------------------------------------------------

FNV_SQL = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(key, ''), lambda c: ascii(c)::bigint)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"with ks as (select distinct printf('cust:%08d', o_custkey) as key from orders) select key, {FNV_SQL} as hash, cast({FNV_SQL} % 256 as int) as shard from ks")
def fnv_hashes(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(customer_key(F.col("o_custkey")).alias("key")).distinct()
    return keys.select("key", S.fnv1a32(F.col("key")).alias("hash"), S.shard(F.col("key")).alias("shard"))


@query(f"with ks as (select distinct printf('cust:%08d', o_custkey) as key from orders) select cast({FNV_SQL} % 256 as int) as shard, count(*) as n_keys from ks group by 1")
def shard_distribution(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(customer_key(F.col("o_custkey")).alias("key")).distinct()
    return stats.shard_distribution(keys)


_K, _V = "strlen(key)", "coalesce(strlen(value), 0)"


def _varint_sql(x: str) -> str:
    return f"case when {x} < 128 then 1 when {x} < 16384 then 2 else 3 end"


@query(
    f"{EV} select seq, {_K} + {_V} + 20 as hash_bytes, {_K} + {_V} + 21 as wal_bytes, {_K} + {_V} + 9 as sst_bytes, {_K} + {_V} + 16 as memtable_bytes,"
    f" {_varint_sql(_K)} + {_varint_sql(_V)} + {_K} + {_V} as leaf_bytes, {_varint_sql(_K)} + 4 + {_K} as internal_bytes from ev"
)
def record_sizes(spark, sf_dir):
    k, v = F.col("key"), F.col("value")
    return events_log(spark, sf_dir).select(
        "seq", S.hash_record_size(k, v).alias("hash_bytes"), S.wal_record_size(k, v).alias("wal_bytes"), S.sst_entry_size(k, v).alias("sst_bytes"), S.memtable_size(k, v).alias("memtable_bytes"), S.leaf_cell_size(k, v).alias("leaf_bytes"), S.internal_cell_size(k).alias("internal_bytes")
    )


@query(f"select o_orderkey, {_varint_sql('o_orderkey')} as varint_bytes from orders")
def varint_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.varint_size(F.col("o_orderkey")).alias("varint_bytes"))


_BITS_SQL = "cast(ceil(-p_size * 1000 * ln(0.01) / (ln(2.0) * ln(2.0))) as bigint)"


@query(f"with b as (select p_partkey, p_size * 1000 as n, {_BITS_SQL} as bits from part) select p_partkey, bits, cast(ceil(bits / n * ln(2.0)) as bigint) as hashes from b")
def bloom_sizing(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000).alias("n")).withColumn("bits", S.bloom_bits(F.col("n"), 0.01))
    return sized.select("p_partkey", "bits", S.bloom_hashes(F.col("n"), F.col("bits")).alias("hashes"))


@query(f"with sizes as (select s_suppkey, cast(s_suppkey % 40 as bigint) as n, {_K.replace('key', 's_name')} as k from supplier) select s_suppkey, 4096 - n * (k + 102) - (10 + 2 * (n + 1)) >= k + 102 as fits from sizes")
def page_fit(spark, sf_dir):
    k, n = S.key_bytes(F.col("s_name")), F.col("s_suppkey") % 40
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.page_fits(n * (k + 102), n, k + 102).alias("fits"))


@query("select p_partkey, case when length(p_name) > 12 then substr(p_name, 1, 9) || '...' else p_name end as shown from part")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.shorten(F.col("p_name"), 12).alias("shown"))


@query(f"{OD_LAST} select 'cust:' || lpad(cast(c_custkey as varchar), 8, '0') as key from customer where key in (select key from lt where not deleted)")
def bloom_membership(spark, sf_dir):
    """Customers with orders: a filter of the keys with orders sorts out most others, and the keys decide on the rest."""
    held = resolve.live(orders_log(spark, sf_dir)).select("key")
    bits, hashes, words = bloom.build(held)
    probes = table(spark, sf_dir, "customer").select(customer_key(F.col("c_custkey")).alias("key"))
    return bloom.may_contain(probes, bits, hashes, words).where("may_contain").join(held, "key", "left_semi").select("key")


# --- statistics ---------------------------------------------------------------------------------------------


@query(
    f"{EV_LAST}, tot as (select count(*) as n_ops, cast(sum(case when deleted then 1 else 0 end) as bigint) as n_deletes, count(distinct key) as n_keys_seen, cast(sum({_K} + {_V} + 20) as bigint) as disk_bytes,"
    f" cast(sum(case when not deleted then {_K} + {_V} end) as bigint) as user_bytes from ev), lv as (select count(*) as n_keys, cast(sum({_K} + {_V}) as bigint) as logical_bytes from lt where not deleted)"
    " select n_ops, n_deletes, n_keys_seen, n_keys, logical_bytes, disk_bytes, user_bytes, round(disk_bytes / logical_bytes, 6) as space_amp, round(disk_bytes / user_bytes, 6) as write_amp from tot, lv"
)
def stats_amplification(spark, sf_dir):
    found = stats.amplification(events_log(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("space_amp", "write_amp")})


@query(
    f"{OD_LAST}, c as (select count(*) as n_keys, cast(sum({_varint_sql(_K)} + {_varint_sql(_V)} + {_K} + {_V} + 2) as bigint) as cell_bytes, cast(sum({_K} + {_V}) as bigint) as user_bytes from lt where not deleted)"
    " select n_keys, cell_bytes, user_bytes, cast(ceil(cell_bytes / (4086 * 0.7::double)) as bigint) as n_pages, cast(ceil(cell_bytes / (4086 * 0.7::double)) as bigint) * 4096 as disk_bytes, round(cast(ceil(cell_bytes / (4086 * 0.7::double)) as bigint) * 4096 / user_bytes, 6) as space_amp from c"
)
def stats_paged(spark, sf_dir):
    return stats.paged(orders_log(spark, sf_dir)).withColumn("space_amp", F.round("space_amp", 6))


@query(
    "with c as (select s_nationkey, count(*) % 4 as flushes, count(*) % 7 as compactions, count(*) % 9 as l0_files from supplier group by 1) select *,"
    " case when flushes = 0 then 1.0 else round(least(5.0, 1.5 + 0.5 * compactions / flushes), 6) end::double as write_amp,"
    " case when flushes = 0 then 1.0 when l0_files > 2 then round(least(3.0, 1.5 + 0.1 * l0_files), 6) else 1.2 end::double as space_amp from c"
)
def stats_levelled(spark, sf_dir):
    counted = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    counters = counted.select("s_nationkey", (F.col("n") % 4).alias("flushes"), (F.col("n") % 7).alias("compactions"), (F.col("n") % 9).alias("l0_files"))
    return stats.levelled_heuristics(counters).withColumns({c: F.round(c, 6) for c in ("write_amp", "space_amp")})


@query(f"{EV_LAST} select count(*) as n_keys from lt where not deleted")
def key_count(spark, sf_dir):
    return stats.key_count(events_log(spark, sf_dir))


@query("select o_orderkey, cast(sum(cast(o_totalprice as bigint)) over (order by o_orderkey) as bigint) as in_use, sum(cast(o_totalprice as bigint)) over (order by o_orderkey) <= 500000000 as fits from (select o_orderkey, floor(o_totalprice) as o_totalprice from orders)")
def resource_running_total(spark, sf_dir):
    sized = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("size"))
    return stats.within_budget(sized, 500_000_000, order="o_orderkey", size="size").select("o_orderkey", "in_use", "fits")


# --- workloads ----------------------------------------------------------------------------------------------

_PICK = "list_sort(list(l_quantity))[least(count(*) * {p} // 1000, count(*) - 1) + 1]"


@query(
    "select l_returnflag, count(*) as n, min(l_quantity) as min, max(l_quantity) as max, round(sum(l_quantity) / count(*), 6) as mean, " + ", ".join(f"{_PICK.format(p=p)} as {n}" for n, p in (("p50", 500), ("p95", 950), ("p99", 990), ("p999", 999))) + " from lineitem group by 1"
)
def latency_percentiles(spark, sf_dir):
    return workload.latency_stats(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag").withColumn("mean", F.round("mean", 6))


@query(
    "with o as (select user_id % 5 as worker, case when event_type in ('view', 'click') then 'get' when event_type = 'error' then 'delete' else 'put' end as op, epoch_us(ts) as us from events),"
    " c as (select worker, count(*) as ops, count(*) filter (where op in ('put', 'delete')) as writes, count(*) filter (where op = 'get') as reads, (max(us) - min(us)) / 1000000.0::double as seconds from o group by 1)"
    " select worker, ops, writes, reads, round(seconds, 3) as seconds, round(ops / seconds, 9) as ops_per_s, round(writes / seconds, 9) as writes_per_s, round(reads / seconds, 9) as reads_per_s from c"
)
def throughput_mix(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    samples = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("worker"), kind.alias("op"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = workload.throughput(samples, (F.max("us") - F.min("us")) / 1e6, "worker")
    return found.withColumns({"seconds": F.round("seconds", 3), **{c: F.round(c, 9) for c in ("ops_per_s", "writes_per_s", "reads_per_s")}})


@query("select l_returnflag as workload, max(case when l_linestatus = 'F' then q end) as F, max(case when l_linestatus = 'O' then q end) as O, max(case when l_linestatus = 'X' then q end) as X from (select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by 1, 2) group by 1")
def engine_pivot(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("workload"), F.col("l_linestatus").alias("engine")).agg(F.sum("l_quantity").alias("q"))
    return workload.compare(results, "workload", "engine", ["F", "O", "X"], F.col("q"))


N_OPS = 20_000


def _uniform_sql(x: str, salt: int) -> str:
    return f"(((({x} * 1103515245 + 12345 + {salt * 7919}) % 2147483648) * 69069 + 1) % 2147483648) / 2147483648.0::double"


def _keys(distribution: str, n: int):
    def run(spark, sf_dir):
        return spark.range(N_OPS).select(F.col("id").alias("op_id"), S.user_key(workload.key_number(F.col("id"), distribution, n)).alias("key"))

    run.__name__ = f"key_distribution_{distribution}"
    return run


_OPS = f"from range({N_OPS}) t(id)"
query(f"select id as op_id, printf('user:%010d', (id + 1) % 1000) as key {_OPS}")(_keys("sequential", 1000))
query(f"select id as op_id, printf('user:%010d', cast(floor({_uniform_sql('id', 0)} * 1000) as bigint)) as key {_OPS}")(_keys("uniform", 1000))
query()(_keys("zipfian", 1000))
query()(_keys("latest", 1000))


@query(
    f"with o as (select case when {_uniform_sql('id', 17)} < 0.95::double then 'put' else 'get' end as op, cast(floor({_uniform_sql('id', 0)} * 50000) as bigint) as k {_OPS}) select op, count(*) as n, count(distinct k) as n_keys from o group by 1"
)
def workload_trace(spark, sf_dir):
    made = workload.trace(spark, workload.find("write-heavy"), N_OPS)
    return made.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"))


@query(f"{EV} select seq, cast(row_number() over (order by seq) as bigint) as nth from ev")
def global_row_numbers(spark, sf_dir):
    return ordered.row_numbers(events_log(spark, sf_dir).select("seq"), "seq", "nth")


# --- stored tables and streams --------------------------------------------------------------------------------


def _root(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only in local mode, where they are one process."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and (spark.sparkContext.master + "[").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    shared = shared or tempfile.mkdtemp(prefix="logstrata-")
    root = f"{shared.rstrip('/')}/logstrata-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return root


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted")
def stored_snapshot(spark, sf_dir):
    """The log flushed in three runs and compacted, read back: any schedule gives the same snapshot."""
    from logstrata.sources.table import KVTable

    kv, log = KVTable(spark, _root(spark, "kv"), l0_runs=2), events_log(spark, sf_dir)
    for part in ("seq < 3000", "seq >= 3000 and seq < 6000", "seq >= 6000"):
        kv.flush(log.where(part))
    kv.compact()
    return kv.snapshot()


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted")
def compaction_append(spark, sf_dir):
    """Eight runs, the oldest half merged three times between them: no dropped tombstone brings a deleted key back."""
    from logstrata.sources.table import KVTable

    kv, log = KVTable(spark, _root(spark, "append"), layout="append"), events_log(spark, sf_dir)
    for part in range(8):
        kv.flush(log.where(f"seq % 4 = {part} and seq < 4000" if part < 4 else f"seq >= {1500 * part - 2000} and seq < {1500 * part - 500 if part < 7 else 1 << 62}"))
        if part in (3, 5, 7):
            kv.compact(force=True)
    return kv.snapshot()


@query(f"{EV_LAST} select key, seq, value, deleted from lt where not deleted")
def stream_upsert(spark, sf_dir):
    """The log as a stream of one batch for each file, stored and read back."""
    from logstrata.sources.table import KVTable
    from logstrata.streaming.ingest import upsert_stream

    root = _root(spark, "stream")
    log = events_log(spark, sf_dir)
    log.where("seq < 5000").write.parquet(f"{root}/in/batch=0")
    log.where("seq >= 5000").write.parquet(f"{root}/in/batch=1")
    kv = KVTable(spark, f"{root}/table")
    for batch in (0, 1):
        stream = spark.readStream.schema(log.schema).parquet(f"{root}/in/batch={batch}")
        upsert_stream(stream, kv, f"{root}/checkpoint-{batch}").awaitTermination()
    return kv.snapshot()
