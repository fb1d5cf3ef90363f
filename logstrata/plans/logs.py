"""The driver tables as op logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.functions.model import op_log
from logstrata.functions.scalars import user_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, *, user: int | None = None) -> DataFrame:
    """A user's events: the last one is its state, an error deletes it.

    Keys are made from numbers here, so a filter on the key can't reach the Parquet scan; ``user``
    filters the number itself. A log that is stored with its keys needs no such help.
    """
    events = table(spark, sf_dir, "events")
    if user is not None:
        events = events.where(F.col("user_id") == user)
    return op_log(events, key=user_key(F.col("user_id")), seq=F.col("event_id"), value=F.col("props"), deleted=F.col("event_type") == "error")


def customer_key(number: Column) -> Column:
    return F.format_string("cust:%08d", number)


def orders_log(spark: SparkSession, sf_dir: str, *, low: int | None = None, high: int | None = None) -> DataFrame:
    """A customer's orders: the last one is its state, a finished one deletes it. ``low`` and ``high``
    bound the customers, both inclusive, in the scan."""
    orders = table(spark, sf_dir, "orders")
    if low is not None:
        orders = orders.where(F.col("o_custkey") >= low)
    if high is not None:
        orders = orders.where(F.col("o_custkey") <= high)
    return op_log(orders, key=customer_key(F.col("o_custkey")), seq=F.col("o_orderkey"), value=F.concat_ws("/", "o_orderstatus", "o_orderpriority"), deleted=F.col("o_orderstatus") == "F")


EVENTS_SQL = "ev as (select printf('user:%010d', user_id) as key, event_id as seq, case when event_type <> 'error' then props end as value, event_type = 'error' as deleted from events)"
ORDERS_SQL = "od as (select printf('cust:%08d', o_custkey) as key, o_orderkey as seq, case when o_orderstatus <> 'F' then o_orderstatus || '/' || o_orderpriority end as value, o_orderstatus = 'F' as deleted from orders)"


def last_sql(log: str, name: str, where: str = "true") -> str:
    """A common table expression: last rows of a log."""
    return f"{name} as (select key, seq, value, deleted from (select *, row_number() over (partition by key order by seq desc) as rn from {log} where {where}) where rn = 1)"
