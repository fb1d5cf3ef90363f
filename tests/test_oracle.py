"""Every query with SQL against DuckDB over the small driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LLM = {n for n in entry.queries() if n == "pipeline" or n[:2] == "op" and n[2].isdigit()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, str):
        return v
    if type(v).__name__.startswith("bool"):
        return bool(v)
    try:
        f = float(v)
        return int(v) if f == int(f) else f
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query_equals_sql(spark, duck, name):
    got = rows(entry.queries()[name](spark, SF).toPandas())
    want = rows(duck.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - LLM))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
