"""Queries with SQL against DuckDB; those without it run and give one row per row of their table."""

import duckdb
import pytest

from logstrata.llm import registry
from tests.test_oracle import SF, TABLES, rows

WHOLE = {"op1_quality_gam": "documents", "op2_subspace_join": "embeddings", "op3_url_filter": "pages", "op4_warc_revisits": "pages", "op5_pii_feistel": "documents", "op7_host_suffixes": "pages", "op8_minimax_shards": "documents", "op9_ngram_join": "documents", "op10_sentencepiece": "documents"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_one_row_for_each(spark, name):
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{WHOLE[name]}.parquet").count()
