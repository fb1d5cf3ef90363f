"""One thin query per operator, over its whole intended table, and the SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabulary files are; they are read there and never copied.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a full capture and a later 304 for it."""
    from logstrata.llm import warc_revisit as warc

    found = warc.resolve(warc.crawl_records(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_text(found.headers))


OP4_SQL = """
with urls as (
  select page_id, url, html, regexp_replace(url, '#.*$', '', 's') as plain from pages
), parts as (
  select page_id, url, html,
    regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www\\.', '') as host,
    regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(plain, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) as params
  from urls
), full_captures as (
  select page_id, url, md5(html) as digest, octet_length(encode(html)) as n_bytes,
    case when host <> '' then host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end as canonical
  from parts
), revisits as (
  select page_id * 2 + 1 as record_id, url as uri, page_id + 500 as time, canonical, digest, page_id from full_captures
), found as (
  select r.*, (select max(f.page_id) from full_captures f where f.canonical = r.canonical and f.page_id < r.time) as response_page from revisits r
)
select r.record_id, r.uri, r.time, r.canonical, f.page_id * 2 as response_id,
  case when f.page_id is null then 'orphan' when f.digest = r.digest then 'resolved' else 'mismatch' end as status,
  'cache-control: max-age=' || cast(r.page_id % 7 * 60 as varchar)
    || case when f.digest = r.digest then chr(10) || 'content-length: ' || f.n_bytes || chr(10) || 'content-type: text/html; charset=utf-8' else chr(10) || 'content-length: 0' end
    || chr(10) || 'date: ' || r.time || chr(10) || 'etag: W/"' || r.digest || '"'
    || case when f.digest = r.digest then chr(10) || 'x-page: ' || f.page_id else '' end as headers,
  case when f.digest = r.digest then f.digest end as payload_digest
from found r left join full_captures f on f.page_id = r.response_page
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: Of the pseudonyms, where the session doesn't set ``PII_KEY_CONF``; a deployment sets its own secret.
PII_KEY = "an example key, not a secret"
PII_KEY_CONF = "spark.logstrata.pii.key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_CONF, PII_KEY)


def op5_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.pii_feistel import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.sharding import minimax_shards

    return minimax_shards(table(spark, sf_dir, "documents"), 16)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.ngram_join import join_documents

    return join_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.tokenizer_fst import encode_decode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, Path(TOKENIZERS, "piece_bpe_32k.model").read_bytes()).drop("text")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm import quality_gam as gam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    return gam.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.subspace_join import join_vectors

    return join_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_REACH_SQL = """
, reach(a, b) as (
  select id, id from node
  union
  select r.a, l.b from reach r join link l on l.a = r.b
), component as (select a as id, min(b) as component from reach group by a)
"""

OP2_SQL = (
    """
with recursive v as (
  select vec_id as id, list_transform(embedding, lambda x: x::double) as e from embeddings
), unit as (
  select id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), node as (select id from v), link as (
  select a.id as a, b.id as b from unit a join unit b on a.id <> b.id and len(a.e) = len(b.e)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
)"""
    + _REACH_SQL
    + "select id as vec_id, (select count(*) from link where a = id) as n_links, component as component_id, id = component as kept from component"
)

OP9_SQL = (
    r"""
with recursive words as (
  select doc_id as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select id, case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words
), node as (select id from sets), tokens as (select id, len(s) as n, unnest(s) as t from sets), link as (
  select a.id as a, b.id as b from tokens a join tokens b on a.t = b.t and a.id <> b.id
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
)"""
    + _REACH_SQL
    + "select id as doc_id, len(s) as n_shingles, component as component_id from component join sets using (id)"
)

#: Verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logstrata.llm.url_filter import filter_urls, train
    from logstrata.llm.url_labels import ALLOW, BLOCK

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES, train(BLOCK, ALLOW)).select("page_id", "host", "path", "rule", "verdict", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_gam, op2_subspace_join, op3_url_filter, op4_warc_revisits, op5_pii_feistel, op6_decontaminate, op7_host_suffixes, op8_minimax_shards, op9_ngram_join, op10_sentencepiece, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_subspace_join": OP2_SQL, "op4_warc_revisits": OP4_SQL, "op9_ngram_join": OP9_SQL}
