"""Resolution of not-modified revisits in web archives.

A revisit record says that a URL was fetched again and the server answered 304.
It is joined as of its time to the latest strictly earlier full response of the
same canonical URL. The pair holds if their validators agree: entity tags
(compared weakly), else Last-Modified, else payload digests. A pair that holds
gives the response with the headers that a 304 may update (RFC 9111, 3.2).

The as-of join doesn't gather all records of a URL: time is cut at global
quantiles, a window runs inside (URL, time block), and the last response of
each block is carried to later blocks by a second window over block summaries,
of which a URL has as many as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logstrata.llm.scratch import Scratch, partitions

#: Fields that describe the stored body or one connection: a 304 doesn't update them.
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "warc-payload-digest")
#: Query parameters that don't name another resource.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without its last slash, sorted query without tracking
    parameters; no scheme, user or fragment. Null for a null URL or one without ``://`` and a host."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_extract(plain, r"(?s)^[^?]*\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """Field names in lower case; of names that differ in case only, the last holds. Null is no header."""
    entries = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored fields, with those of the 304 that it may update. Both have lower-case names."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: its columns, canonical, response_id, status, headers, payload_digest.

    ``records``: record_id long, kind (``response`` or ``revisit``; others are ignored), uri, time
    long, headers map<string,string>, payload_digest string; further columns are ignored. Status is
    ``resolved``, ``mismatch`` (validators differ or none can be compared; response_id says with
    which response, headers are the revisit's own) or ``orphan`` (no earlier response; also for a
    null uri or time). Of responses at one time the largest record_id counts. Repeated revisits
    give repeated rows.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "warc")
    narrow = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "uri", F.col("time").cast("long").alias("time"), lower_names(F.col("headers")).alias("headers"), "payload_digest", canonical_url(F.col("uri")).alias("canonical")
    )
    narrow = scratch.table(narrow, "records")
    usable = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    placed, rest = narrow.where(usable), narrow.where(~usable & (F.col("kind") == "revisit"))
    n = partitions(spark)
    cuts = sorted(set(placed.approxQuantile("time", [i / n for i in range(1, n)], 0.002))) if n > 1 else []
    block = F.aggregate(F.array(*[F.lit(int(c)) for c in cuts]), F.lit(0), lambda s, c: s + (F.col("time") >= c).cast("int")) if cuts else F.lit(0)
    # Without the map, which has no order; time and id come first and decide.
    found = F.when(F.col("kind") == "response", F.struct("time", "record_id", F.map_entries("headers").alias("headers"), "payload_digest"))
    placed = placed.withColumn("block", block).withColumn("found", found)
    earlier = Window.partitionBy("canonical", "block").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("near", F.max("found").over(earlier)).where(F.col("kind") == "revisit")
    summary = placed.groupBy("canonical", "block").agg(F.max("found").alias("last"))
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("canonical", "block", F.max("last").over(before).alias("far"))
    joined = inside.join(carried, ["canonical", "block"]).withColumn("response", F.coalesce("near", "far"))
    joined = joined.select("record_id", "uri", "time", "headers", "payload_digest", "canonical", "response")
    alone = rest.select("record_id", "uri", "time", "headers", "payload_digest", "canonical", F.lit(None).cast(joined.schema["response"].dataType).alias("response"))
    whole = joined.unionByName(alone).withColumn("stored", F.map_from_entries("response.headers"))
    checks = [(_weak(F.col(side)["etag"]), F.col(side)["last-modified"]) for side in ("headers", "stored")]
    (tag, modified), (their_tag, their_modified) = checks
    same = F.when(tag.isNotNull() & their_tag.isNotNull(), tag == their_tag).when(modified.isNotNull() & their_modified.isNotNull(), modified == their_modified)
    same = same.when(F.col("payload_digest").isNotNull() & F.col("response.payload_digest").isNotNull(), F.col("payload_digest") == F.col("response.payload_digest")).otherwise(False)
    status = F.when(F.col("response").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    whole = whole.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return whole.select(
        "record_id", "uri", "time", "canonical", F.col("response.record_id").alias("response_id"), "status",
        F.when(resolved, merge_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("response.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def with_payload(resolved: DataFrame, responses: DataFrame, payload: str) -> DataFrame:
    """Adds the payload of the response to each resolved revisit; null for others."""
    bodies = responses.where(F.col("kind") == "response").select(F.col("record_id").alias("_id"), payload)
    on = (F.col("response_id") == F.col("_id")) & (F.col("status") == "resolved")
    return resolved.join(bodies, on, "left").drop("_id")


def header_text(headers: Column) -> Column:
    """``name: value`` lines in the order of the names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def crawl_records(pages: DataFrame, *, again: int = 500) -> DataFrame:
    """Records of a crawl that fetched each page at its id, in full, and ``again`` later asked whether that
    version still holds, and was told 304. A page of the same canonical URL in between has replaced the version."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"'))
    page = F.col("page_id")
    full = F.create_map(
        F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("X-Page"), page.cast("string")
    )
    short = F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 7 * 60).cast("string")), F.lit("Date"), (page + again).cast("string"))
    first = pages.select((page * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), page.alias("time"), full.alias("headers"), F.md5("html").alias("payload_digest"))
    second = pages.select((page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("uri"), (page + again).alias("time"), short.alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return first.unionByName(second)
