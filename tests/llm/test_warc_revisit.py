import random

from pyspark.sql import functions as F

from logstrata.llm import warc_revisit as warc

SCHEMA = "record_id long, kind string, uri string, time long, headers map<string,string>, payload_digest string"


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2", "https://me@EXAMPLE.com:443/a/?a=1&b=2&gclid=9"]
    others = ["https://example.com/A?a=1&b=2", "https://example.com/a", "https://example.com:8080/a?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in [*same, *others, None, "no url", "http:///x"]], "u string")
    got = [r[0] for r in df.select(warc.canonical_url(F.col("u"))).collect()]
    assert got[:3] == ["example.com/a?a=1&b=2"] * 3
    assert len(set(got[2:6])) == 4
    assert got[6:] == [None] * 3


def test_merge(spark):
    records = [
        (1, "response", "http://a/x", 10, {"ETag": '"v1"', "Content-Type": "text/html", "Expires": "1", "X-Old": "kept"}, "d1"),
        (2, "revisit", "https://a/x/", 20, {"etag": 'W/"v1"', "EXPIRES": "2", "content-length": "0", "Content-Type": "no"}, None),
        (3, "response", "http://a/x", 30, {"ETag": '"v2"'}, "d2"),
        (4, "revisit", "http://a/x", 40, {"ETag": '"v1"'}, None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(records, SCHEMA)).collect()}
    assert got[2].status == "resolved"
    assert got[2].headers == {"etag": 'W/"v1"', "content-type": "text/html", "expires": "2", "x-old": "kept"}
    assert (got[2].response_id, got[2].payload_digest) == (1, "d1")
    assert (got[4].status, got[4].response_id, got[4].payload_digest) == ("mismatch", 3, None)
    responses = spark.createDataFrame(records, SCHEMA).withColumn("body", F.concat(F.lit("body of "), F.col("record_id")))
    bodies = {r.record_id: r.body for r in warc.with_payload(warc.resolve(spark.createDataFrame(records, SCHEMA)), responses, "body").collect()}
    assert bodies == {2: "body of 1", 4: None}


def test_odd_records(spark):
    records = [
        (1, "response", "http://a/", 5, None, "d"), (2, "revisit", "http://a/", 5, None, "d"), (3, "revisit", "http://a/", 6, None, "d"), (4, "revisit", None, 6, None, "d"), (5, "revisit", "http://a/", None, {"A": "1", "a": "2"}, None),
        (6, "request", "http://a/", 7, None, None), (7, "response", "http://a/", 5, {}, "e"), (8, "revisit", "http://a/", 9, {"last-modified": "x"}, None), (3, "revisit", "http://a/", 6, None, "d"), (9, None, "http://a/", 1, None, None), (10, "response", None, 1, None, None),
    ]
    df = spark.createDataFrame(records, SCHEMA).withColumn("status", F.lit("clash"))
    got = sorted((r.record_id, r.status, r.response_id) for r in warc.resolve(df).collect())
    # Of the two responses at 5 the larger id counts; a response at the same time isn't earlier.
    assert got == [(2, "orphan", None), (3, "mismatch", 7), (3, "mismatch", 7), (4, "orphan", None), (5, "orphan", None), (8, "mismatch", 7)]
    assert warc.resolve(df.limit(0)).count() == 0


def test_as_of_equals_brute_force(spark):
    rng = random.Random(5)
    records = [(i, rng.choice(["response", "revisit"]), f"http://h/{'hot' if rng.random() < 0.5 else rng.randrange(9)}", rng.randrange(200), {"etag": str(rng.randrange(3))}, None) for i in range(600)]
    got = sorted((r.record_id, r.response_id, r.status) for r in warc.resolve(spark.createDataFrame(records, SCHEMA)).collect())
    want = []
    for i, kind, uri, time, headers, _ in records:
        if kind == "revisit":
            before = max(((t, j, h) for j, k, u, t, h, _ in records if k == "response" and u == uri and t < time), key=lambda x: x[:2], default=None)
            want.append((i, before and before[1], "orphan" if before is None else "resolved" if before[2] == headers else "mismatch"))
    assert got == sorted(want)

