import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logstrata.llm import quality_gam as gam

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    assert gam.features(None) == gam.features("") == [0.0] * len(gam.FEATURES)
    for text in ("x", "\n\n", " " * 50, "é" * 10, "word " * 200_000, "\x00"):
        found = gam.features(text)
        assert len(found) == len(gam.FEATURES)
        assert all(map(math.isfinite, found))


def test_learns_a_curve_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((np.abs(x[:, 0] - 0.5) < 0.2) ^ ((x[:, 1] > 0.5) & (x[:, 2] > 0.5))).astype(float)
    model = gam.train(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert (1, 2) in model.pairs


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_labels_of_one_kind(y):
    model = gam.train(np.zeros((len(y), len(gam.FEATURES))), np.array(y))
    scores = model.score(np.zeros((3, len(gam.FEATURES))))
    assert ((scores > 0) & (scores < 1)).all()


def docs_and_labels(spark):
    rows = [(i, f"good words here number {i} and more of them." if i % 2 else "BAD!! " * 20) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "no id"), (500, None), (501, ""), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(200)], (None, 1, 0), (3, None, 0), (501, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_scores_every_row(spark):
    docs, labels = docs_and_labels(spark)
    docs = docs.withColumn("score", F.lit("clash")).withColumn("lang", F.lit("en"))
    found = gam.score(docs, gam.fit(docs, labels)).collect()
    assert len(found) == 204
    assert "lang" in found[0].asDict()
    for r in found:
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 200:
            assert r.predicted == r.doc_id % 2


def test_empty_tables(spark):
    docs, labels = docs_and_labels(spark)
    assert gam.score(docs.limit(0), gam.fit(docs, labels)).count() == 0
    assert {round(r.score, 6) for r in gam.score(docs, gam.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_sample_is_bounded_and_never_held_out(spark, monkeypatch):
    docs, labels = docs_and_labels(spark)
    seen = []
    monkeypatch.setattr(gam, "train", lambda x, y, **_: seen.append(len(y)))
    gam.fit(docs, labels, max_rows=50)
    gam.fit(docs, labels)
    kept = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert seen[0] <= 50
    assert seen[1] == len(kept) + (zlib.crc32(b"501") % 5 != 0)  # one id is there twice and counts once
    seen.clear()
    hot = docs.limit(1).crossJoin(spark.range(500)).select(F.lit("1").alias("doc_id"), F.concat("text", F.col("id").cast("string")).alias("text"))
    gam.fit(hot, spark.createDataFrame([("1", 1, 0), ("1", 0, 0), ("x", 1, 0)], "doc_id string, quality int, toxic int"), max_rows=2)
    assert seen == [1]  # an id of text that 500 rows have


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = gam.score(docs.select("doc_id", "text"), gam.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.9


def test_scores_are_sums_of_tables(spark):
    """The score of a text, added up by hand from the tables of the model."""
    docs, labels = docs_and_labels(spark)
    model = gam.fit(docs, labels)
    for r in gam.score(docs, model).collect():
        x = gam.features(r.text)
        total = model.intercept
        for value, edges, table in zip(x, model.edges, model.tables, strict=True):
            total += table[sum(value >= e for e in edges)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(x[a] >= e for e in model.pair_edges[a]), sum(x[b] >= e for e in model.pair_edges[b])]
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
