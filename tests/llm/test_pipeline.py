"""The stages on a small corpus, each held against what it should have kept."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from logstrata.llm import registry
from logstrata.llm.registry import TOKENIZERS
from tests.llm.test_ngram_join import brute

pytestmark = pytest.mark.skipif(not Path(TOKENIZERS, "piece_bpe_32k.model").exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("corpus")
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    docs = [prose(rng.randrange(20, 120)) for _ in range(120)]
    docs += ["!! ".join(rng.choices(words, k=40)).upper() for _ in range(40)]  # junk
    docs += [d + " " + words[i] for i, d in enumerate(docs[:20])] + docs[:5]  # near and exact copies
    items = [prose(30) for _ in range(3)]
    docs += [prose(25) + " " + i + " " + prose(25) for i in items]
    docs += [prose(30) + " card 4539578763621486 and 192.0.2.7 " + prose(30)]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows


def test_stages(spark, corpus):
    root, rows = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    texts = {i: t for i, t, *_ in rows}
    quality, distinct, clean, private, tokens = kept
    assert set(quality) == {i for i in texts if not 120 <= i < 160}
    assert set(distinct) == {k for k, _, c in brute(list(quality.items())) if k == c}
    assert set(clean) == set(distinct) - {185, 186, 187}
    assert {i for i in clean if private[i] != clean[i]} == {188}
    assert "4539578763621486" not in private[188]
    assert set(tokens) == set(private) == set(clean)
    assert all(r.round_trip for r in docs.collect())


def test_run_equals_the_stages(spark, corpus):
    root, _ = corpus
    found = registry.queries()["pipeline"](spark, root)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_ids", "round_trip"]
    assert 100 < found.count() < 130
