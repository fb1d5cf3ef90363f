"""From raw documents to token ids: five stages, each one operator of logstrata.llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps; its
result is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import decontaminate, ngram_join, pii_feistel, quality_gam, tokenizer_fst
from logstrata.llm.registry import TOKENIZERS, pii_key, table
from logstrata.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return ngram_join.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows a text that changed."""
    changed = pii_feistel.pseudonymise(docs, pii_key(spark), count="__changed")
    n_chars = F.when(F.col("__changed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their token ids."""
    return tokenizer_fst.encode_decode(docs, Path(TOKENIZERS, "piece_bpe_32k.model").read_bytes())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: SQL can't express the trained model or the edit matching; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            if at:
                scratch.drop(STAGES[at - 1][0])
    return docs
