"""Corpus pipeline: filter, deduplicate, mix and tokenize ``documents``.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last one returns token ids.  Every stage takes the defined
results for nulls, empty and long texts, ties and empty tables from its operator.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphssl.llm.bloom_dedup import drop_exact_duplicates  # noqa: E402
from graphssl.llm.bpe import encode  # noqa: E402
from graphssl.llm.common import table  # noqa: E402
from graphssl.llm.dart_minhash import drop_near_duplicates  # noqa: E402
from graphssl.llm.mixing import mixed_documents  # noqa: E402
from graphssl.llm.toxicity import drop_toxic  # noqa: E402
from graphssl.session import ship_package, write_table  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``."""
    ship_package(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    ship_package(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a class of near-duplicates the smallest doc_id stays."""
    ship_package(spark)
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per draw of a document."""
    ship_package(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row."""
    ship_package(spark)
    return (encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("tokens", tokens)]

#: A trained classifier, similarity classes and a subword model: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
