"""A training corpus from ``documents``, stage by stage; each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import bpe, gam, mixing, simhash
from tarmac.llm.common import fold, table, text_or_empty
from tarmac.session import cut_lineage, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = gam.train(docs, labels)
    kept = docs.where(gam.score_column(text_or_empty("text"), model) >= gam.THRESHOLD)
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id.

    Groups are those of op3: fingerprints of four-word shingles, linked at four differing bits or fewer.
    """
    small_batches(spark)
    return simhash.keep_one(docs, radius=4, words_per_shingle=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares that the source weights give them, repeated up to three times."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_and_decode(docs, path, pattern)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
