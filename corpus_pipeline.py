"""From documents to packed training sequences: filter, deduplicate, mask, pack.

Odd rows, in every stage: null doc ids and repeated rows are rows like others; very long texts are read
whole; an empty table passes as an empty table; all but the last stage keep every column of their input,
whatever its name, and the last returns its own.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import minhash, packing, quality, secrets
from gridloom.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside its held-out fold.

    Null and empty texts are scored as an empty passage; equal texts fare alike; a score at the threshold
    is accepted; without usable labels all are accepted.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the smallest id.

    A pair at exactly 0.8 is linked. Null, empty and blank texts are no duplicates of anything and stay; of repeated
    rows one stays.
    """
    return minhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret and linked credential part replaced by its kind; null stays null, a text without secrets as it is."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its place in a sequence of at most 2048 tokens; a null or empty text is a piece of its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near_duplicates", deduplicate), ("secrets", mask_secrets), ("packing", pack)]

#: A trained classifier is no SQL; tests hold the pipeline against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
