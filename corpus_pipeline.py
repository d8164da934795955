"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colscope.llm import bpe, mixing, quality, simhash, substring_dedup
from colscope.llm.common import delete, scratch, shared_dir
from colscope.llm.queries import tokenizer_path


#: Words in a shingle of near-dedup, and the similarity of documents of which one stays.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host breaks a rule, go. Null and empty texts have too few words; null
    sources are one host; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a similarity of 0.8 or more, as fingerprints of 128 bits tell
    it, and of those linked through others, the one with the smallest id stays: null ids come last, ties are broken by
    the whole row, and of equal rows one stays. Texts that are null or have no words are alike. An empty table stays
    empty."""
    return simhash.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller id has go; a document that loses all stays, with an empty text.
    Null ids come last; rows with one id, also repeated ones, take nothing from each other; null texts stay null. An
    empty table stays empty."""
    return substring_dedup.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice; every document, also a repeated, null or empty one, is there once at
    least. Null sources are one; ties of the order stay together. An empty table stays empty."""
    return mixing.mixed_rows(docs, max_repeats=2.0)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each row, and digests of its ids and of what they decode to; null texts are empty,
    repeated rows and null ids stay, an empty table gives no rows."""
    return bpe.token_digests(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can't express the SimHash stage; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again; only the last one's table stays, and none if
    a stage fails."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
        try:
            with scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
        except BaseException:
            delete(spark, path)
            raise
        finally:
            if before:
                delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
