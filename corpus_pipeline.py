"""The corpus pipeline: stages over documents, each on all that the one before kept.

quality rules -> SimHash near-dedup -> PII surrogates -> mixing to target weights -> BPE encoding and decoding
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, pii, quality, simhash
from tidemark.llm.common import as_parquet

#: Parameters of the stages.
SHINGLE, SIMILARITY = 5, 0.8
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the line-first rules go, and so do documents that fail them; other texts stay as they are."""
    return quality.clean(docs, drop_lines=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest doc_id. Shingles have five words, similarity is 0.8."""
    return simhash.dedup_similar(docs, SIMILARITY, SHINGLE)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts give way to keyed surrogates, which are audited for collisions first."""
    return pii.pseudonymise(docs, pii.audited_key(docs, pii.session_key(spark))).drop("entities")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the mix of sources takes them, whole, in training order."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document of the mix."""
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", near_dedup), ("pii_surrogates", pii_surrogates), ("mix_sources", mix_sources), ("bpe_tokens", tokens)]

#: Encoding, surrogates and groups of links are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet in the shared folder and read from there by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = as_parquet(docs)
    return docs
