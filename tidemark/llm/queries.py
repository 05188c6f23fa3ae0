"""The registered query of each training-data operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, embeddings, licenses, mixing, negatives, oracles, packing, pages, phrases, pii, quality, simhash, substrings, toxicity
from tidemark.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order: the rows are range-sorted by the position of a document's first pass."""
    return mixing.documents_in_order(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "position", "passes")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.inherit(licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with surrogates, and entities: type, place, keyed digest of the original, surrogate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.audited(docs, pii.session_key(spark))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_embeddings": op2_embeddings,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_pages": op6_pages,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_substrings": op9_substrings,
    "op10_toxicity": op10_toxicity,
    "op11_negatives": op11_negatives,
    "op12_phrases": op12_phrases,
    "op13_packing": op13_packing,
}
ORACLES = oracles.ORACLES
