"""Corpus pipeline: language ID, exact and near deduplication, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it back from Parquet.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.byte_bpe import encode_and_decode, load_ranks
from causeway.llm.common import written
from causeway.llm.exact_dedup import exact_dedup
from causeway.llm.language_id import UNDETERMINED, held_out, identify, train
from causeway.llm.mixing import mix
from causeway.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of the odds no language is accepted.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; it is fitted on a bounded sample of the labelled ones."""
    found = identify(docs, train(docs.where(~held_out())))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the largest id, of each group of equal texts."""
    return exact_dedup(docs).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of near duplicates."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and forms of text come near their target weights."""
    return mix(docs).where("kept").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document that is left."""
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = encode_and_decode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]
#: Language ID, near duplicates and BPE have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
