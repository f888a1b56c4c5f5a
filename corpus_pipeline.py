"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Rows that a stage keeps go on with all columns of ``documents``; the last stage returns token digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from authloom.llm import bpe, exact_dedup, minhash, mixing, quality
from authloom.llm.queries import SEED, tokenizer_path
from authloom.llm.store import Store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, predicts good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more of five-word shingles)."""
    return minhash.drop_near_copies(docs, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) so that sources get shares by the square root of their volume."""
    return mixing.mix(docs, alpha=0.5, seed=SEED).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts as digests."""
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources", source_mix),
    ("BPE encoding and decoding", tokens),
]

# a trained classifier and hashed signatures have no SQL form; tests/llm compares the stages with
# plain programs instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            store.drop(f"stage-{k - 1}")  # written anew, and read by nothing else
    return docs
