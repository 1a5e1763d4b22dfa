"""A training corpus from `documents`: rejected quality goes, copies and near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of its
input, whatever else they are named. A null text counts as empty in every stage: such documents are judged by length
alone, are copies of each other, have no near copies, no words to mix and so leave the corpus at the mix. Texts of any
length are read whole. Rows that repeat are copies: one of equal doc_id and text may stay for each row of that doc_id,
which the exact stage keeps together. An empty table gives an empty result, no labels keep every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, near_dedup, quality, subword
from .common import read_table, scratch, work_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least as likely as not of the highest grade stay."""
    return quality.select(docs, read_table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles, the document with the least doc_id stays."""
    return near_dedup.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in shuffled shards."""
    return mixing.mix(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, each decoded again; `exact` tells whether that gave the text."""
    return subword.encode(docs, check=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The first stage is a trained classifier and the later ones hash: SQL has neither. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is written to the shared folder and read again, and its work
    tables are removed then."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"stage{i}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
