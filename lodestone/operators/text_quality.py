"""Gibberish ratios, validity and confidence of texts against a vocabulary table.

The vocabulary is a table of words; documents are exploded to their distinct clean tokens and joined to it, so nothing
of it is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_text, clean_tokens, fold_spanish

# As few clean words are always valid; the share of digital text that makes a page reliable; thresholds.
FEW_WORDS, DIGITAL_SHARE, CONFIDENCE_THRESHOLD, VALIDITY_THRESHOLD = 10, 0.7, 0.25, 0.7


def vocabulary_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """word: the distinct clean tokens of a table."""
    return texts.select(F.explode(clean_tokens(F.col(column))).alias("word")).distinct()


def split_vocabulary(docs: DataFrame, vocabulary: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text and columns that it determines. Those but text, word, n (occurrences), known; documents without
    words have one row, of a null word. A word unknown to the vocabulary may be known to the fallback (English)."""
    keys = [c for c in docs.columns if c != "text"]
    words = docs.select(*keys, F.explode_outer(clean_tokens(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("word").alias("n"))
    out = words.join(vocabulary.select("word", F.lit(True).alias("_in")), "word", "left")
    if fallback is not None:
        out = out.join(fallback.select("word", F.lit(True).alias("_also")), "word", "left").withColumn("_in", F.coalesce("_in", "_also"))
    return out.select(*keys, "word", "n", F.coalesce("_in", F.lit(False)).alias("known"))


def ratio(unknown: Column, known: Column) -> Column:
    """unknown / known: infinite without known ones, 0 without any."""
    return F.when(unknown + known == 0, 0.0).when(known == 0, float("inf")).otherwise(unknown / F.nullif(known, F.lit(0)))


def gibberish_ratios(docs: DataFrame, vocabulary: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """doc_id (and other columns of docs but text), n_tokens, set_ratio (of distinct words), token_ratio (of occurrences),
    for every document."""
    keys = [c for c in docs.columns if c != "text"]
    new = F.col("word").isNotNull() & ~F.col("known")
    by_doc = split_vocabulary(docs, vocabulary, fallback).groupBy(*keys).agg(
        F.sum("n").alias("n_tokens"), F.count_if("known").alias("ks"), F.count_if(new).alias("us"),
        F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("kt"), F.sum(F.when(new, F.col("n")).otherwise(0)).alias("ut"),
    )
    return by_doc.select(*keys, "n_tokens", ratio(F.col("us"), F.col("ks")).alias("set_ratio"), ratio(F.col("ut"), F.col("kt")).alias("token_ratio"))


def validity(docs: DataFrame, vocabulary: DataFrame, threshold: float = VALIDITY_THRESHOLD, fallback: DataFrame | None = None) -> DataFrame:
    """doc_id, valid: blank texts are not, few words always are, others by the lesser ratio."""
    rows = docs.select("doc_id", "text", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    ratios = gibberish_ratios(rows, vocabulary, fallback)
    return ratios.select("doc_id", F.when(F.col("blank"), False).when(F.col("n_tokens") <= FEW_WORDS, True).otherwise(F.least("set_ratio", "token_ratio") < threshold).alias("valid"))


def confidence(docs: DataFrame, vocabulary: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, fallback: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, digital, ocr, lang. doc_id, confidence: low without clean words, high if most of them are digital
    text, otherwise by the gibberish of the recognised text (Spanish folded first)."""
    read = F.when(F.col("lang") == "es", fold_spanish(clean_text(F.col("ocr")))).otherwise(F.col("ocr"))
    counted = docs.select("doc_id", F.size(clean_tokens(F.col("digital"))).alias("d"), F.size(clean_tokens(F.col("ocr"))).alias("o"), read.alias("text"))
    ratios = gibberish_ratios(counted, vocabulary, fallback)
    both = F.col("d") + F.col("o")
    level = F.when(both == 0, "low").when(F.col("d") / F.greatest(both, F.lit(1)) > DIGITAL_SHARE, "high").when(F.least("set_ratio", "token_ratio") > threshold, "low").otherwise("medium")
    return ratios.select("doc_id", level.alias("confidence"))
