"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at `epochs` times
its source's words and the excess is reshared by weight (a water level over words per weight, found in one window over
the per-source table).

A document's hash puts it in one of CELLS cells of its source; runs of cells make blocks of about `block_words` words.
A source's target is drawn block by block: each whole pass takes every block once, in a new order, and the last pass
ends inside a block at the very word, where documents follow in hash order and one is cut (or, with
whole_documents, rounded). The exact block quotas of all sources are split recursively over the output shards by
multivariate-hypergeometric draws; a source's draws, in their permuted order, fill its shards' quotas, so the shards'
blocks are disjoint. Within a shard, documents are shuffled by hash.

Only (source, cell) sums are shuffled to plan; documents meet the plan on (source, cell), so that a source with a third
of all rows is spread over CELLS keys. Empty texts have size 0 and are taken as 0 words. Repeated rows are documents of
their own; equal hashes go by doc_id, then size. Texts of any length are counted whole, and mix() takes them whole: its
last pass is rounded to documents, which report() cuts at the word, and documents without words are not in the mix. Extra
columns of any name stay in mix() and are not read by report(). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, keep, read_table, word_count

WEIGHTS, EPOCHS, CELLS, BLOCK_WORDS, SHARDS, SEED = (5.0, 2.0, 1.0), 3, 4096, 16_384, 8, 20_240_607


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def cell_of(doc_id: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(CELLS)).cast("int")


def targets(sources: DataFrame, weights: tuple[float, ...], epochs: int) -> DataFrame:
    """One row per source in: key, source_size. Adds target."""
    in_order = Window.orderBy(F.col("key") == "", "key")  # the key of null is empty, and comes last
    rank = F.row_number().over(in_order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * epochs
    all_rows = Window.partitionBy().orderBy("ratio", "key")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(all_rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(all_rows.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("cap", F.col("weight") * F.coalesce("level", F.col("ratio"))))
        .select("key", "source_size", "target")
    )


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of blocks by source -> shards x sources: halves of the shard range get exact shares of all blocks, whose sources are drawn without replacement."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def descend(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = total * (mid - lo) // (hi - lo)
        part = rng.multivariate_hypergeometric(have, left, method="marginals") if total else have
        descend(lo, mid, part)
        descend(mid, hi, have - part)

    descend(0, shards, quotas.astype(np.int64))
    return out


def draws(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Blocks (key, block, words, source_size, target) -> a row per draw: its words, whether it is cut, its shard."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.round("target") / size)).otherwise(0).cast("int")
    passes = blocks.withColumn("whole", whole).withColumn("rest", (F.round("target") - F.col("whole") * size).cast("long")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    order = Window.partitionBy("key", "pass").orderBy(F.xxhash64(F.lit(seed), "key", "pass", "block"), "block")
    left = F.col("rest") - F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = (
        passes.withColumn("rank", F.row_number().over(order))
        .withColumn("take", F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.least("words", F.greatest(left, F.lit(0)))))
        .filter("take > 0")
        .withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("pass", "rank")) - 1)
        .select("key", "block", "words", "take", "nth")
    )
    quotas = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("quota"))

    def tree(frames):
        frame = pd.concat(list(frames), ignore_index=True)
        if len(frame):
            frame = frame.sort_values("key", ignore_index=True)
            parts = split_tree(frame["quota"].to_numpy(), shards, np.random.default_rng(seed))
            yield pd.DataFrame({"key": frame["key"], "ends": list(np.cumsum(parts, axis=0).T)})

    leaves = quotas.coalesce(1).mapInPandas(tree, "key string, ends array<bigint>")  # a row per source
    return drawn.join(leaves, "key").withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("nth")))).drop("ends")


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sized: key, cell, size. The plan has a row per (key, cell): source_size, target, block, times, cut, shards."""
    cells = keep(sized.groupBy("key", "cell").agg(F.sum("size").alias("words")), "cells")
    sources = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")), weights, epochs)
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(CELLS), F.ceil(F.col("source_size") / block_words)))
    cells = keep(cells.join(sources, "key").withColumn("block", F.floor(F.col("cell") * n_blocks / CELLS).cast("int")), "blocks")
    blocks = cells.groupBy("key", "block", "source_size", "target").agg(F.sum("words").alias("words"))
    taken = draws(blocks, shards, seed).groupBy("key", "block").agg(
        F.count_if(F.col("take") == F.col("words")).alias("times"),
        F.max(F.when(F.col("take") < F.col("words"), F.col("take"))).alias("cut"),
        F.sort_array(F.collect_list("shard")).alias("shards"),
    )
    full = cells.join(taken, ["key", "block"], "left")
    return keep(full.select("key", "cell", "source_size", "target", "block", F.coalesce("times", F.lit(0)).alias("times"), "cut", F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "plan")


def with_taken(rows: DataFrame, planned: DataFrame, seed: int = SEED, whole_documents: bool = False) -> DataFrame:
    """rows (key, cell, size, doc_id and others) with the plan's columns and taken, their words in the mix."""
    side = F.broadcast(planned) if planned.count() * 128 <= BROADCAST_BYTES else planned
    met = rows.join(side, ["key", "cell"])
    sure = met.filter("cut IS NULL").withColumn("taken", F.col("times") * F.col("size"))
    # One block a source is cut, at a place in the order of the documents' hash: sums of its 4096 ranges first, so that a
    # window ranks the rows of a range and not the block.
    cut = met.filter("cut IS NOT NULL").withColumn("_ls_hash", F.xxhash64(F.lit(seed + 1), "doc_id")).withColumn("_ls_range", F.shiftright("_ls_hash", 52))
    by_range = Window.partitionBy("key").orderBy("_ls_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("key", "_ls_range").agg(F.sum("size").alias("_ls_words")).select("key", "_ls_range", F.coalesce(F.sum("_ls_words").over(by_range), F.lit(0)).alias("_ls_before"))
    order = Window.partitionBy("key", "_ls_range").orderBy("_ls_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("cut") - F.col("_ls_before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.col("size"), F.greatest(left, F.lit(0)))
    if whole_documents:
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    parted = cut.join(ranges, ["key", "_ls_range"]).withColumn("taken", F.col("times") * F.col("size") + part)
    return sure.unionByName(parted.select(*sure.columns))


def report(docs: DataFrame, **options) -> DataFrame:
    seed = options.get("seed", SEED)
    sized = keep(docs.select("doc_id", source_key(F.col("source")).alias("key"), cell_of(F.col("doc_id"), seed).alias("cell"), word_count(F.col("text")).alias("size")), "sized")
    return with_taken(sized, plan(sized, **options), seed).select("doc_id", "size", "source_size", "target", "taken", "shards")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each as often as the mix takes it, whole, in shuffled shards, with their own columns."""
    seed, shards = options.get("seed", SEED), options.get("shards", SHARDS)
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("doc_id"), source_key(F.col("source")).alias("key"), cell_of(F.col("doc_id"), seed).alias("cell"), word_count(F.col("text")).alias("size"))
    planned = plan(keyed.select("key", "cell", "size"), **options)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    spread = 16  # a shard is written by so many tasks
    return (
        with_taken(keyed, planned, seed, whole_documents=True)
        .withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), copies), lambda i: i < copies)))
        .withColumn("shard", F.coalesce(F.try_element_at("shards", F.col("copy") + 1), F.lit(0)))
        .withColumn("order", F.xxhash64(F.lit(seed + 2), "doc_id", "copy"))
        .repartition(shards * spread, "shard", F.pmod("order", F.lit(spread)))
        .sortWithinPartitions("shard", "order")
        .select("doc.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = None  # the draws are hashed; tested against brute force
