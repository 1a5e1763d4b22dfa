"""Nearest neighbours of a stated set of queries among all rows, block by block.

The queries go to every task as one array, after a check of their size; each task keeps its k best per query, so only
queries * k rows of a task are shuffled. Beyond QUERY_BYTES, measured, queries are taken in slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries that go to each task at once.
QUERY_BYTES = 64 << 20


def best_of_block(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int):
    """Per query: places and exact distances of its k nearest rows, ties by id.

    The product form of all distances picks the finalists, with room for its rounding, so that no tie is lost."""
    square, lengths = (q**2).sum(axis=1), (x**2).sum(axis=1)
    room = 1e-9 * (1 + square.max(initial=0) + lengths.max(initial=0))
    for start in range(0, len(ids), 512):
        s = slice(start, start + 512)
        d = square[s, None] + lengths[None, :] - 2 * q[s] @ x.T
        d[ids[s, None] == own[None, :]] = np.inf
        least = np.partition(d, min(k, len(own)) - 1, axis=1)[:, min(k, len(own)) - 1]
        for i, row in enumerate(d):
            near = np.flatnonzero((row <= least[i] + room) & np.isfinite(row))
            exact = np.sqrt(((x[near] - q[start + i]) ** 2).sum(axis=1))
            best = np.lexsort((own[near], exact))[:k]
            yield start + i, near[best], exact[best]


def nearest(queries: DataFrame, rows: DataFrame, k: int = 2, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, position (from 1), neighbor_id, distance (Euclidean); a row is no neighbour of itself. Ties go by id."""
    spark, schema = rows.sparkSession, "query_id long, neighbor_id long, distance double"
    size = (queries.agg(F.sum(F.size(column))).first()[0] or 0) * 8
    n = max(1, -(-size // QUERY_BYTES))
    found = None
    for i in range(n):  # one, unless the queries themselves are large
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)
        asked = part.select(key, column).toPandas()
        if not len(asked):
            continue
        held = spark.sparkContext.broadcast((asked[key].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in asked[column]])))

        def search(frames, held=held):
            ids, q = held.value
            best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
            for frame in frames:
                if not len(frame):
                    continue
                own, x = frame[key].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in frame[column]])
                for at, places, distances in best_of_block(ids, q, own, x, k):
                    d, who = np.concatenate([best[at][0], distances]), np.concatenate([best[at][1], own[places]])
                    first = np.lexsort((who, d))[:k]
                    best[at] = d[first], who[first]
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(d) for d, _ in best]), "neighbor_id": np.concatenate([w for _, w in best]), "distance": np.concatenate([d for d, _ in best])})

        made = rows.select(key, column).mapInPandas(search, schema)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("position", place).filter(F.col("position") <= k).select("query_id", "position", "neighbor_id", "distance")


def ratio_matches(queries: DataFrame, rows: DataFrame, ratio: float = 0.7) -> DataFrame:
    """query_id, neighbor_id, first, second, matches: whether the nearest is clearly nearer than the next."""
    two = nearest(queries, rows, 2)
    g = two.groupBy("query_id").agg(F.max(F.when(F.col("position") == 1, F.col("neighbor_id"))).alias("neighbor_id"), F.max(F.when(F.col("position") == 1, F.col("distance"))).alias("first"), F.max(F.when(F.col("position") == 2, F.col("distance"))).alias("second"))
    return g.withColumn("matches", F.coalesce(F.col("first") < ratio * F.col("second"), F.lit(False)))
