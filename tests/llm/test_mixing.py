import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("taken", T.IntegerType())])


def fill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            return got | {s: weight[s] * level for s in open_}
        for s in over:
            got[s] = epochs * sizes[s]
            left -= got[s]
        open_ -= over
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    names = ["a", "b", "Z", "é", "", None, "\U0001f600", "￮"]
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), names[0] if i % 3 == 0 else names[int(rng.integers(0, 8))], "x", i) for i in range(1500)]
    return rows + [(5000, None, "a", None, 0), (5001, "", None, None, 0), (5002, " \t\n", "only empty", None, 0), (9000, "w w", "b", "", 1), (9000, "w w", "b", "", 1), (None, "  x", "b", "", 1)]


@pytest.mark.parametrize("block_words", [64, 16_384])
def test_taken_meets_targets_exactly(spark, rows, block_words):
    got = mixing.report(spark.createDataFrame(rows, SCHEMA), block_words=block_words).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    want = fill(sizes)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert {s: taken[s] for s in sizes} == {s: round(want[s]) for s in sizes}
    again = mixing.report(spark.createDataFrame(rows, SCHEMA).repartition(7), block_words=block_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_is_exact_and_hypergeometric():
    quotas = np.array([50, 30, 20])
    seen = []
    for seed in range(300):
        parts = mixing.split_tree(quotas, 4, np.random.default_rng(seed))
        assert (parts.sum(axis=0) == quotas).all() and (parts.sum(axis=1) == 25).all()
        seen.append(parts[0])
    assert np.allclose(np.mean(seen, axis=0), quotas / 4, atol=0.5)
    assert np.allclose(np.var(seen, axis=0), [25 * p * (1 - p) * 75 / 99 for p in (0.5, 0.3, 0.2)], rtol=0.35)


def test_mix_repeats_whole_documents_and_keeps_columns(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), block_words=64)
    assert got.columns == SCHEMA.names
    n = Counter(r.doc_id for r in got.collect())
    assert max(v for k, v in n.items() if k != 9000) <= 3 and len(n) > 300


def test_empty(spark):
    assert mixing.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.report(spark.createDataFrame([(1, None, None, "", 0)], SCHEMA)).collect()] == [0]
