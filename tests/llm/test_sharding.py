import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.llm import sharding

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("n", T.LongType())])


def rows(n=3000, hot=1000):
    rng = np.random.default_rng(2)
    out = [(i, "copy of one text é", "x", 1) for i in range(hot)]
    out += [(i, "".join(rng.choice(list("abcé "), int(rng.integers(0, 300)))), None, i) for i in range(hot, n)]
    return out + [(n, None, "x", 1), (n + 1, "", "x", 1), (n + 2, "twice", "x", 1), (n + 2, "twice", "x", 1), (None, "no id", "x", 1), (n + 3, "long " * 5000, "x", 1)]


def test_near_equal_bytes_gapless_slots_and_groups(spark):
    data = rows()
    got = sharding.report(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] or "" for r in data}
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[raw].add(r.shard)
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(size.values()) - min(size.values()) < 0.02 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in where.values()) <= 2
    again = sharding.report(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("seed", range(6))
def test_flow_moves_the_fewest_bytes(seed):
    rng = np.random.default_rng(seed)
    supply = {int(i): int(rng.integers(0, 6)) for i in rng.choice(4, 3, replace=False)}
    total = sum(supply.values())
    caps = sharding.equal_capacities(total, 3)
    flow = sharding.min_cost_flow(supply, caps)
    assert all(sum(n for (i, _), n in flow.items() if i == k) == supply[k] for k in supply)
    assert all(sum(n for (_, j), n in flow.items() if j == k) == caps[k] for k in caps)
    best = min(
        sum(1 for i, j in zip(units, order, strict=True) if i != j)
        for units in [[i for i, n in supply.items() for _ in range(n)]]
        for order in set(itertools.permutations([j for j, n in caps.items() for _ in range(n)]))
    ) if total <= 8 else sum(n for n in supply.values()) - sum(min(supply.get(j, 0), c) for j, c in caps.items())
    assert sum(n for (i, j), n in flow.items() if i != j) == best


def test_rewrite_touches_only_changed_shards(spark, tmp_path):
    df = spark.createDataFrame(rows(600, 100), SCHEMA)
    stored = {}
    for i in range(3):
        stored[i] = f"{tmp_path}/old{i}"
        df.filter(f"pmod(coalesce(doc_id, 0), 3) = {i}").write.parquet(stored[i])
    sizes = {i: spark.read.parquet(p).selectExpr("sum(octet_length(coalesce(text, '')) + 1)").first()[0] for i, p in stored.items()}
    caps = {0: sizes[0], 1: sizes[1] - 500, 2: sizes[2] + 500}
    after = sharding.rewrite(spark, stored, caps, f"{tmp_path}/new")
    assert after[0] == stored[0] and after[1] != stored[1] and sorted(after) == [0, 1, 2]
    all_rows = [spark.read.parquet(p) for p in after.values()]
    assert all(p.columns == SCHEMA.names for p in all_rows)
    assert sum(p.count() for p in all_rows) == df.count()


def test_many_shards_and_refused_names(spark, tmp_path):
    n = 300
    flow = sharding.min_cost_flow({i: 100 + i for i in range(n)}, sharding.equal_capacities(sum(100 + i for i in range(n)), n + 50))
    gain = sharding.equal_capacities(sum(100 + i for i in range(n)), n + 50)
    assert sum(m for (i, j), m in flow.items() if i == j) == sum(min(100 + i, gain[i]) for i in range(n)) and len(flow) < 4 * n
    spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, _ls_old int").write.parquet(f"{tmp_path}/x")
    with pytest.raises(ValueError):
        sharding.rewrite(spark, {0: f"{tmp_path}/x"}, 2, f"{tmp_path}/y")


def test_empty(spark):
    assert sharding.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.report(spark.createDataFrame([(1, None, "", 1)], SCHEMA)).collect()][0][1] == 0
