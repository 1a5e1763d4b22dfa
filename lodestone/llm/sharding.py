"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

Rows fall by the hash of their text into BLOCKS blocks (equal texts together) and by the hash of their doc_id into up to
SUBS cells of a block. The cell sums - CELLS rows, or BLOCKS for each old shard if those are more, whatever the input -
come to the driver; a flow network (a byte that stays in its shard costs nothing; one that moves goes over a hub, for one)
gives the bytes of each transfer. A transfer takes whole blocks, largest first, and only its last bytes from the cells
of a block, so that equal texts stay together as far as equal sizes allow. Sizes then differ by less than a small cell.

The law is `bytes`: sizes (UTF-8 bytes of the text plus 1; null has no bytes) as near equal as the capacities. Slots
count the rows of a shard from 0 without gaps: cell offsets plus a row number within the cell, so no task ranks a whole
shard or a whole group of copies; ties in a cell go by doc_id, text and size. Null and empty texts are of one block; texts of any
length move whole. Repeated rows get slots of their own. Extra columns move with their rows, whatever their names but
those that begin with _ls_ (refused). An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read_table, work_path

BLOCKS, SUBS, CELLS, NEAR = 1024, 64, 1 << 19, 0.0005
OLD_SHARDS, NEW_SHARDS = 6, 8
CODEC, PART_BYTES = "zstd", 256 << 20


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard; supplies and capacities sum to the same. Successive shortest paths."""
    source, sink = ("s",), ("t",)
    room: dict = {}
    price: dict = {}
    near: dict = {}

    def arc(u, v, cap, cost):
        room[u, v], room[v, u] = cap, 0
        price[u, v], price[v, u] = cost, -cost
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)

    hub = ("hub",)
    for i, n in supply.items():
        arc(source, ("old", i), n, 0)
        arc(("old", i), hub, n, 1)
        if i in capacity:
            arc(("old", i), ("new", i), n, 0)
    for j, n in capacity.items():
        arc(hub, ("new", j), n, 0)
    for j, n in capacity.items():
        arc(("new", j), sink, n, 0)
    while True:
        cost, came, todo, queued = {source: 0}, {}, deque([source]), {source}
        while todo:
            u = todo.popleft()
            queued.discard(u)
            for v in near.get(u, ()):
                if room[u, v] > 0 and cost[u] + price[u, v] < cost.get(v, 1 << 60):
                    cost[v], came[v] = cost[u] + price[u, v], u
                    if v not in queued:
                        todo.append(v)
                        queued.add(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        push = min(room[e] for e in path)
        for u, v in path:
            room[u, v] -= push
            room[v, u] += push
    out = {(i, i): stays for i in supply if i in capacity and (stays := room[("new", i), ("old", i)]) > 0}
    gains = [[j, n] for j in sorted(capacity) if (n := room[("new", j), hub]) > 0]
    for i in sorted(supply):  # what passes the hub goes to the gaining shards in turn
        left = room[hub, ("old", i)]
        while left:
            j, n = gains[-1]
            out[i, j] = out.get((i, j), 0) + min(left, n)
            gains[-1][1] -= min(left, n)
            left -= min(left, n)
            if not gains[-1][1]:
                gains.pop()
    return out


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def transfers(old: np.ndarray, block: np.ndarray, size: np.ndarray, flow: dict[tuple[int, int], int], total: int) -> np.ndarray:
    """New shard of each cell (arrays by cell), following the flow."""
    new = old.copy()
    shards = max(1, len({j for _, j in flow}))
    for i in sorted({i for i, _ in flow}):
        mine = np.flatnonzero(old == i)
        out = sorted(((n, j) for (a, j), n in flow.items() if a == i and j != i), reverse=True)
        stays = flow.get((i, i), 0)
        blocks, at = np.unique(block[mine], return_inverse=True)
        weight = np.bincount(at, weights=size[mine]).astype(np.int64)
        cells = [mine[at == k] for k in range(len(blocks))] if out else []
        free = dict(enumerate(weight))
        for n, j in out:
            last = not stays and j == out[-1][1]
            left = n
            for k in sorted(free, key=lambda k: (-free[k], k)):
                if free[k] <= left or last:
                    new[cells[k][new[cells[k]] == i]] = j
                    left -= free.pop(k)
            for k in sorted(free, key=lambda k: (free[k], k)):
                if left <= NEAR * total / shards:
                    break
                for c in sorted(cells[k][new[cells[k]] == i], key=lambda c: (-size[c], c)):
                    if size[c] <= left:
                        new[c] = j
                        left -= size[c]
                        free[k] -= size[c]
    return new


def keyed(rows: DataFrame, old_shards: int) -> DataFrame:
    """rows (doc_id, text and others) with block, cell of the block, and size."""
    text = F.coalesce("text", F.lit(""))
    subs = max(1, min(SUBS, CELLS // (BLOCKS * max(1, old_shards))))
    return (
        rows.withColumn("_ls_block", F.pmod(F.xxhash64(text), F.lit(BLOCKS)).cast("int")).withColumn("_ls_sub", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(subs)).cast("int"))
        .withColumn("_ls_size", (F.octet_length(text) + 1).cast("long"))
    )


def assignment(rows: DataFrame, capacities: dict[int, int] | int) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """rows: _ls_old, _ls_block, _ls_sub, _ls_size. A row per cell with its new shard; and the flow."""
    spark = rows.sparkSession
    sums = rows.groupBy("_ls_old", "_ls_block", "_ls_sub").agg(F.sum("_ls_size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["_ls_old", "_ls_block", "_ls_sub"], ignore_index=True)
    size = sums["size"].to_numpy(np.int64)
    old = sums["_ls_old"].to_numpy(np.int64)
    total = int(size.sum())
    wanted = equal_capacities(total, capacities) if isinstance(capacities, int) else capacities
    if sum(wanted.values()) != total:
        raise ValueError(f"capacities hold {sum(wanted.values())} bytes, the shards {total}")
    flow = min_cost_flow({int(i): int(size[old == i].sum()) for i in np.unique(old)}, wanted)
    sums["shard"] = transfers(old, sums["_ls_block"].to_numpy(), size, flow, total).astype(np.int32)
    table = pa.table({"_ls_old": pa.array(old, pa.int32()), "_ls_block": pa.array(sums["_ls_block"], pa.int32()), "_ls_sub": pa.array(sums["_ls_sub"], pa.int32()), "_ls_shard": pa.array(sums["shard"], pa.int32())})
    return spark.createDataFrame(table), flow


def store(docs: DataFrame, old_shards: int, out: str) -> dict[int, str]:
    """Write the documents (all columns) as old_shards shards by block of text; shard -> folder."""
    old = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(BLOCKS)) % old_shards
    docs.withColumn("_ls_old", old.cast("int")).write.option("compression", CODEC).partitionBy("_ls_old").parquet(out)
    held = docs.sparkSession.read.parquet(out).select("_ls_old").distinct().collect() if docs.take(1) else []
    return {r[0]: f"{out}/_ls_old={r[0]}" for r in held}


def read_shards(spark: SparkSession, stored: dict[int, str], shard: str) -> DataFrame:
    parts = [spark.read.parquet(path).withColumn(shard, F.lit(i)) for i, path in sorted(stored.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def slots(rows: DataFrame) -> DataFrame:
    """rows (shard, doc_id, text_crc32, _ls_block, _ls_sub, _ls_size) with slot, from 0 in each shard, without gaps."""
    cells = rows.groupBy("shard", "_ls_block", "_ls_sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_ls_block", "_ls_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("shard", "_ls_block", "_ls_sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    in_cell = Window.partitionBy("shard", "_ls_block", "_ls_sub").orderBy("doc_id", "text_crc32", "_ls_size")
    return rows.withColumn("nth", F.row_number().over(in_cell) - 1).join(first, ["shard", "_ls_block", "_ls_sub"]).withColumn("slot", F.col("first") + F.col("nth"))


def report(docs: DataFrame, old_shards: int = OLD_SHARDS, shards: int = NEW_SHARDS) -> DataFrame:
    """The documents, stored in old_shards shards, brought to `shards` shards of equal bytes by rewrite(), as its files hold them."""
    spark = docs.sparkSession
    stored = store(docs.select("doc_id", "text"), old_shards, work_path(spark, "old_shards"))
    after = rewrite(spark, stored, shards, work_path(spark, "new_shards")) if stored else {}
    rows = read_shards(spark, after, "shard") if after else docs.select("doc_id", "text").withColumn("shard", F.lit(0)).limit(0)
    text = F.coalesce("text", F.lit(""))
    sized = keep(keyed(rows, shards).select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "_ls_block", "_ls_sub", "_ls_size"), "sized")
    return slots(sized).select("doc_id", F.col("_ls_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def rewrite(spark: SparkSession, stored: dict[int, str], capacities: dict[int, int] | int, out: str) -> dict[int, str]:
    """Shard -> folder of Parquet files of (doc_id, text, ...). Writes, under out, only shards that gain or lose rows; returns
    the new map, in which the others keep their old folders. Old files stay until the caller has switched maps, so a
    failed run leaves the old map whole. The shards' columns stay as they are."""
    names = spark.read.parquet(min(stored.items())[1]).columns
    if taken := [c for c in names if c.startswith("_ls_")]:
        raise ValueError(f"columns {taken} have names that resharding uses itself")
    rows = read_shards(spark, stored, "_ls_old")
    rows = keyed(rows, len(stored))
    cells, flow = assignment(rows, capacities)
    touched = sorted({i for (i, j) in flow if i != j} | {j for (i, j) in flow if i != j})
    wanted = range(capacities) if isinstance(capacities, int) else capacities
    after = {j: stored[j] for j in wanted if j in stored and j not in touched}
    if touched:
        parts = max(16, sum(flow.values()) // (max(1, len(touched)) * PART_BYTES))  # tasks that write a shard
        side = F.broadcast(cells) if cells.count() <= CELLS else cells
        moved = rows.filter(F.col("_ls_old").isin(touched)).join(side, ["_ls_old", "_ls_block", "_ls_sub"])
        moved.select(*names, "_ls_shard").repartition(len(touched) * parts, "_ls_shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).write.option("compression", CODEC).partitionBy("_ls_shard").parquet(out)
        filled = {r[0] for r in cells.filter(F.col("_ls_shard").isin(touched)).select("_ls_shard").distinct().collect()}
        after |= {j: f"{out}/_ls_shard={j}" for j in touched if j in wanted and j in filled}
    return after


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = None  # blocks are hashed; tested against brute force
