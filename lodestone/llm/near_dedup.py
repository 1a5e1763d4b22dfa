"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

1. One pass over the texts makes each document's set of distinct word shingles, its SuperMinHash signature and band keys.
   Documents with equal sets become one node at once (counts by set, combined before the shuffle).
2. Nodes that share a band key form a bucket; every member is paired with the bucket's least node only, so a bucket
   gives as many pairs as members. Pairs whose set sizes rule the similarity out are dropped, the others confirmed on
   full sets.
3. Buckets that overlap make a family, and a family that step 2 joins costs nothing more. A family that it leaves in
   several components is searched so that no link between them is lost:
   a. of at most SMALL_FAMILY nodes: every node outside its main component meets every node of another component, by
      exact intersection counts in blocks of at most BLOCK_ROWS x BLOCK_ROWS, from which only true links leave;
   b. larger ones by prefixes: a family's shingles are ordered, those few REFERENCES sets hold first (the order decides
      only how much work there is), and linked sets share many of their first shingles. Pairs that share enough shingles
      of at most HOT_HOLDERS holders are confirmed on full sets; nodes that share a shingle of more holders make
      smaller families, which are compared as in a. Documents of one template with text of their own share none.
4. Union-find labels: edges are contracted towards least neighbours in rounds until at most FOREST_EDGES remain, which
   one task then joins.

A link needs 100 * intersection >= 100 * similarity * union, in integers. Two sets at 0.8 share no band of 40 x 6 with
odds of 5e-6. Documents without words have empty sets and link with nothing; null texts count as empty; a null doc_id is
no candidate for the least one. Rows that repeat a doc_id are documents of their own in the report; deduplicate()
keeps or drops them together, by identifier. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, keep, read_table, slices, small_batches
from .shingles import WordHashes, bands_of, chunks, scramble, set_key, shingle_set, signatures

BANDS, ROWS, SHINGLE, SIMILARITY = 40, 6, 5, 80
CHUNK_ELEMENTS, BLOCK_ROWS, BLOCK_ELEMENTS, FOREST_EDGES = 100_000, 512, 2_000_000, 1_000_000
#: Nodes of a family that is compared whole; holders of a hot prefix shingle; sets (and their elements) that order a family's shingles.
SMALL_FAMILY, HOT_HOLDERS, REFERENCES, REFERENCE_ELEMENTS = 256, 64, 32, 400_000


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sign_batches(batches, k: int, bands: int, rows: int):
    """(doc_id, text) -> doc_id, n, hi, lo, bands."""
    known = WordHashes()
    for batch in slices(batches):
        sets = [shingle_set(t, k, known) for t in batch.column("text").to_pylist()]
        keys = [tuple(map(signed, set_key(s))) if len(s) else (None, None) for s in sets]
        full = [s for s in sets if len(s)]
        parts = [bands_of(signatures(full[a:b], bands * rows), bands, rows) for a, b in chunks(full, CHUNK_ELEMENTS)]
        flat = np.concatenate(parts).view(np.int64).ravel() if parts else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum([bands if len(s) else 0 for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([h for h, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "n", "hi", "lo", "bands"],
        )


def set_batches(batches, k: int):
    """(text) -> hi, lo, n, items: the set as bytes."""
    known = WordHashes()
    for batch in slices(batches):
        sets = [shingle_set(t, k, known) for t in batch.column("text").to_pylist()]
        keys = [tuple(map(signed, set_key(s))) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["hi", "lo", "items"],
        )


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def verify_batches(batches, similarity: int):
    """(a, b, items_a, items_b) -> a, b of the pairs that are links."""
    for batch in batches:
        left, right = (batch.column(c).to_pylist() for c in ("items_a", "items_b"))
        good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: frequent elements by a matrix product, the others pair by pair."""
    out = np.zeros((len(left), len(right)), np.int64)
    at_l, at_r = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    e_l, e_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(e_l, e_r)
    if not len(shared):
        return out
    i_l, i_r = (np.minimum(np.searchsorted(shared, e), len(shared) - 1) for e in (e_l, e_r))
    on_l, on_r = shared[i_l] == e_l, shared[i_r] == e_r
    i_l, at_l, i_r, at_r = i_l[on_l], at_l[on_l], i_r[on_r], at_r[on_r]
    n_l, n_r = np.bincount(i_l, minlength=len(shared)), np.bincount(i_r, minlength=len(shared))
    many = n_l * n_r >= 64
    rank = np.cumsum(many) - 1
    for start in range(0, int(many.sum()), 2048):
        sides = []
        for i, at, n in ((i_l, at_l, len(left)), (i_r, at_r, len(right))):
            pick = many[i] & (rank[i] >= start) & (rank[i] < start + 2048)
            side = np.zeros((n, 2048), np.float32)
            side[at[pick], rank[i[pick]] - start] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    few_l, few_r = ~many[i_l], ~many[i_r]
    order = np.argsort(i_r[few_r], kind="stable")
    r_item, r_at = i_r[few_r][order], at_r[few_r][order]
    lo, hi = np.searchsorted(r_item, i_l[few_l], "left"), np.searchsorted(r_item, i_l[few_l], "right")
    times = hi - lo
    if times.sum():
        l_at = np.repeat(at_l[few_l], times)
        steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
        np.add.at(out, (l_at, r_at[steps]), 1)
    return out


def prefix_batches(batches, similarity: int):
    """Rows sorted by (family, salt, kind), references before members: node, items. -> key, node of the members' prefixes.

    A family's shingles are ordered by how many references hold them, then by hash. Two linked sets of sizes n share at
    least l shingles among the first n - ceil(similarity * n) + l of each, for any l; l is a tenth of n."""
    group, held, ranks = None, [], None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("family", "salt", "kind", "node", "items"))
        keys, nodes = [], []
        for family, salt, kind, node, items in zip(*columns, strict=True):
            items = np.frombuffer(items, np.uint64)
            if (family, salt) != group:
                group, held, ranks = (family, salt), [], None
            if kind == 0:
                held.append(items)
                continue
            if ranks is None:
                ranks, held = np.unique(np.concatenate(held), return_counts=True), []
            at = np.minimum(np.searchsorted(ranks[0], items), len(ranks[0]) - 1)
            count = np.where(ranks[0][at] == items, ranks[1][at], 0)
            mixed = scramble(items + np.uint64(family & (1 << 64) - 1))
            must = -(-similarity * len(items) // 100)
            first = np.lexsort((mixed, count))[: len(items) - must + min(len(items) // 10 + 1, must)]
            keys.append(mixed[first])
            nodes.append(np.full(len(first), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])


def block_batches(batches, similarity: int):
    """Rows sorted by (family, x, y): node, comp, outside?, items. A link per node and component, if there is one, leaves."""
    held: list = []
    key = None

    def flush():
        outer = [r for r in held if r[2]]
        inner = [r for r in held if not r[2]]
        found = []
        if outer and inner:
            sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in (outer, inner)]
            both = intersections(*sets)
            n_o, n_i = (np.array([len(s) for s in side]) for side in sets)
            comp_o, comp_i = (np.array([r[1] for r in side]) for side in (outer, inner))
            good = (100 * both >= similarity * (n_o[:, None] + n_i[None, :] - both)) & (comp_o[:, None] != comp_i[None, :])
            seen = set()
            for x, y in zip(*np.nonzero(good), strict=True):
                if (joined := (comp_o[x], comp_i[y])) not in seen:
                    seen.add(joined)
                    found.append((outer[x][0], inner[y][0]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("family", "x", "y")), strict=True)
        rows = zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "outer", "items")), strict=True)
        for at, row in zip(keys, rows, strict=True):
            if at != key and held:
                yield flush()
            key = at
            held.append(row)
    if held:
        yield flush()


def forest_batches(batches):
    """Edges (a, b) -> v, root for every node that is not its own root (the least of its tree)."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while (up := parent.get(root, root)) != root:
            root = up
        while v != root:
            parent[v], v = root, parent.get(v, v)
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(v, root) for v in parent if (root := find(v)) != v]
    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["v", "root"])


def components(edges: DataFrame, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """Edges (a, b) -> v, root (the least node of its component), for every node that is not its own root."""
    labels = None
    edges = keep(edges.distinct(), "edges")
    while edges.count() > forest_edges:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(both.groupBy("a").agg(F.min("b").alias("to")).filter("to < a").select(F.col("a").alias("v"), F.col("to").alias("root")), "step")
        labels = step if labels is None else keep(with_step(labels, step), "labels")
        edges = keep(mapped(mapped(edges, step, "a"), step, "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = keep(edges.coalesce(1).mapInArrow(forest_batches, "v long, root long"), "forest")
    return last if labels is None else keep(with_step(labels, last), "labels")


def mapped(edges: DataFrame, step: DataFrame, end: str) -> DataFrame:
    to = step.select(F.col("v").alias(end), F.col("root").alias("_to"))
    return edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")


def relabelled(labels: DataFrame, step: DataFrame) -> DataFrame:
    to = step.select(F.col("v").alias("root"), F.col("root").alias("_to"))
    return labels.join(to, "root", "left").select("v", F.coalesce("_to", "root").alias("root"))


def with_step(labels: DataFrame, step: DataFrame) -> DataFrame:
    """A row per node: one that moved before, and was since the end another node moved to, keeps its row, whose root moves."""
    return relabelled(labels, step).unionByName(step.join(labels, "v", "left_anti"))


def fits(df: DataFrame, bytes_per_row: int) -> bool:
    return df.count() * bytes_per_row <= BROADCAST_BYTES


def small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df, to be broadcast if it is measured to be small."""
    return F.broadcast(df) if fits(df, bytes_per_row) else df


def sets_of(docs: DataFrame, nodes: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """node, items of the needed nodes, from the whole text of one of their documents. nodes: hi, lo, node, doc_id."""
    wanted = keep(nodes.join(needed, "node", "left_semi"), "wanted")
    rows = docs.join(small(wanted.select(F.col("doc_id").alias("_id")).distinct(), 32), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    made = rows.mapInArrow(functools.partial(set_batches, k=k), "hi long, lo long, items binary")
    return keep(made.join(small(wanted.select("hi", "lo", "node"), 64), ["hi", "lo"]).select("node", "items").dropDuplicates(["node"]), "sets")


def label(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return rows.join(labels.select(F.col("v").alias("node"), "root"), "node", "left").withColumn(name, F.coalesce("root", "node")).drop("root")


def links(docs: DataFrame, nodes: DataFrame, banded: DataFrame, k: int, similarity: int, block_rows: int, forest_edges: int, small_family: int, hot_holders: int) -> DataFrame:
    """All links (a, b) needed for the components of the nodes. banded: node, n, band key."""
    buckets = banded.groupBy("key").agg(F.min(F.col("node")).alias("rep"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    star = keep(banded.select("key", "node").join(buckets.select("key", "rep"), "key").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sizes = nodes.select("node", "n")
    sized = star.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    likely = keep(sized.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similarity).select("a", "b"), "likely")
    family = components(star, forest_edges)
    members = family.select(F.col("v").alias("node")).unionByName(family.select(F.col("root").alias("node")).distinct())
    sets = sets_of(docs, nodes, members, k)
    first = keep(verified(likely, sets, similarity), "links")
    state = label(label(members, family, "family"), components(first, forest_edges), "comp")
    state = keep(state.join(sizes, "node"), "state")
    widths = F.max("n").alias("widest")
    by_comp = state.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("size"), widths)
    apart = by_comp.groupBy("family").agg(F.count(F.lit(1)).alias("comps"), F.sum("size").alias("nodes"), F.max("widest").alias("widest"))
    apart = keep(apart.filter("comps > 1 AND nodes > 2").drop("comps"), "apart")
    open_ = keep(state.join(apart, "family"), "open")
    whole = open_.filter(F.col("nodes") <= small_family).select("family", "node", "comp", "n")
    close, hot = prefix_links(open_.filter(F.col("nodes") > small_family), sets, similarity, block_rows, hot_holders)
    second = verified(close, sets, similarity)
    third = block_links(keep(whole.unionByName(hot), "compared"), sets, similarity, block_rows)
    return first.unionByName(keep(second.unionByName(third), "more_links"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b of the pairs that are links."""
    at = lambda end: sets.select(F.col("node").alias(end), F.col("items").alias(f"items_{end}"))
    return pairs.join(at("a"), "a").join(at("b"), "b").mapInArrow(functools.partial(verify_batches, similarity=similarity), "a long, b long")


def prefix_links(nodes: DataFrame, sets: DataFrame, similarity: int, block_rows: int, hot_holders: int) -> tuple[DataFrame, DataFrame]:
    """Of families (family, node, comp, n, nodes, widest): pairs (a, b) that can be links, and nodes (family, node, comp, n)
    to be compared whole, in families made smaller. Every link between two components is in one of both."""
    salts = F.ceil(F.col("nodes") / block_rows).cast("int")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("node"), "node"))
    most = F.greatest(F.lit(2), F.least(F.lit(REFERENCES), F.floor(F.lit(REFERENCE_ELEMENTS) / F.col("widest"))))
    chosen = nodes.withColumn("place", place).filter(F.col("place") <= REFERENCES).filter(F.col("place") <= most)
    references = chosen.select("family", "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"))
    members = nodes.select("family", "node", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"))
    dealt = references.unionByName(members).join(sets, "node").repartition("family", "salt").sortWithinPartitions("family", "salt", "kind")
    rows = keep(dealt.mapInArrow(functools.partial(prefix_batches, similarity=similarity), "key long, node long"), "prefixes")
    holders = rows.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("rep")).filter(F.col("holders") > hot_holders)
    shared = small(keep(holders.select("key", "rep"), "hot"), 32)  # apart, so that no task gets all rows of a hot shingle
    star = rows.join(shared, "key").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    smaller = components(star)
    hot = smaller.select(F.col("v").alias("node")).unionByName(smaller.select(F.col("root").alias("node")).distinct())
    hot = label(hot.join(nodes.select("node", "comp", "n"), "node"), smaller, "family").select("family", "node", "comp", "n")
    lists = rows.join(shared.select("key"), "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("who")).filter(F.size("who") > 1)
    after = lambda i: F.slice("who", i + 2, F.size("who"))
    pairs = F.flatten(F.transform("who", lambda a, i: F.transform(after(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = lists.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    facts = lambda end: nodes.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"), F.col("n").alias(f"n_{end}"))
    full = met.join(facts("a"), "a").join(facts("b"), "b").withColumn("low", F.least("n_a", "n_b")).withColumn("high", F.greatest("n_a", "n_b"))
    enough = F.least(F.floor(F.col("low") / 10) + 1, F.ceil(F.col("low") * similarity / 100))
    close = full.filter((F.col("comp_a") != F.col("comp_b")) & (F.col("low") * 100 >= F.col("high") * similarity) & (F.col("shared") >= enough)).select("a", "b")
    return keep(close, "close"), hot


def block_links(state: DataFrame, sets: DataFrame, similarity: int, block_rows: int) -> DataFrame:
    """Links between the components of each family (family, node, comp, n), from exact counts block by block."""
    by_comp = state.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("widest"))
    open_ = by_comp.groupBy("family").agg(F.count(F.lit(1)).alias("comps"), F.sum("size").alias("nodes"), F.max("widest").alias("widest"), F.max(F.struct("size", "comp")).alias("main"))
    open_ = keep(open_.filter("comps > 1").select("family", "nodes", "widest", F.col("main.comp").alias("main"), (F.col("nodes") - F.col("main.size")).alias("outside")), "blocks")
    per = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(BLOCK_ELEMENTS) / F.col("widest"))))
    placed = state.join(open_, "family").select("family", "node", "comp", (F.col("comp") != F.col("main")).alias("out"), F.ceil(F.col("outside") / per).cast("int").alias("x_n"), F.ceil(F.col("nodes") / per).cast("int").alias("y_n"))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = placed.filter("out").withColumn("x", spot("x_n")).withColumn("y", upto("y_n")).withColumn("outer", F.lit(True))
    inner = placed.withColumn("y", spot("y_n")).withColumn("x", upto("x_n")).withColumn("outer", F.lit(False))
    cells = outer.select("family", "x", "y", "outer", "node", "comp").unionByName(inner.select("family", "x", "y", "outer", "node", "comp")).join(sets, "node")
    return cells.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(functools.partial(block_batches, similarity=similarity), "a long, b long")


def report(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block_rows: int = BLOCK_ROWS, forest_edges: int = FOREST_EDGES, small_family: int = SMALL_FAMILY, hot_holders: int = HOT_HOLDERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_rows = keep(docs.mapInArrow(functools.partial(sign_batches, k=shingle, bands=bands, rows=rows), "doc_id long, n long, hi long, lo long, bands array<long>"), "signatures")
    by_set = signed_rows.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"))
    nth = F.row_number().over(Window.partitionBy("lo").orderBy("hi"))
    nodes = keep(by_set.withColumn("node", F.when(nth == 1, F.col("lo")).otherwise(F.col("hi"))), "nodes")
    firsts = signed_rows.join(nodes, ["hi", "lo", "n"]).filter(signed_rows["doc_id"].eqNullSafe(nodes["doc_id"])).select("node", "bands")
    banded = firsts.select("node", F.explode("bands").alias("key")).distinct()
    found = components(links(docs, nodes, banded, shingle, similarity, block_rows, forest_edges, small_family, hot_holders), forest_edges)
    comps = keep(label(nodes.select("node", "hi", "lo", "doc_id"), found, "comp"), "comps")
    least = keep(comps.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")  # apart, so that a hot component's join can be split
    by_key = keep(comps.join(least, "comp").select("hi", "lo", "component_id"), "classes")
    joined = signed_rows.select("doc_id", "n", "hi", "lo").join(by_key, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each group the one with the least doc_id, with all its columns."""
    kept = keep(report(docs, **options).filter("kept").select(F.col("doc_id").alias("_ls_id")).distinct(), "kept")
    return docs.join(small(kept, 32), docs["doc_id"].cast("long").eqNullSafe(kept["_ls_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"), shingle=2)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(a) < 2 THEN a[1] ELSE a[i] || ' ' || a[i + 1] END AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a), 2))) AS i FROM w WHERE len(a) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
