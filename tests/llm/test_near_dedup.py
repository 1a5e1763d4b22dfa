import itertools

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.llm import near_dedup, shingles

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("n", T.IntegerType())])


def sets(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, similarity=80):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= similarity * len(s[i] | s[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s[i]), least.get(find(i)) if s[i] else doc) for i, (doc, _) in enumerate(rows)]


def family(rng, n, words=60, spread=0.25):
    """Copies of one text with growing edits, so that links within the family lie on both sides of the threshold."""
    base = [f"w{rng.integers(0, 5000)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for i in range(words):
            if rng.random() < spread * rng.random():
                text[i] = f"x{rng.integers(0, 10**6)}"
        yield " ".join(text)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    texts = [*family(rng, 80), *family(rng, 30, 12), *family(rng, 20, 500, 0.1)]
    texts += ["one", "One", "two words", "TWO  words", "É é", "é é", "long " * 30_000, "long " * 30_000 + "end"]
    rows = list(zip(map(int, rng.permutation(len(texts))), texts, strict=True))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, texts[0]), (903, texts[0]), (None, texts[1]), (None, "alone here"), (904, "same id a b"), (904, "other text c d")]


@pytest.mark.parametrize("seed,k,block_rows,forest,small,hot", [(1, 2, 1024, 1_000_000, 256, 64), (2, 2, 16, 20, 0, 2), (3, 5, 7, 3, 0, 8), (5, 2, 16, 20, 0, 1000), (6, 1, 512, 20, 10, 0)])
def test_components_match_brute_force(spark, seed, k, block_rows, forest, small, hot):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.report(df, shingle=k, block_rows=block_rows, forest_edges=forest, small_family=small, hot_holders=hot).collect()), key=str)
    assert got == sorted(brute(rows, k), key=str)


@pytest.mark.parametrize("forest", [0, 1])
def test_chains_have_one_label_a_node(spark, forest):
    rng = np.random.default_rng(forest)
    mixed = rng.permutation(np.arange(100, 140)).tolist()  # a long chain that needs several rounds
    pairs = [(1, 2), (2, 3), *((i, i + 1) for i in range(10, 16)), *zip(mixed, mixed[1:], strict=False)]
    got = near_dedup.components(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long"), forest).collect()
    want = {2: 1, 3: 1} | {i: 10 for i in range(11, 17)} | {i: 100 for i in range(101, 140)}
    assert sorted((r.v, r.root) for r in got) == sorted(want.items())


def test_deduplicate_keeps_one_of_each_group_with_its_columns(spark):
    rows = [r for r in rows_of(4) if r[0] is not None]
    got = near_dedup.deduplicate(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert got.columns == SCHEMA.names
    want = sorted((d for d, _, c in brute(rows, 5) if d == c), key=str)
    assert sorted((r.doc_id for r in got.collect()), key=str) == want


def templates(n, shared=60, own=40, words=300):
    """Documents of one template, with text of their own from few words, and a copy with one word more of each tenth one."""
    rng = np.random.default_rng(n)
    template = [f"t{i}" for i in range(shared)]
    texts = [" ".join(template[: shared // 2] + [f"w{x}" for x in rng.integers(0, words, own)] + template[shared // 2 :]) for _ in range(n)]
    return list(enumerate(texts + [t + " more" for t in texts[::10]]))


def test_template_documents_cost_in_proportion(spark, monkeypatch):
    compared = {}

    def counted(pairs, sets, similarity, real=near_dedup.verified):
        compared[name] = compared.get(name, 0) + pairs.count()
        return real(pairs, sets, similarity)

    def blocks(state, sets, similarity, block_rows, real=near_dedup.block_links):
        compared[name] += sum(r["count"] ** 2 for r in state.groupBy("family").count().collect())
        return real(state, sets, similarity, block_rows)

    monkeypatch.setattr(near_dedup, "verified", counted)
    monkeypatch.setattr(near_dedup, "block_links", blocks)
    for name in (400, 800):
        rows = templates(name)
        got = near_dedup.report(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), shingle=2).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 2))
    assert compared[800] < 3 * compared[400] < 30 * 400, compared


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.report(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0
    one = near_dedup.report(spark.createDataFrame([(5, None, "", 1)], SCHEMA)).first()
    assert (one.n_shingles, one.component_id, one.kept) == (0, 5, True)


def test_signature_estimates_similarity_with_less_variance_than_minhash():
    rng = np.random.default_rng(0)
    m, error = 64, []
    for _ in range(400):
        both, left, right = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (40, 10, 10))
        sig = shingles.signatures([np.unique(np.r_[both, left]), np.unique(np.r_[both, right])], m)
        error.append((sig[0] == sig[1]).mean() - 40 / 60)
    assert abs(np.mean(error)) < 0.01
    assert np.var(error) < 0.75 * (2 / 3) * (1 / 3) / m


def test_signature_matches_a_plain_reading():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        m, want = 24, [None] * 24
        for e in s.tolist():
            order = list(range(m))
            for j in range(m):
                draw = int(shingles.scramble(np.array([(e + int(shingles.GOLD) * (j + 1)) % 2**64], np.uint64))[0])
                pick = j + ((draw & 0xFFFFFFFF) * (m - j) >> 32)
                order[j], order[pick] = order[pick], order[j]
                rank = (j << 32) | (draw >> 32)
                if want[order[j]] is None or rank < want[order[j]]:
                    want[order[j]] = rank
        assert shingles.signatures([s], m)[0].tolist() == want


def test_intersections_match_sets():
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, n, 50).astype(np.uint64)) for n in (60, 300, 5000) for _ in range(20)] for _ in range(2))
    got = near_dedup.intersections(left, right)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
