import itertools

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import toxicity as tox

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("toxic", T.IntegerType())])
LABELS = "doc_id long, toxic int, text string"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(0, 6, 4)
        e, trans, start = rng.normal(size=int(lengths.sum())) * 2, rng.normal(size=(2, 2)), float(rng.normal())
        p, pairs = tox.marginals(e, lengths, trans, start)
        want, seen, at = [], np.zeros((2, 2)), 0
        for n in lengths:
            x = e[at : at + n]
            at += n
            paths = list(itertools.product((0, 1), repeat=int(n)))
            w = np.array([np.exp(sum(x[t] for t in range(n) if z[t]) + (start if n and z[0] else 0) + sum(trans[z[t - 1], z[t]] for t in range(1, n))) for z in paths])
            w /= w.sum()
            want += [sum(q for q, z in zip(w, paths, strict=True) if z[t]) for t in range(n)]
            for q, z in zip(w, paths, strict=True):
                for t in range(1, n):
                    seen[z[t - 1], z[t]] += q
        assert np.allclose(p, want) and np.allclose(pairs, seen)


def test_unmarked_documents_have_the_general_result():
    model = tox.Model({}, -3.0, [[0, -1.0], [-0.5, 2.0]], 0.3, [0, 0, 0])
    plain = tox.Plain(model)
    for n in (0, 1, 2, 7, 300):
        p, _ = tox.marginals(np.full(n, model.bias), np.array([n]), model.trans, model.start)
        assert np.allclose(plain[n], tox.summaries(p, np.array([n]))[0])


def made(rng, n):
    names = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    for i in range(n):
        words = [str(w) for w in rng.choice(names, int(rng.integers(20, 60)))]
        bad = i % 4 == 0
        if bad:
            for w in rng.choice(["zblork", "grumfx", "vile"], 2):
                words.insert(int(rng.integers(0, len(words))), w + ("" if w != "vile" else "".join(rng.choice(list("xyz"), 3))) + ".")
        yield i, " ".join(words), int(bad)


def test_held_out_documents_and_offsets(spark):
    rows = list(made(np.random.default_rng(1), 800))
    docs = spark.createDataFrame([(i, t, "x", 1 - y) for i, t, y in rows] + [(900, None, "", 1), (901, "", "", 1), (902, "fine " * 60_000 + "é zblork, zblork", "", 0), (None, "no id", "", 0), (None, "no id", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows if i % 5] + [(None, 1, ""), (3, None, "")], LABELS)
    model = tox.fit(docs, labels)
    got = tox.score(docs, model).collect()
    assert len(got) == 805
    by = {r.doc_id: r for r in got}
    held = [(by[i].score >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and by[900].score < 0.5 and by[901].score == by[900].score
    text = {i: t for i, t, _ in rows} | {902: "fine " * 60_000 + "é zblork, zblork"}
    found = [text[r.doc_id][s.start : s.end] for r in got if r.doc_id in text for s in r.spans]
    assert len(found) > 300 and all(w.startswith(("zblork", "grumfx", "vile")) for w in found)
    assert [text[902][s.start : s.end] for s in by[902].spans] == ["zblork,", "zblork"]


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, None, "", 1)], SCHEMA)
    for labels in ([], [(1, 0, "")]):
        model = tox.fit(docs, spark.createDataFrame(labels, LABELS))
        assert [r.score < 0.5 for r in tox.score(docs, model).collect()] == [True, True]
    assert tox.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_query_learns_nothing_from_held_out_rows(spark):
    got = tox.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = got.join(labels, "doc_id").filter("held_out").select(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count(F.lit(1))).first()
    assert got.count() == 1000 and r[1] > 50 and r[0] > 0.9
