import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import quality

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("grade", T.IntegerType())])
LABELS = "doc_id long, quality int, grade string"


def graded(rng, n):
    """Grade 0 to 3: the share of words that shout."""
    for i in range(n):
        g = int(rng.integers(0, 4))
        yield i, " ".join(("".join(rng.choice(list("abcdefgh"), 5)).upper() + "!!" if rng.random() < (3 - g) / 3 else "".join(rng.choice(list("abcdefgh"), 5))) for _ in range(int(rng.integers(30, 80)))), g


def test_ordinal_fit_on_held_out_grades(spark):
    rows = list(graded(np.random.default_rng(0), 600))
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in rows] + [(601, None, "", 1), (602, "", "", 1), (603, "word " * 50_000, "", 1), (None, "no id", "", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, g, "z") for i, _, g in rows if i % 3] + [(None, 1, "z"), (7, None, "z"), (10**6, 1, "z")], LABELS)
    model = quality.fit(docs, labels)
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r._ls_quality for r in quality.scored(docs, model).collect()}
    assert len(got) == 604
    held = [(got[i].expected_grade, g) for i, _, g in rows if i % 3 == 0]
    assert np.corrcoef(*zip(*held, strict=True))[0, 1] > 0.9
    assert np.mean([abs(e - g) for e, g in held]) < 0.5
    two = {r.doc_id: r._ls_quality.tail for r in quality.scored(docs, model, least=2).collect()}
    assert all(two[i] >= got[i].tail for i in two)
    assert np.mean([(two[i] >= 0.5) == (g >= 2) for i, _, g in rows if i % 3 == 0]) > 0.9


def test_fit_reaches_the_least_of_the_plain_likelihood():
    """Against the likelihood written out row by row, minimised with numeric gradients."""
    rng = np.random.default_rng(4)
    idx, val, grade = [], [], []
    for _ in range(60):
        x = rng.normal(size=3)
        idx.append(np.arange(3))
        val.append(x)
        grade.append(int(np.digitize(x @ [1.5, -1.0, 0.0] + rng.logistic(), [-1.0, 1.0])))
    ridge = 1e-2

    def loss(theta):
        w, cuts = theta[:3], [theta[3], theta[3] + np.exp(theta[4])]
        below = lambda k, z: 0.0 if k < 0 else 1.0 if k > 1 else 1 / (1 + np.exp(-(cuts[k] - z)))
        return -np.mean([np.log(below(g, x @ w) - below(g - 1, x @ w)) for x, g in zip(val, grade, strict=True)]) + ridge / 2 * (w @ w)

    theta, step = np.zeros(5), 1e-5
    for _ in range(3000):
        theta = theta - 0.3 * np.array([(loss(theta + step * e) - loss(theta - step * e)) / (2 * step) for e in np.eye(5)])
    model = quality.fit_arrays(idx, val, np.array(grade), steps=1500, ridge=ridge)
    assert np.allclose(model.weights[:3], theta[:3], atol=0.02) and np.allclose(model.thresholds, [theta[3], theta[3] + np.exp(theta[4])], atol=0.02)
    z = np.array([x @ theta[:3] for x in val])
    assert np.allclose(model.tails(z)[:, 0], 1 - 1 / (1 + np.exp(-(theta[3] - z))), atol=0.02)


def test_whole_shapes_and_ties(spark):
    long = "ab1" * 20
    one, two = (quality.WordFeatures()[(long + end).encode()] & 0xFFFFF for end in ("!", "?"))
    assert one != two  # they differ after many characters
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, "a  b", "", 1), (2, "a b", "", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 0, ""), (2, 1, "")], LABELS)
    assert len({r.t for r in quality.scored(docs, quality.fit(docs, labels)).selectExpr("_ls_quality.tail as t").collect()}) == 1


def test_select_keeps_columns_and_judges_by_text_alone(spark):
    rows = list(graded(np.random.default_rng(1), 300))
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(g > 1), "z") for i, _, g in rows], LABELS)
    got = quality.select(docs, labels)
    assert got.columns == SCHEMA.names and 0 < got.count() < 300


def test_no_labels_one_grade_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1), (2, None, "", 1)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert quality.select(docs, none).count() == 2
    assert quality.select(docs, spark.createDataFrame([(1, 0, "")], LABELS)).count() == 2
    assert quality.select(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0)
    model = quality.fit(docs, labels.join(held, "doc_id", "left_anti"))
    got = quality.scored(docs, model).join(held, "doc_id").selectExpr("avg(int((_ls_quality.tail >= 0.5) = (quality = 1)))", "count(*)").first()
    assert got[1] > 60 and got[0] > 0.95
