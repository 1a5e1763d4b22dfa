"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Every word gives two hashed features, itself (lower case, ASCII edges of punctuation kept) and its shape (runs of upper
case, lower case, digits and each other character), and one more if it repeats the word before; the document adds its
length class. All grades share one weight per feature; P(grade <= k) = logistic(threshold_k - weights . features), with
ordered thresholds, so the model gives the expected grade and the probability of any upper tail.

Fitted (full-batch Adam, on the driver) on at most `sample` labelled documents, the least by hash of doc_id; features are
made on the executors from whole texts and fit in BUCKETS entries. Scoring gathers the weights of a document's words.
Null and empty texts have the length feature only. With no labels, or one grade, every document gets that grade (or 1)
and stays. Repeated rows get the same score, and so do texts with equal words (ties: at the threshold a document stays).
An empty table gives an empty result. Columns of the documents other than text are not inputs and stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, read_table, small_batches

BUCKETS, SAMPLE, STEPS, RIDGE = 1 << 17, 4000, 250, 1e-5
LIMIT = 100_000
UPPER, LOWER, DIGIT = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+")
REPEATED, LENGTH, LENGTHS = BUCKETS - 40, BUCKETS - 32, 32


class WordFeatures(dict):
    """word -> its two features in one integer, forgotten when there are too many to hold."""

    def __missing__(self, word: bytes) -> int:
        shape = DIGIT.sub(b"9", LOWER.sub(b"x", UPPER.sub(b"X", word.replace(b"X", b"A").replace(b"x", b"a"))))
        room = BUCKETS - 64
        value = xxhash.xxh64_intdigest(word.lower(), 5) % room << 20 | xxhash.xxh64_intdigest(shape, 6) % room
        if len(self) >= LIMIT:
            self.clear()
        self[word] = value
        return value


def features(text: str | None, known: WordFeatures) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Word features, shape features, number of repeated words, length feature."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    again = int((packed[1:] == packed[:-1]).sum()) if len(packed) > 1 else 0
    return packed >> 20, packed & 0xFFFFF, again, LENGTH + min(LENGTHS - 1, int(2 * np.log2(len(words) + 1)))


def feature_batches(batches):
    """(text, grade) -> idx, val, grade: mean features of the whole text."""
    known = WordFeatures()
    for batch in batches:
        idx, val = [], []
        for text in batch.column("text").to_pylist():
            word, shape, again, length = features(text, known)
            n = max(1, len(word))
            at, count = np.unique(np.concatenate([word, shape]), return_counts=True)
            idx.append(np.concatenate([at, [REPEATED, length]]).astype(np.int32))
            val.append(np.concatenate([count / n, [again / n, 1.0]]).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), batch.column("grade")], names=["idx", "val", "grade"])


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Model:
    """grades, weights and thresholds."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights.astype(np.float32), thresholds

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1: rows x (grades - 1)."""
        return logistic(margin[:, None] - self.thresholds[None, :])

    def margin(self, text: str | None, known: WordFeatures) -> float:
        word, shape, again, length = features(text, known)
        w, n = self.weights, max(1, len(word))
        return float((w[word].sum(dtype=np.float64) + w[shape].sum(dtype=np.float64) + again * w[REPEATED]) / n + w[length])


def fit_arrays(idx: list[np.ndarray], val: list[np.ndarray], grade: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Minimise the cumulative-link likelihood with Adam; thresholds are the first and positive gaps."""
    grades = sorted(set(grade.tolist()))
    if len(grades) < 2:
        return Model(grades or [1], np.zeros(BUCKETS), np.empty(0))
    y = np.searchsorted(grades, grade)
    rows = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
    cols, vals, k = np.concatenate(idx), np.concatenate(val).astype(np.float64), len(grades)
    used, cols = np.unique(cols, return_inverse=True)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 0.01, 0.99)
    start = np.maximum.accumulate(np.log(share / (1 - share)))
    theta = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cut = theta[: len(used)], theta[len(used) :]
        gaps = np.exp(cut[1:])
        at = np.concatenate([[-np.inf], cut[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        z = np.bincount(rows, weights=vals * w[cols], minlength=len(idx))
        hi, lo = logistic(np.minimum(at[y + 1] - z, 500)), logistic(np.maximum(at[y] - z, -500))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_z = (d_hi - d_lo) / len(y)
        g_at = -(np.bincount(y + 1, weights=d_hi, minlength=k + 1) - np.bincount(y, weights=d_lo, minlength=k + 1))[1:k] / len(y)
        g = np.concatenate([np.bincount(cols, weights=vals * g_z[rows], minlength=len(used)) + ridge * w, [g_at.sum()], np.cumsum(g_at[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = theta[: len(used)]
    cut = theta[len(used) :]
    return Model(grades, weights, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = SAMPLE) -> Model:
    """labels: doc_id and a graded rating. At most `sample` labelled documents come to the driver, as features."""
    chosen = labels.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(grade).cast("int").alias("grade")).orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "grade")  # `sample` rows at most
    table = rows.mapInArrow(feature_batches, "idx array<int>, val array<float>, grade int").toArrow()
    return fit_arrays([np.asarray(x) for x in table.column("idx").to_numpy()], [np.asarray(x) for x in table.column("val").to_numpy()], table.column("grade").to_numpy())


def scored(docs: DataFrame, model: Model, least: int | None = None) -> DataFrame:
    """docs with expected_grade and tail: P(grade >= least), by default of the highest grade."""
    small_batches(docs.sparkSession)
    least = model.grades[-1] if least is None else least
    above = next((i for i, g in enumerate(model.grades) if g >= least), len(model.grades))
    held = docs.sparkSession.sparkContext.broadcast((model.grades, model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail double")
    def score(texts):
        import pandas as pd

        model, known = Model(*held.value), WordFeatures()
        tails = model.tails(np.array([model.margin(t, known) for t in texts], np.float64))
        known.clear()
        give_back()
        whole = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1)
        return pd.DataFrame({"expected_grade": model.grades[0] + tails @ np.diff(np.array(model.grades, np.float64)), "tail": whole[:, above]})

    return docs.withColumn("_ls_quality", score("text"))


def select(docs: DataFrame, labels: DataFrame, least: int | None = None, odds: float = 0.5, **options) -> DataFrame:
    """The documents whose tail probability reaches odds, with their own columns."""
    return scored(docs, fit(docs, labels, **options), least).filter(F.col("_ls_quality.tail") >= odds).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", "_ls_quality.expected_grade", "_ls_quality.tail", (F.col("_ls_quality.tail") >= 0.5).alias("selected"))


ORACLE = None  # a trained model; tested on held-out labels
