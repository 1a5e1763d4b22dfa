"""Toxic spans by a linear-chain conditional random field over a document's words.

Labelled tokens come from labelled documents: among at most `sample` of them, words and word openings that mark toxic
documents beyond chance (in LEAST_TOXIC of them or more, a log-likelihood ratio over LEAST_RATIO, at most one clean
document for CLEAN_SHARE toxic ones; the FEATURES strongest) are ranked by that ratio and kept while they explain toxic
documents (of at most TOXIC) that stronger ones left unexplained; in toxic documents, the words that carry one are labelled toxic, all others clean. The field has two
states and learns emission weights of those features, a bias and transitions by maximum likelihood (forward-backward
over whole documents, at most `sequences` per class). At scoring, exact forward-backward marginals give every word's
probability; a document's score is a logistic function, fitted on the training documents, of its largest marginal and
its expected number of toxic words. Offsets of words with a marginal of a half or more are code points, end exclusive.

Only the text is an input of a score. Null and empty texts get the score of a document without words. Without labels of
both classes, every score is the base rate (0 without labels). Repeated rows get equal scores; an empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, small_batches

SAMPLE, TOXIC, SEQUENCES, FEATURES, STEPS, RIDGE = 20_000, 4000, 800, 20_000, 60, 2e-3
LEAST_TOXIC, LEAST_RATIO, CLEAN_SHARE = 3, 6, 20
OPENINGS = (3, 4, 5, 6)
LIMIT = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@“”«»…"


def features_of(word: bytes) -> list[str]:
    """The word without edges of punctuation, in lower case, and its openings."""
    w = word.decode("utf-8", "replace").strip(EDGES).lower()
    return [w] + [w[:n] + "*" for n in OPENINGS if n < len(w)] if w else []


def words_of(text: str | None) -> list[bytes]:
    """Runs of non-space: bytes.split knows exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def count_batches(batches):
    """(text, toxic) -> feature, toxic and clean documents with it, in this task."""
    toxic, clean = Counter(), Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(toxic) + list(clean)), pa.array([*toxic.values(), *[0] * len(clean)], pa.int64()), pa.array([*[0] * len(toxic), *clean.values()], pa.int64())], names=["feature", "toxic", "clean"])
    for batch in slices(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if y else clean).update({f for w in set(words_of(text)) for f in features_of(w)})
            if len(toxic) + len(clean) > 1_000_000:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()


def sequence_batches(batches, index: dict[str, int]):
    """(text, toxic) -> number of words, positions and features of the words that have known ones, toxic."""
    for batch in batches:
        n, at, ids = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            hits = [(t, i) for t, w in enumerate(words) for f in features_of(w) if (i := index.get(f)) is not None]
            n.append(len(words))
            at.append([t for t, _ in hits])
            ids.append([i for _, i in hits])
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())], names=["n", "at", "ids", "toxic"])


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward on many documents at once, step by step, in odds of state 1 to state 0.

    emission: log-odds of all words, documents one after another; trans: log potentials [from, to]. Returns
    P(state 1) of each word, and expected transitions [from, to] (summed), exact up to rounding."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(-lengths, kind="stable")
    first, size = offsets[order], lengths[order]
    odds = np.exp(np.clip(emission, -60, 60))
    (a, b), (c, d) = np.exp(trans)
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        at = first[: active[t]] + t
        if t:
            before = forward[at - 1]
            forward[at] = odds[at] * (b + before * d) / (a + before * c)
        else:
            forward[at] = odds[at] * math.exp(start)
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        after = odds[at + 1] * backward[at + 1]
        backward[at] = (c + d * after) / (a + b * after)
    both = forward * backward
    p = both / (1 + both)
    inner = np.ones(len(odds), bool)
    inner[offsets[lengths > 0]] = False
    now = np.flatnonzero(inner)
    prev, nxt = forward[now - 1], odds[now] * backward[now]
    total = a + b * nxt + prev * (c + d * nxt)
    pairs = np.array([[(a / total).sum(), (b * nxt / total).sum()], [(prev * c / total).sum(), (prev * d * nxt / total).sum()]])
    return p, pairs


def explain(candidates: list[tuple[str, float]], docs: list[set[int]]) -> list[int]:
    """Candidates (by falling strength) that mark documents which stronger ones did not, at least three."""
    where: dict[int, list[int]] = {}
    for i, found in enumerate(docs):
        for f in found:
            where.setdefault(f, []).append(i)
    open_, kept = set(range(len(docs))), []
    for f in range(len(candidates)):
        new = [i for i in where.get(f, ()) if i in open_]
        if len(new) >= 3:
            kept.append(f)
            open_.difference_update(new)
    return kept


class Model:
    """Feature weights, bias, transitions, start and the document's logistic coefficients."""

    def __init__(self, weights: dict[str, float], bias: float, trans, start: float, head):
        self.weights, self.bias, self.trans, self.start, self.head = weights, bias, np.asarray(trans, float), start, np.asarray(head, float)

    def plain(self) -> tuple:
        return self.weights, self.bias, self.trans.tolist(), self.start, self.head.tolist()


class Emissions(dict):
    """word -> log-odds of its emission, forgotten when there are too many to hold."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        get = self.model.weights.get
        value = self.model.bias + sum(get(f, 0.0) for f in features_of(word))
        if len(self) >= LIMIT:
            self.clear()
        self[word] = value
        return value


def logistic(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


class Plain(dict):
    """Number of words -> summary of a document none of whose words has a known feature.

    With equal emissions, the forward odds depend on the place from the start alone and the backward odds on the place
    from the end alone, so both are worked out once."""

    def __init__(self, model: Model):
        super().__init__()
        (self.a, self.b), (self.c, self.d) = np.exp(model.trans).tolist()
        self.odds = math.exp(model.bias)
        self.forward, self.backward = [self.odds * math.exp(model.start)], [1.0]

    def __missing__(self, n: int) -> np.ndarray:
        f, b = self.forward, self.backward
        while len(f) < n:
            f.append(self.odds * (self.b + f[-1] * self.d) / (self.a + f[-1] * self.c))
            after = self.odds * b[-1]
            b.append((self.c + self.d * after) / (self.a + self.b * after))
        both = np.array(f[:n]) * np.array(b[:n])[::-1]
        self[n] = summaries(both / (1 + both), np.array([n]))[0]
        return self[n]


def summaries(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log-odds of its largest marginal, log of 1 + its expected toxic words."""
    out = np.tile([1.0, -12.0, 0.0], (len(lengths), 1))
    full = lengths > 0
    if full.any():
        starts = (np.concatenate([[0], np.cumsum(lengths)])[:-1])[full]
        top = np.clip(np.maximum.reduceat(p, starts), 6e-6, 1 - 6e-6)
        out[full, 1] = np.log(top / (1 - top))
        out[full, 2] = np.log1p(np.add.reduceat(p, starts))
    return out


def train_field(n: np.ndarray, at: list[np.ndarray], ids: list[np.ndarray], toxic: np.ndarray, size: int) -> tuple[np.ndarray, float, np.ndarray, float]:
    """Maximum likelihood of the labelled tokens, by Adam on exact gradients."""
    offsets = np.concatenate([[0], np.cumsum(n)])[:-1]
    spot = np.concatenate([o + a for o, a in zip(offsets, at, strict=True)]).astype(np.int64) if len(at) else np.empty(0, np.int64)
    feature = np.concatenate(ids).astype(np.int64) if len(ids) else np.empty(0, np.int64)
    gold = np.zeros(int(n.sum()))
    gold[np.concatenate([o + a for o, a, y in zip(offsets, at, toxic, strict=True) if y] or [np.empty(0)]).astype(np.int64)] = 1
    inner = np.ones(len(gold), bool)
    inner[offsets[n > 0]] = False
    now = np.flatnonzero(inner)
    was, is_ = gold[now - 1], gold[now]
    seen = np.array([[((1 - was) * (1 - is_)).sum(), ((1 - was) * is_).sum()], [(was * (1 - is_)).sum(), (was * is_).sum()]])
    firsts = offsets[n > 0]
    theta = np.concatenate([np.zeros(size), [-4.0, 0.0, 0.0, 0.0, 0.0]])  # weights, bias, start, trans 01, 10, 11
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, gold.sum())
    for step in range(1, STEPS + 1):
        trans = np.array([[0.0, theta[size + 2]], [theta[size + 3], theta[size + 4]]])
        emission = np.full(len(gold), theta[size])
        np.add.at(emission, spot, theta[feature])
        p, pairs = marginals(emission, n, trans, theta[size + 1])
        miss = p - gold
        g = np.concatenate([np.bincount(feature, weights=miss[spot], minlength=size), [miss.sum(), miss[firsts].sum()], (pairs - seen).ravel()[1:]]) / scale + RIDGE * np.concatenate([theta[:size], np.full(5, 0.0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:size], float(theta[size]), np.array([[0.0, theta[size + 2]], [theta[size + 3], theta[size + 4]]]), float(theta[size + 1])


def fit_head(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = logistic(x @ w)
        g = x.T @ (q - y) + 0.05 * w
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w)), g)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sequences: int = SEQUENCES) -> Model:
    """labels: doc_id, toxic. At most `sample` labelled documents are read, those with the least hash of doc_id."""
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("toxic"))
    chosen = labels.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")  # `sample` rows at most
    sizes = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        rate = n_toxic / max(1, n_toxic + n_clean)
        return Model({}, -9.0, np.zeros((2, 2)), 0.0, [math.log((rate + 1e-6) / (1 - rate + 1e-6)), 0.0, 0.0])
    counted = rows.mapInArrow(count_batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= LEAST_TOXIC)
    base = n_toxic / (n_toxic + n_clean)
    n = F.col("t") + F.col("c")
    ratio = F.col("t") * F.log(F.col("t") / (n * base)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - base)))).otherwise(0.0)
    strong = counted.withColumn("ratio", ratio).filter((F.col("ratio") > LEAST_RATIO) & (F.col("c") * CLEAN_SHARE <= F.col("t"))).orderBy(F.desc("ratio"), F.length("feature").desc(), "feature").limit(FEATURES).collect()
    candidates = [(r["feature"], r["ratio"]) for r in strong]
    nth = F.xxhash64("_id", F.lit(7))
    per_class = [chosen.filter(F.col("toxic") == flag).orderBy(nth, "_id", "toxic").limit(limit) for flag, limit in ((True, TOXIC), (False, sequences))]
    some = docs.select("doc_id", "text").join(F.broadcast(per_class[0].unionByName(per_class[1])), F.col("doc_id") == F.col("_id")).select("text", "toxic")  # TOXIC and `sequences` rows at most
    index = {f: i for i, (f, _) in enumerate(candidates)}
    held = some.mapInArrow(lambda batches: sequence_batches(batches, index), "n int, at array<int>, ids array<int>, toxic int").toArrow()
    length, toxic = held.column("n").to_numpy().astype(np.int64), held.column("toxic").to_numpy()
    at, ids = ([np.asarray(x, np.int64) for x in held.column(c).to_numpy()] for c in ("at", "ids"))
    kept = explain(candidates, [set(i.tolist()) for i, y in zip(ids, toxic, strict=True) if y])
    train = np.sort(np.concatenate([np.flatnonzero(toxic == 1)[:sequences], np.flatnonzero(toxic == 0)]))
    length, toxic, at, ids = length[train], toxic[train], [at[i] for i in train], [ids[i] for i in train]
    rank = np.full(len(candidates) + 1, -1)
    rank[kept] = np.arange(len(kept))
    keep = [rank[i] >= 0 for i in ids]
    at, ids = [a[k] for a, k in zip(at, keep, strict=True)], [rank[i[k]] for i, k in zip(ids, keep, strict=True)]
    weights, bias, trans, start = train_field(length, at, ids, toxic, len(kept))
    emission = np.full(int(length.sum()), bias)
    offsets = np.concatenate([[0], np.cumsum(length)])[:-1]
    for o, a, i in zip(offsets, at, ids, strict=True):
        np.add.at(emission, o + a, weights[i])
    p, _ = marginals(emission, length, trans, start)
    head = fit_head(summaries(p, length), toxic.astype(float))
    return Model({candidates[f][0]: float(w) for f, w in zip(kept, weights, strict=True)}, bias, trans, start, head)


def score_batches(batches, plain: tuple):
    """(doc_id, text) -> doc_id, score, spans: words with a marginal of a half or more."""
    model = Model(*plain)
    known, unmarked = Emissions(model), Plain(model)
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        lengths, marked, parts = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            emission = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            lengths[i] = len(words)
            if (emission != model.bias).any():
                marked.append(i)
                parts.append(emission)
        x = np.array([unmarked[n] for n in lengths.tolist()]).reshape(-1, 3)
        spans: list[list] = [[] for _ in texts]
        if marked:
            own = lengths[marked]
            p, _ = marginals(np.concatenate(parts), own, model.trans, model.start)
            x[marked] = summaries(p, own)
            for doc, q in zip(marked, np.split(p, np.cumsum(own)[:-1]), strict=True):
                if q.max() >= 0.5:
                    spans[doc] = [{"start": m.start(), "end": m.end(), "probability": float(w)} for m, w in zip(WORD.finditer(texts[doc]), q, strict=True) if w >= 0.5]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(logistic(x @ model.head), pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
            names=["doc_id", "score", "spans"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (start, end, probability), one row per document."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.plain())
    return docs.select("doc_id", "text").mapInArrow(lambda batches: score_batches(batches, held.value), "doc_id long, score double, spans array<struct<start:int,end:int,probability:double>>")


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder(F.col("doc_id")) != 0))
    scores = score(docs, model)
    return scores.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


ORACLE = None  # a trained model; tested on held-out labels
