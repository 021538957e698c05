"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents (P) and unlabelled text (U) teach the classifiers; a document labelled "not toxic" is unlabelled
text like any other. The class prior p is the share of positives among all judged documents. With it the risk of a scorer g under the sigmoid loss l is ::

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

where the second term stands for the unseen negatives and must not go below zero; where a batch takes it there, the step
goes the other way. Features are the presence of words and of word beginnings.

Defined cases: a null or empty text has no feature and scores by the intercept alone; repeated rows score alike; several
labels of one doc_id count as toxic if one of them does; without a toxic label (or without documents) every score is the
prior, 0 where there is none; extra columns stay, one called like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.shared import WORD_BYTES, annotated, utf8, written

RESULT = T.StructType([T.StructField("score", T.DoubleType())])
BEGINNINGS = (4, 5, 6)
HELD = 200_000  # features that a task counts before it hands its sums on


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that fits the classifiers, and their training. Counts of features cover all documents.

    Where many rows share an id or have none, the sample is cut at twice the sum of both bounds.
    """

    positives: int = 12_000  # labelled toxic documents, by a hash of their ids
    unlabelled: int = 30_000  # documents, by a hash of their ids
    features: int = 1_000  # of the model: the most telling of all that enough positives hold
    least_positives: int = 5  # documents of P that must hold a feature
    classifiers: int = 3
    steps: int = 400
    batch: int = 1_024
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


def features_of(text: bytes | None) -> set[bytes]:
    """The words of a text and the beginnings of its longer words."""
    if not text:
        return set()
    words = set(text.translate(WORD_BYTES).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update(w[:n] + b"-" for w in words if len(w) > n)
    return out


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    intercept: float

    def scorer(self):
        weights = dict(zip(self.vocabulary, self.weights.tolist()))
        known = frozenset(weights)

        def score(texts):
            sums = np.array([sum(sorted(weights[f] for f in known & features_of(t))) for t in texts]) + self.intercept
            return [(s,) for s in (1 / (1 + np.exp(-np.clip(sums, -40, 40)))).tolist()]

        return score


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [list(features_of(t)) for t in utf8(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, pa.list_(pa.binary()))], names=["n", "features"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sums():
        # the empty feature counts the documents
        return pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([docs, *counts.values()], pa.int64())], names=["feature", "n"])

    counts, docs = Counter(), 0
    for batch in batches:
        for text in utf8(batch.column(0)):
            docs += 1
            counts.update(features_of(text))
            if len(counts) > HELD:
                yield sums()
                counts, docs = Counter(), 0
    yield sums()


def _indices(vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for batch in batches:
        rows = [[known[f] for f in features_of(t) & known.keys()] for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "at"])


def fit(docs: DataFrame, labels: DataFrame, learn=None, settings: Settings = Settings()) -> Model | None:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both restricted to rows where ``learn`` holds."""
    sc = docs.sparkSession.sparkContext
    if learn is not None:
        docs, labels = docs.where(learn), labels.where(learn)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic") != 0).alias("positive"))
    n_judged, n_positive = judged.agg(F.count("*"), F.count_if("positive")).first()
    if not n_positive:
        return None
    prior = n_positive / n_judged
    drawn = F.xxhash64(F.lit(settings.seed), "doc_id")
    # at most settings.positives ids
    ids = F.broadcast(written(judged.where("positive").orderBy(drawn, "doc_id").limit(settings.positives).select("doc_id"), "positives"))
    positives = docs.join(ids, "doc_id")
    lists = positives.select("text").mapInArrow(_feature_lists, "n int, features array<binary>")
    lists = written(lists, "positive-features")
    held = lists.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("p")).where(F.col("p") >= settings.least_positives)
    n_p = lists.count()
    counted = docs.select("text").mapInArrow(_count, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counted = written(counted, "feature-counts")
    n_all = counted.where("feature = X''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary, start = _most_telling(held.join(counted, "feature"), n_p, n_all, settings.features)
    if not vocabulary:
        return None
    known = sc.broadcast(vocabulary)
    share = min(1.0, settings.unlabelled / max(n_all, 1))
    some = docs.where(F.pmod(drawn, F.lit(1 << 20)) < int(share * (1 << 20)) + (share < 1))
    pool = positives.select(F.lit(True).alias("positive"), "text").unionAll(some.select(F.lit(False), "text"))
    # the shares are of ids; rows that share an id, or have none, are bounded here
    sample = pool.mapInArrow(partial(_indices, known), "positive boolean, at array<int>").limit(2 * (settings.positives + settings.unlabelled)).toPandas()
    known.destroy()
    sample = sample.assign(at=[tuple(sorted(x)) for x in sample["at"]]).sort_values(["positive", "at"])
    x = np.zeros((len(sample), len(vocabulary)), np.uint8)
    for i, at in enumerate(sample["at"]):
        x[i, list(at)] = 1
    is_p = sample["positive"].to_numpy(bool)
    p, u = x[is_p], x[~is_p]
    # each classifier leaves out a part of P, which then shows how it rates positives that it has not seen
    part_p, part_u = np.arange(len(p)) % settings.classifiers, np.arange(len(u)) % settings.classifiers
    weights, intercepts, unseen_p, seen_u = [], [], [], []
    for i in range(settings.classifiers):
        w, b = _train(p[part_p != i] if len(p) > settings.classifiers else p, u, start, prior, settings, settings.seed + i)
        weights.append(w)
        intercepts.append(b)
        unseen_p.append(_sums(p[part_p == i], w) + b)
        seen_u.append(_sums(u[part_u == i], w) + b)
    slope, shift = _calibrate(np.concatenate(unseen_p), np.concatenate(seen_u), prior)
    return Model(vocabulary, slope * np.mean(weights, 0), float(slope * np.mean(intercepts) + shift))


def _most_telling(counts: DataFrame, n_p: int, n_all: int, most: int) -> tuple[dict[bytes, int], np.ndarray]:
    """The features (feature, p, n) with the largest difference of their shares in P and in all text, in standard errors, and
    where their weights start: half the logarithm of the shares' ratio, as a word also shows in its beginnings."""
    a, b = F.col("p") / F.lit(n_p), (F.col("n") + 0.5) / F.lit(n_all + 1)
    shares = counts.select("feature", a.alias("a"), b.alias("b"))
    z = (F.col("a") - F.col("b")) / F.sqrt(F.col("b") * (1 - F.least("b", F.lit(0.999))) / F.lit(n_p) + F.lit(1e-12))
    best = shares.orderBy(z.desc(), "feature").limit(most).collect()
    return {bytes(r.feature): k for k, r in enumerate(best)}, 0.5 * np.log(np.array([r.a / r.b for r in best]))


def _sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    parts = [x[i : i + 1024].astype(np.float32) @ w for i in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _train(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float, s: Settings, seed: int) -> tuple[np.ndarray, float]:
    """One linear classifier by Adam on mini-batches of the non-negative risk."""
    rng = np.random.default_rng(seed)
    b = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else 0.0
    state = [np.zeros(len(w) + 1), np.zeros(len(w) + 1)]
    if not len(u):
        return w, b
    for t in range(1, s.steps + 1):
        xp = p[rng.integers(0, len(p), min(s.batch // 2, len(p)))].astype(np.float32)
        xu = u[rng.integers(0, len(u), min(s.batch, len(u)))].astype(np.float32)
        gp, gu = 1 / (1 + np.exp(-(xp @ w + b))), 1 / (1 + np.exp(-(xu @ w + b)))
        slope_p, slope_u = gp * (1 - gp) / len(gp), gu * (1 - gu) / len(gu)
        # loss of a positive is 1 - g, of a negative g
        unseen = gu.mean() - prior * gp.mean()
        if unseen >= 0:
            cp, cu = -2 * prior * slope_p, slope_u
        else:
            cp, cu = prior * slope_p, -slope_u
        grad = np.append(xp.T @ cp + xu.T @ cu + s.decay * w, cp.sum() + cu.sum())
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        step = s.rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _calibrate(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that turn a sum into the log-odds of being toxic.

    Logistic regression from P and U alone: the unbiased risk is E_U[log(1 + exp(z))] - prior * E_P[z], convex in both.
    """
    if not len(p) or not len(u):
        return 1.0, 0.0
    slope, shift = 1.0, 0.0
    mean = np.array([p.mean(), 1.0]) * prior
    basis = np.stack([u, np.ones_like(u)], 1).astype(np.float64)
    for _ in range(50):
        g = 1 / (1 + np.exp(-np.clip(basis @ [slope, shift], -40, 40)))
        grad = basis.T @ g / len(u) - mean + 1e-3 * np.array([slope - 1, shift])
        hess = (basis * (g * (1 - g))[:, None]).T @ basis / len(u) + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, shift = max(slope - step[0], 0.1), shift - step[1]
    return float(slope), float(shift)


def scored(docs: DataFrame, model: Model | None, into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into.score`` in 0..1, higher where toxic is likelier."""
    if model is None:
        kept = docs.select(*[c for c in docs.columns if c != into])
        return kept.withColumn(into, F.struct(F.lit(0.0).alias("score")))
    return annotated(docs, "text", into, RESULT, Model.scorer, model)
