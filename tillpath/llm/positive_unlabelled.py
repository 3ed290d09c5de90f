"""Quality classifier from positive and unlabelled texts.

Trusted positives are texts labelled good; the unlabelled texts are a sample of all documents that
no label names. Rows labelled bad are not used. A linear model over hashed n-grams minimises the
non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss; where the second term falls below zero its own gradient is climbed instead.
The score is one half where the same risk with the zero-one loss is least. The class prior is estimated first: a plain classifier of positives against
unlabelled texts ranks both, and the least ratio of unlabelled to positive texts above a threshold,
with a margin for the sample size, bounds the share of positives among the unlabelled.

The label table is read for rows of two of three folds by crc32(doc_id); the third is held out. The
fit uses a bounded sample (`text_features.SAMPLE_ROWS`); every row is scored.

Edge cases: NULL and empty texts are scored (their vectors are all zero). Without
any positive or any unlabelled row the score is the prior, one half. Repeated doc_ids are scored
as rows; NULL doc_ids are scored, held_out false. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import small, text_of
from tillpath.llm.text_features import SAMPLE_ROWS, SIZE, Adam, sample, scale, scaled, squash, vector

STEPS, RATE, DECAY = 300, 0.1, 1e-3
SEED = 17


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _weighed(x: np.ndarray) -> np.ndarray:
    return scaled(x) * np.float32(3)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return squash(_weighed(x) @ self.weights + self.bias)


def _plain_fit(x: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Scores of a balanced logistic fit of y on x, for ranking; by halves, each scored by the other."""
    order = np.random.default_rng(SEED).permutation(len(y))
    out = np.zeros(len(y))
    for part in (0, 1):
        train, test = order[part::2], order[1 - part :: 2]
        weight = np.where(y[train] == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum()))
        w, adam = np.zeros(x.shape[1]), Adam(x.shape[1], 0.05)
        for _ in range(rounds):
            error = (squash(x[train] @ w.astype(np.float32)) - y[train]) * weight
            adam.step(w, x[train].T @ error.astype(np.float32) + 1e-4 * w)
        out[test] = x[test] @ w.astype(np.float32)
    return out


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both.

    Above a low threshold nearly all positives remain while negatives fall away. The ratio of the
    shares that remain is at least the prior, up to sampling noise, at any threshold.
    """
    best = 1.0
    for threshold in np.quantile(positive, np.linspace(0.0, 0.9, 46)):
        p, u = (positive >= threshold).mean(), (unlabelled >= threshold).mean()
        margin = np.sqrt(1 / len(positive)) + np.sqrt(1 / len(unlabelled))
        best = min(best, (u + margin * 0.5 * np.sqrt(max(u * (1 - u), 1e-4))) / p)
    return float(np.clip(best, 0.01, 0.99))


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Non-negative risk, the part of it that stands for negatives, and the direction to step against.

    With the logistic loss: prior * mean loss(+) on positives, and what the unlabelled lose as negatives less what
    the share of positives among them would lose. Where that part falls below zero the step raises it again.
    """
    v = w[:-1].astype(np.float32)
    zp, zu = p @ v + w[-1], u @ v + w[-1]
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # Slopes of the three means: loss(+) on positives, loss(-) on positives and unlabelled.
    gp, gn, gu = (squash(zp) - 1) / len(p), squash(zp) / len(p), squash(zu) / len(u)
    on_p, on_u = (prior * (gp - gn), gu) if negative >= 0 else (prior * gn, -gu)
    slope = p.T @ on_p.astype(np.float32) + u.T @ on_u.astype(np.float32)
    whole = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    return float(whole), float(negative), np.append(slope, on_p.sum() + on_u.sum())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model of two samples of raw vectors."""
    if len(positive) == 0 or len(unlabelled) == 0:
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.5)
    # One array for both samples, which the parts below are views of.
    both = scale(np.concatenate([positive, unlabelled], dtype=np.float32))
    both *= np.float32(3)
    p, u = both[: len(positive)], both[len(positive) :]
    if prior is None:
        scores = _plain_fit(both, np.concatenate([np.ones(len(p)), np.zeros(len(u))]))
        prior = estimate_prior(scores[: len(p)], scores[len(p) :])
    w, adam = np.zeros(SIZE + 1), Adam(SIZE + 1, RATE)
    for step in range(STEPS):
        adam.rate = RATE * (1 - step / STEPS) + 1e-4
        _, _, slope = risk(p, u, w, prior)
        slope[:-1] += DECAY * w[:-1]
        adam.step(w, slope)
    v = w[:-1].astype(np.float32)
    return Model(v, -_least_risk(p @ v, u @ v, prior), prior)


def _least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The output at which the same risk with the zero-one loss is least, the highest if several are."""
    p, u = np.sort(positive), np.sort(unlabelled)
    bounds = np.unique(np.concatenate([p, u]))
    above_p, above_u = (1 - np.searchsorted(x, bounds) / len(x) for x in (p, u))
    risk = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    return float(bounds[np.flatnonzero(risk <= risk.min() + 1e-9)[-1]])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Fit on the folds that are not held out; `labels` has doc_id and quality."""
    known = labels.where(fold() != 1).select("doc_id", F.col("quality").alias("value"))
    positive, _ = sample(docs, known.where("value = 1"), most)
    free = docs.select("doc_id").where(fold() != 1).join(labels.select("doc_id"), "doc_id", "left_anti")
    unlabelled, _ = sample(docs, free.select("doc_id", F.lit(0).alias("value")), most)
    return fit(positive, unlabelled)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def batches(stream):
        for batch in small(stream):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            values = np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                values[at : at + 256] = model.score(np.stack([vector(t) for t in texts[at : at + 256]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, text_of().alias("text"))
    return plain.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, most))
