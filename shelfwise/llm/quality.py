"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. In a pair of a good and a bad
document the good one wins with the logistic probability of the score difference, so the
weights are learned by logistic loss on feature differences, without intercept. The threshold
is a quantile of the training scores: the share of bad documents among the training labels.
Scores are then mapped to 0..1 so that the threshold lies at ``cut``.

The fit takes a bounded sample of labelled rows (``max_labels``, by hash of the key) and at
most ``max_pairs`` pairs; everything else covers all rows. A document is scored from its text
alone, in one pass without a shuffle.

Defined cases: a null or empty text has the features of an empty text and gets a score; null
labels and null keys teach nothing; repeated labels count once each; without labels of both
kinds every score is the share of good labels (0.5 without any); input columns named like a
result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import put, utf8

MAX_LABELS = 20_000
MAX_PAIRS = 60_000
CUT = 0.3
RIDGE = 1e-3

# Byte classes whose shares are features.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?;:",
    "comma": b",",
    "shout": b"!",
    "bar": b"|",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "path": b"/\\_=@~^+-",
    "symbol": b"#$%&*",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "beyond": bytes(range(128, 256)),
}
_CLASS = np.zeros((256, len(BYTE_CLASSES)))
for _i, _members in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_members), _i] = 1.0


def features(body: bytes) -> np.ndarray:
    """Features of a whole text; all are shares, means or logarithms."""
    n = len(body)
    shares = (np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _CLASS) / max(n, 1)
    words = body.split()
    k = len(words)
    lines = [x for x in body.split(b"\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    return np.concatenate([
        shares,
        np.minimum(shares * 20, 1.0),
        [
            np.log1p(n), np.log1p(k), n / (k + 1.0),
            distinct / (k + 1.0), distinct / np.sqrt(k + 1.0), repeats / (k + 1.0),
            min(1.0, 20.0 * repeats / (k + 1.0)),
            len(set(lines)) / (len(lines) + 1.0), np.log1p(len(lines)), float(k == 0),
        ],
    ])


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(steepness * (weights . (features - mean) / scale - threshold) + logit(cut))"""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float
    steepness: float
    cut: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.steepness * (self.raw(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def pairwise_weights(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int = 7) -> np.ndarray:
    """Logistic loss on differences good - bad, by Newton steps with a small ridge."""
    draw = np.random.default_rng(seed)
    d = good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(15):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -40, 40)))
        slope = d.T @ p / pairs - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def fit_arrays(x: np.ndarray, good: np.ndarray, cut: float = CUT,
               max_pairs: int = MAX_PAIRS) -> QualityModel:
    """The model of a feature matrix and its labels."""
    dims = x.shape[1] if x.ndim == 2 else len(features(b""))
    if not len(x) or good.all() or not good.any():
        share = float(good.mean()) if len(x) else 0.5
        zero, one = np.zeros(dims), np.ones(dims)
        return QualityModel(zero, zero, one, 0.0, 1.0, cut, share)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    w = pairwise_weights(z[good], z[~good], max_pairs)
    s = z @ w
    threshold = float(np.quantile(s, 1.0 - good.mean()))
    base, y = np.log(cut / (1 - cut)), good.astype(float)

    def loss(k: float) -> float:
        p = 1.0 / (1.0 + np.exp(-np.clip(k * (s - threshold) + base, -40, 40)))
        return -float(np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))

    top = 30.0 / max(1e-9, float(np.abs(s - threshold).max()))  # no score rounds to 0 or 1
    steepness = min(np.geomspace(0.01 * top, top, 40), key=loss)
    return QualityModel(w, mean, scale, threshold, float(steepness), cut)


def fit_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
    label: str = "quality", max_labels: int = MAX_LABELS, max_pairs: int = MAX_PAIRS,
    cut: float = CUT,
) -> QualityModel:
    """Learn from labelled documents; the sample of labels has ``max_labels`` rows at most."""
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"))
    known = known.where("_key is not null and _label in (0, 1)")
    picked = known.orderBy(F.xxhash64("_key"), "_key", "_label").limit(max_labels)

    @F.pandas_udf("array<double>")
    def vectors(body: pd.Series) -> pd.Series:
        return pd.Series([features(b) for b in utf8(body)])

    joined = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(
        F.broadcast(picked), "_key")  # bounded: max_labels rows of two numbers
    # One row per label: of a repeated key, the text with the smallest hash.
    one = W.partitionBy("_key", "_label").orderBy(F.xxhash64("_text"))
    once = joined.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    rows = once.select("_label", vectors("_text").alias("x")).collect()
    x = np.array([r["x"] for r in rows], dtype=float)
    return fit_arrays(x, np.array([r["_label"] == 1 for r in rows], dtype=bool), cut, max_pairs)


def quality_score(model: QualityModel, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(body: pd.Series) -> pd.Series:
        rows = [features(b) for b in utf8(body)]
        return pd.Series(model.scores(np.array(rows)) if rows else [], dtype=float)

    return score(text)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """All rows with score and predicted (1 if the score reaches the cut)."""
    scored = put(docs, {"score": quality_score(model, F.col(f"`{text}`"))})
    return put(scored, {"predicted": (F.col("score") >= model.cut).cast("int")})
