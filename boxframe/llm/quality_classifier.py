"""Quality classifier: naive Bayes support vectors on byte n-gram indicators.

Features are indicators of the hashed byte n-grams of a text and one indicator of how often its longer
n-grams recur. Each is scaled by its class log-count ratio; a linear hinge-loss model with L2
penalty is fitted to the scaled rows by dual coordinate descent. The driver fits it on a bounded sample of labelled rows
(MAX_TRAIN); scoring is one pass over all whole texts without a shuffle.

Defined results: null or empty texts have no n-grams and score by the recurrence feature alone; null doc_ids count as remainder 0,
which is not held out here; repeated rows score alike; without labels of both classes every score is 0.5; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BASE, grams, prefix
from .common import ship
from .labelled import remainder, sample

ship(__name__)

FOLDS, HELD = 3, 1
MAX_TRAIN = 6_000
BITS = 18
GRAMS = (3, 4)
#: N-grams this long recur only in texts that repeat themselves; their distinct share is cut into so many steps.
LONG, STEPS = 24, 20
COST, ROUNDS, SMOOTH = 1.0, 20, 1.0


def _grams(text: bytes) -> tuple[np.ndarray, int]:
    """Distinct hashed n-grams of a text and the step of its recurrence indicator."""
    data = np.frombuffer(text, np.uint8)
    found, step = [], STEPS
    if len(data) >= GRAMS[0]:
        wide = data.astype(np.uint64)
        for n in GRAMS:
            if len(data) >= n:
                code = np.zeros(len(data) - n + 1, np.uint64)
                for k in range(n):
                    code = code << np.uint64(8) | wide[k : len(data) - n + 1 + k]
                found.append((code + np.uint64(n)) * np.uint64(BASE) >> np.uint64(64 - BITS))
    ids = np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)
    if len(data) >= 2 * LONG:
        h = grams(prefix(data), LONG)
        step = int(STEPS * len(np.unique(h)) / len(h))
    return ids, step


def _row(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values: the n-grams have length 1 together, the recurrence indicator alone."""
    ids, step = _grams(text)
    values = np.full(len(ids) + 1, 1 / np.sqrt(max(1, len(ids))), np.float32)
    values[-1] = 1
    return np.append(ids, (1 << BITS) + step), values


class Model:
    """score(text) = sigmoid(slope * (weights . features + bias))."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float) -> None:
        self.weights, self.bias, self.slope = weights, bias, slope

    def score(self, text: bytes) -> float:
        ids, values = _row(text)
        return float(1 / (1 + np.exp(-self.slope * (self.weights[ids] @ values + self.bias))))


def fit(texts: list[bytes], y: np.ndarray) -> Model:
    """y in {0, 1}. Dual coordinate descent on rows scaled by log-count ratios, in a fixed random order."""
    size = (1 << BITS) + STEPS + 1
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 0.0, 1.0)
    rows = [_row(t) for t in texts]
    count = np.full((2, size), SMOOTH)
    for (ids, _), k in zip(rows, y, strict=True):
        count[k, ids] += 1
    ratio = np.log(count[1] / (2 * SMOOTH + np.sum(y == 1))) - np.log(count[0] / (2 * SMOOTH + np.sum(y == 0)))
    ratio = ratio.astype(np.float32)
    rows = [(ids, v * ratio[ids]) for ids, v in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    w, bias, alpha = np.zeros(size, np.float32), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(8)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            ids, v = rows[i]
            gradient = sign[i] * (float(w[ids] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[ids] += np.float32(step) * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Model(w * ratio, bias, 2.0)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Model:
    """Fits on at most ``bound`` labelled documents outside the held-out fold."""
    rows = sample(docs, labels.where(remainder(F.col("doc_id"), FOLDS) != HELD), "quality", bound, ["text"])
    return fit([t.encode() for t in rows.text], rows.label.to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
