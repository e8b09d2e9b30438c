"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed ones, of the word and of its first bytes. Filters of several widths slide over the words,
their maxima over the whole text feed a logistic unit. The first dimension of the embeddings starts as the class
log-odds of the hashed word; all parameters are then trained by AdaGrad, whose gradient flows only
through the positions of the maxima. Thresholds are calibrated by language on a part of the sample
that training leaves out; they never enter a score.

The driver trains on a bounded sample of labelled rows (MAX_TRAIN); scoring is one pass over all whole texts without
a shuffle.

Defined results: null and empty texts have no words and score by the logistic unit's bias alone; null doc_ids are held out;
a null or rare language uses the threshold of all; without labels of both classes every score is below 0.5; repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import prefix, spans
from .common import ship
from .labelled import remainder, sample

ship(__name__)

FOLDS, HELD = 5, 0
MAX_TRAIN = 12_000
#: Hash buckets, embedding size, filters of each width, bytes of a word's start that have an embedding of their own.
BUCKETS, SIZE, FILTERS, START = 1 << 17, 8, 8, 6
WIDTHS = (1, 2, 3)
EPOCHS, BATCH, RATE = 8, 64, 0.05
MIN_LANGUAGE = 100
PIECE = 1 << 20

_CLASS = np.zeros(256, np.uint8)  # the byte lower-cased if it is part of a word, else 0
_CLASS[0x30:0x3A] = np.arange(0x30, 0x3A)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def word_ids(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) hash buckets of the words and their starts, and the number of words of each text.

    ``data`` holds texts one after the other, each followed by a byte that is in no word; ``ends`` are the
    positions of these bytes.
    """
    low = _CLASS[data]
    inside = low != 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = prefix(low)
    whole = spans(p, start, end) >> np.uint64(64 - 17)
    first = (spans(p, start, np.minimum(end, start + START)) ^ np.uint64(0xA5A5 << 48)) >> np.uint64(64 - 17)
    return np.stack([whole, first]).astype(np.int32), np.diff(np.searchsorted(start, ends), prepend=0)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts]) - 1


class Net:
    """Embeddings E; for width k filters W[k] of shape (k, SIZE, FILTERS) and biases; logistic u, c."""

    def __init__(self, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        self.E = r.normal(0, 0.01, (BUCKETS + 1, SIZE)).astype(np.float32)
        self.E[BUCKETS] = 0  # what stands behind a text's last word
        self.W = [r.normal(0, 0.1, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.W:
            w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.3
        self.b = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.u = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.c = np.float32(-2.0)
        self.limits: dict[str, float] = {}
        self.limit = 0.5

    def convolve(self, ids: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Filter outputs at every word for each width, padded ids, the rows of words, and first rows of texts with words."""
        gap = max(WIDTHS) - 1
        rows = np.arange(ids.shape[1]) + gap * np.repeat(np.arange(len(counts)), counts)
        padded = np.full((2, ids.shape[1] + gap * (len(counts) + 1)), BUCKETS, np.int32)
        padded[:, rows] = ids
        x = self.E[padded[0]] + self.E[padded[1]]
        n = x.shape[0] - gap
        out = []
        for k, w in zip(WIDTHS, self.W, strict=True):
            y = x[:n] @ w[0]
            for j in range(1, k):
                y += x[j : n + j] @ w[j]
            out.append(y[rows])
        first = (np.cumsum(counts) - counts)[counts > 0]
        return out, padded, rows, first

    def pooled(self, conv: list[np.ndarray], counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = np.zeros((len(counts), len(WIDTHS), FILTERS), np.float32)
        if len(first):
            for k, y in enumerate(conv):
                h[counts > 0, k] = np.maximum(np.maximum.reduceat(y, first, axis=0) + self.b[k], 0)
        return h

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        conv, _, _, first = self.convolve(ids, counts)
        h = self.pooled(conv, counts, first).reshape(len(counts), -1)
        return 1 / (1 + np.exp(-(h @ self.u + self.c).astype(np.float64)))

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        """Whole texts, some at a time."""
        out, at = [], 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) < PIECE):
                n += len(texts[to])
                to += 1
            out.append(self.scores(*word_ids(*_joined(texts[at:to]))))
            at = to
        return np.concatenate(out) if out else np.zeros(0)


def fit(ids: list[np.ndarray], y: np.ndarray, seed: int = 9) -> Net:
    """ids: for each text the (2, words) buckets; y in {0, 1}."""
    net = Net(seed)
    if len(set(y.tolist())) < 2:
        net.c = np.float32(-1.0)
        return net
    seen = np.full((2, BUCKETS), 1.0)
    for x, k in zip(ids, y, strict=True):
        seen[k, np.unique(x)] += 1
    odds = np.log(seen[1] / (2 + np.sum(y == 1))) - np.log(seen[0] / (2 + np.sum(y == 0)))
    net.E[:BUCKETS, 0] = np.clip(odds, -1, 4) * np.minimum((seen[0] + seen[1] - 2) / 4, 1)
    past: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, g: np.ndarray, at=...) -> None:
        past.setdefault(name, np.full_like(value, 1e-4))
        past[name][at] += g * g
        value[at] -= RATE * g / np.sqrt(past[name][at])

    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = shuffled[at : at + BATCH]
            counts = np.array([ids[i].shape[1] for i in pick])
            conv, padded, rows, first = net.convolve(np.concatenate([ids[i] for i in pick], axis=1), counts)
            h = net.pooled(conv, counts, first)
            p = 1 / (1 + np.exp(-(h.reshape(len(pick), -1) @ net.u + net.c)))
            d = ((p - y[pick]) / len(pick)).astype(np.float32)
            dh = (d[:, None] * net.u).reshape(h.shape) * (h > 0)
            step("u", net.u, h.reshape(len(pick), -1).T @ d)
            net.c -= np.float32(RATE * d.sum())
            owner = np.repeat(np.arange(len(pick)), counts)
            for k, y_k in enumerate(conv):
                g_w, g_e = np.zeros_like(net.W[k]), {}
                for f in range(FILTERS):
                    live = np.flatnonzero(dh[:, k, f])
                    if not len(live):
                        continue
                    top = np.flatnonzero(y_k[:, f] + net.b[k, f] == h[owner, k, f])
                    text, one = np.unique(owner[top], return_index=True)
                    top = top[one][np.isin(text, live)]
                    g = dh[owner[top], k, f]
                    for j in range(WIDTHS[k]):
                        for side in (0, 1):
                            e = padded[side, rows[top] + j]
                            g_w[j, :, f] += net.E[e].T @ g
                            g_e.setdefault((j, side), []).append((e, g[:, None] * net.W[k][j, :, f]))
                step(f"W{k}", net.W[k], g_w)
                step(f"b{k}", net.b[k], dh[:, k].sum(axis=0))
                if parts := [x for v in g_e.values() for x in v]:
                    e, at_e = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
                    total = np.zeros((len(e), SIZE), np.float32)
                    np.add.at(total, at_e, np.concatenate([x[1] for x in parts]))
                    total[e == BUCKETS] = 0
                    step("E", net.E, total, e)
    return net


def best_limit(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the highest F1, in the middle between the scores around it; 0.5 without positives."""
    if not y.any():
        return 0.5
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = score[order][k + 1] if k + 1 < len(y) else 0.0
    return float((score[order][k] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Net:
    """Trains on four fifths of at most ``bound`` labelled documents outside the held-out fold, calibrates on the rest."""
    rows = sample(docs, labels.where(remainder(F.col("doc_id"), FOLDS) != HELD), "toxic", bound, ["text", "lang"])
    y = rows.label.to_numpy(np.int64)
    ids = [word_ids(*_joined([t.encode()]))[0] for t in rows.text]
    apart = np.arange(len(y)) % 5 == 4
    net = fit([x for x, a in zip(ids, apart, strict=True) if not a], y[~apart])
    if apart.any():
        s = np.concatenate([net.scores(x, np.array([x.shape[1]])) for x, a in zip(ids, apart, strict=True) if a])
        # The unit's bias moves so that the best threshold over all languages is 0.5.
        at = min(max(best_limit(s, y[apart]), 0.02), 0.98)
        shift = np.log(at / (1 - at))
        net.c -= np.float32(shift)
        s = 1 / (1 + np.exp(shift) * (1 / np.maximum(s, 1e-300) - 1))
        lang = rows.lang[apart].to_numpy()
        for k in {x for x in lang if x is not None}:
            if np.sum(lang == k) >= MIN_LANGUAGE:
                net.limits[k] = best_limit(s[lang == k], y[apart][lang == k])
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted (at 0.5) and flagged (at the language's threshold) for every row."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score_texts([(t.as_py() or "").encode() for t in b.column("text")])
            limit = [net.limits.get(k.as_py(), net.limit) for k in b.column("lang")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array(s >= np.array(limit, float))], ["doc_id", "held_out", "score", "flagged"])

    rows = docs.select("doc_id", "text", "lang", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, flagged boolean")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
