"""Toxic item documents: a linear classifier over character n-grams whose
features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, key_type, keyed_texts, labelled_sample

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
# Bounds of the rows a model is fitted on.
FIT_ROWS, FIT_CHARS = 4000, 16_000
# An n-gram seen in fewer fitted documents, or whose log-count ratio lies
# within this many standard errors of zero, has no say.
LEAST_DOCUMENTS, ERRORS = 3, 2.5
THRESHOLD = 0.3


class Grams:
    """Distinct hashed character n-grams of a text."""

    def __init__(self):
        self.mark = np.zeros(BUCKETS, dtype=bool)

    def of(self, text: str) -> np.ndarray:
        plain = " ".join(("", *text.lower().split(), ""))
        c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h *= np.uint32(0x01000193)
                h ^= c[i : len(c) - n + 1 + i]
            h *= np.uint32(0x9E3779B1)
            self.mark[h >> np.uint32(14)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """weight: the linear weights of the scaled features, already times the
    log-count ratio of their bucket; bias."""

    weight: np.ndarray
    bias: float

    def score(self, grams: np.ndarray) -> float:
        return float(_sigmoid(self.weight[grams].sum() + self.bias))


def fit(sample: list[tuple[str, int]], steps: int = 200, penalty: float = 3.0) -> Model:
    """Ratios and logistic weights of (text, 0 or 1) pairs. Without pairs of
    both classes every score is the smoothed share of class 1 (none: one half)."""
    grams = Grams()
    rows = [grams.of(t) for t, _ in sample]
    y = np.array([float(v > 0) for _, v in sample])
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    zero = np.zeros(BUCKETS, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Model(zero, bias)
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    one = np.bincount(at, weights=y[row], minlength=BUCKETS)
    both = np.bincount(at, minlength=BUCKETS)
    p, q = 1.0 + one, 1.0 + both - one
    ratio = np.log(p / (1.0 + y.sum())) - np.log(q / (1.0 + len(y) - y.sum()))
    ratio[(both < LEAST_DOCUMENTS) | (np.abs(ratio) < ERRORS * np.sqrt(1 / p + 1 / q))] = 0.0
    used = ratio[at] != 0
    at, row = at[used], row[used]
    x = ratio[at]
    names, at = np.unique(at, return_inverse=True)
    w = np.zeros(len(names) + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gap = _sigmoid(np.bincount(row, weights=x * w[at], minlength=len(rows)) + w[-1]) - y
        slope = np.bincount(at, weights=x * gap[row], minlength=len(names)) / len(y)
        slope = np.append(slope + penalty * w[:-1] / len(y), gap.mean())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        w -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    weight = zero.copy()
    weight[names] = w[:-1] * ratio[names]
    return Model(weight, float(w[-1]))


def score_toxicity(
    items: DataFrame,
    labels: DataFrame,
    key: str = "item_id",
    text: str = "document",
    label: str = "toxic",
    learn: Column | None = None,
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """(key, score, predicted): how likely each item document is toxic.

    The model is fitted on at most fit_rows labelled documents of at most
    fit_chars characters each, chosen by a digest of the key among the labels
    for which `learn` (a condition on the column _key) holds; every document is
    scored whole, by its distinct character n-grams. predicted is 1 from
    THRESHOLD on. Null and empty texts get the score of no evidence; null keys
    stay null; without usable labels all scores are one half; repeated rows give
    repeated results; an empty table gives an empty one; further columns are
    left out."""
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(items, labels, key, text, label, learn, fit_rows, fit_chars)
    sent = items.sparkSession.sparkContext.broadcast(fit(sample))
    docs = keyed_texts(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = sent.value, Grams()
        for block in blocks(batches):
            scores = np.array([model.score(grams.of(t)) for t in block.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["_key", "score", "predicted"],
            )

    out = docs.mapInArrow(run, f"_key {key_type(docs)}, score double, predicted int")
    return out.withColumnRenamed("_key", key)
