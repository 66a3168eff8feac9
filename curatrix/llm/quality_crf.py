"""Quality of item documents: a linear-chain conditional random field labels
every line good or bad from features of the line and of its neighbours; the
length-weighted forward-backward marginals make the document's quality."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, key_type, keyed_texts, labelled_texts

# Bounds of a group of labelled rows that one task fits a model on: rows,
# characters of a row on average, and lines.
FIT_ROWS, FIT_CHARS, FIT_LINES = 4000, 16_000, 400_000
THRESHOLD = 0.5
# Rounds in which the lines of bad documents are labelled anew.
ROUNDS = 3

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[128:] = 1  # bytes of letters beyond ASCII count as letters
for _c in range(256):
    if chr(_c).isascii():
        _CLASS[_c] = (
            2 if chr(_c).isupper() else 1 if chr(_c).isalpha() else 3 if chr(_c).isdigit()
            else 4 if chr(_c).isspace() else 5
        )
OWN = 11
WIDTH = 1 + 2 * OWN + 2 * OWN


def line_table(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that hold more than white space."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, OWN)), np.zeros(0)
    raw = [x.encode() for x in lines]
    sizes = np.array([len(r) for r in raw])
    kinds = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lower, upper, digit, space, mark = (
        np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (1, 2, 3, 4, 5)
    )
    seen: dict[bytes, int] = {}
    words_of, seen_before = [], []
    for r in raw:
        words = r.split()
        words_of.append(
            (len(words), len(set(words)), sum(map(operator.eq, words, words[1:])))
        )
        seen_before.append(seen.get(r, 0) > 0)
        seen[r] = 1
    words, distinct, repeats = np.array(words_of, dtype=float).T
    words = np.maximum(words, 1)
    letters = np.maximum(lower + upper, 1)
    table = np.stack(
        [
            np.log1p(sizes) / 5,
            (lower + upper) / sizes,
            upper / letters,
            digit / sizes,
            space / sizes,
            mark / sizes,
            np.minimum(mark / words, 6) / 3,
            distinct / words,
            repeats / words,
            np.minimum(sizes / words, 40) / 20,
            np.array(seen_before, dtype=float),
        ],
        axis=1,
    )
    return table, np.array([len(x) for x in lines], dtype=float)


def observations(table: np.ndarray) -> np.ndarray:
    """Features of every line with those of the line before and after; at the
    edges the line stands for its neighbour."""
    before = np.concatenate([table[:1], table[:-1]])
    after = np.concatenate([table[1:], table[-1:]])
    return np.concatenate(
        [np.ones((len(table), 1)), table, table * table, before, after], axis=1
    )


class Chains:
    """Chains of different lengths side by side, longest first. Step t holds
    one entry for each chain longer than t."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.steps = int(lengths.max()) if len(lengths) else 0
        # Number of chains alive at each step.
        self.alive = np.searchsorted(-self.lengths, -np.arange(self.steps), "left")

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.alive[t]] + t


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(
    emit: np.ndarray, move: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains: label probabilities of every line,
    the expected transitions in all, and the log normaliser of each chain."""
    chains = Chains(lengths)
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    for t in range(chains.steps):
        at = chains.at(t)
        ahead[at] = emit[at]
        if t:
            ahead[at] += _log_sum(ahead[at - 1][:, :, None] + move[None], 1)
    for t in range(chains.steps - 2, -1, -1):
        at = chains.at(t + 1)
        behind[at - 1] = _log_sum(move[None] + (emit[at] + behind[at])[:, None, :], 2)
    total = np.zeros(len(lengths))
    held = lengths > 0
    total[held] = _log_sum(ahead[np.cumsum(lengths)[held] - 1], 1)
    per_line = np.repeat(total, lengths)
    single = np.exp(ahead + behind - per_line[:, None])
    later = np.ones(len(emit), dtype=bool)
    later[(np.cumsum(lengths) - lengths)[held]] = False
    later = np.flatnonzero(later)
    pairs = np.exp(
        ahead[later - 1][:, :, None]
        + move[None]
        + (emit[later] + behind[later])[:, None, :]
        - per_line[later][:, None, None]
    )
    return single, pairs.sum(axis=0), total


@dataclass
class Model:
    """Line weights and transitions (label 1: good), and the slope and bias
    that turn a document's good share into a probability."""

    weights: np.ndarray
    move: np.ndarray
    slope: float
    bias: float

    def good(self, seen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(seen):
            return np.zeros(0)
        return marginals(seen @ self.weights, self.move, lengths)[0][:, 1]

    def score(self, texts: list[str]) -> np.ndarray:
        tables = [line_table(t) for t in texts]
        lengths = np.array([len(t) for t, _ in tables], dtype=np.int64)
        seen = [observations(t) for t, _ in tables if len(t)]
        good = self.good(np.concatenate(seen) if seen else np.zeros((0, WIDTH)), lengths)
        return self.of_share(good_share(good, [w for _, w in tables]))

    def of_share(self, share: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * _stretch(share) + self.bias)))


def _stretch(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def good_share(good: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities; without lines, half."""
    lengths = np.array([len(w) for w in weights], dtype=np.int64)
    if not lengths.sum():
        return np.full(len(weights), 0.5)
    flat = np.concatenate(weights)
    doc = np.repeat(np.arange(len(weights)), lengths)
    top = np.bincount(doc, weights=good * flat, minlength=len(weights))
    all_ = np.bincount(doc, weights=flat, minlength=len(weights))
    return np.where(all_ > 0, top / np.maximum(all_, 1e-12), 0.5)


class _Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.n, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, slope):
        self.n += 1
        self.m = 0.9 * self.m + 0.1 * slope
        self.v = 0.99 * self.v + 0.01 * slope * slope
        return self.rate * (self.m / (1 - 0.9**self.n)) / (
            np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-9
        )


def _fit_chains(seen, lengths, label, weights, move, steps, penalty=1e-4):
    """Gradient steps on the likelihood of one label per line."""
    n = len(seen)
    first = np.zeros(n, dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    later = np.flatnonzero(~first)
    counted = np.zeros((2, 2))
    np.add.at(counted, (label[later - 1], label[later]), 1.0)
    target = np.eye(2)[label]
    a, b = _Adam(weights.shape, 0.1), _Adam(move.shape, 0.1)
    for _ in range(steps):
        single, pairs, _total = marginals(seen @ weights, move, lengths)
        weights = weights - a.step(seen.T @ (single - target) / n + penalty * weights)
        move = move - b.step((pairs - counted) / n + penalty * move)
    return weights, move


def _prior(good: int, n: int) -> Model:
    """Every document scores the smoothed share of class 1."""
    share = (good + 0.5) / (n + 1.0)
    return Model(np.zeros((WIDTH, 2)), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))


def fit(sample: list[tuple[str, int]], rounds: int = ROUNDS, steps: int = 60) -> Model:
    """Model of (text, 0 or 1) pairs. Lines carry no label of their own: those
    of good documents count as good; those of bad ones start as bad, and in
    every further round a line there is bad only if the model says so, at least
    the worst one. Without pairs of both classes every score is the smoothed
    share of class 1 (none: one half)."""
    tables = [(line_table(t), int(v > 0)) for t, v in sample]
    tables = [(t, w, v) for (t, w), v in tables if len(t)]
    y = np.array([v for _, _, v in tables])
    weights, move = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    if not len(y) or y.min() == y.max():
        return _prior(int(y.sum()), len(y))
    lengths = np.array([len(t) for t, _, _ in tables], dtype=np.int64)
    seen = np.concatenate([observations(t) for t, _, _ in tables])
    doc = np.repeat(np.arange(len(y)), lengths)
    label = y[doc]
    for _ in range(rounds):
        weights, move = _fit_chains(seen, lengths, label, weights, move, steps)
        good = marginals(seen @ weights, move, lengths)[0][:, 1]
        worst = np.full(len(y), 2.0)
        np.minimum.at(worst, doc, good)
        label = np.where((y[doc] == 0) & ((good < 0.5) | (good <= worst[doc])), 0, 1)
    model = Model(weights, move, 1.0, 0.0)
    share = _stretch(good_share(good, [w for _, w, _ in tables]))
    x = np.stack([share, np.ones(len(y))], axis=1)
    p, adam = np.array([1.0, 0.0]), _Adam(2, 0.05)
    for _ in range(600):
        p = p - adam.step(x.T @ (1 / (1 + np.exp(-x @ p)) - y) / len(y))
    model.slope, model.bias = float(p[0]), float(p[1])
    return model


def score_quality(
    items: DataFrame,
    labels: DataFrame,
    key: str = "item_id",
    text: str = "document",
    label: str = "quality",
    learn: Column | None = None,
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """(key, score, predicted): how likely each item document is of good quality.

    The field is fitted on all labelled documents, whole, in groups of about
    fit_rows documents and fit_rows * fit_chars characters at most; the weights
    are the mean of the groups'. Labels count for which `learn` (a condition on
    the column _key) holds; every document is scored whole. predicted is 1 from
    THRESHOLD on. Null, empty and blank texts have no line: their good share is
    one half, and the score what that share means; null keys stay null; without
    usable labels all scores are one half; repeated rows give repeated results; an
    empty table gives an empty one; further columns are left out."""
    docs = keyed_texts(items, key, text)
    model = fitted_quality(items, labels, key, text, label, learn, fit_rows, fit_chars)
    sent = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            scores = sent.value.score(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["_key", "score", "predicted"],
            )

    out = docs.mapInArrow(run, f"_key {key_type(docs)}, score double, predicted int")
    return out.withColumnRenamed("_key", key)


def fitted_quality(items, labels, key, text, label, learn, fit_rows, fit_chars) -> Model:
    """Model of all labelled documents. Groups of them, dealt by a digest of the
    key and bounded by rows, characters and lines, are fitted side by side; the
    driver receives one row of weights per group and takes their mean by
    documents. A group without documents of both classes, or without lines, says
    nothing about the weights; where all are such, the shares of all count."""
    learn = F.lit(True) if learn is None else learn
    held = labelled_texts(items, labels, key, text, label, learn)
    lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    size = held.agg(F.count("*"), F.sum(F.length("_text").cast("long")), F.sum(lines.cast("long"))).first()
    if not size[0]:
        return fit([])
    bounds = (fit_rows, fit_rows * fit_chars, FIT_LINES)
    groups = max(-(-n // most) for n, most in zip(size, bounds, strict=True))
    dealt = held.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups))).repartition(groups, "_group")
    # Of several texts of a key the one with the least digest counts.
    one = F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text")
    single = dealt.groupBy("_group", "_key").agg(one, F.max("_label").alias("_label"))
    found = single.groupBy("_group").applyInArrow(
        _fit_group(), "n long, good long, both boolean, weights array<double>"
    )
    rows = sorted(found.collect(), key=lambda r: (r["n"], r["weights"]))
    mixed = [r for r in rows if r["both"]]
    if not mixed:
        return _prior(sum(r["good"] for r in rows), sum(r["n"] for r in rows))
    mean = np.average([r["weights"] for r in mixed], axis=0, weights=[r["n"] for r in mixed])
    at = WIDTH * 2
    return Model(mean[:at].reshape(WIDTH, 2), mean[at : at + 4].reshape(2, 2), *mean[at + 4 :].tolist())


def _fit_group() -> Callable[[pa.Table], pa.Table]:
    def work(group: pa.Table) -> pa.Table:
        rows = group.select(["_key", "_text", "_label"]).sort_by("_key")
        sample = list(zip(rows.column("_text").to_pylist(), rows.column("_label").to_pylist(), strict=True))
        own = [int(v > 0) for t, v in sample if t and not t.isspace()]
        model = fit(sample)
        weights = np.concatenate([model.weights.ravel(), model.move.ravel(), [model.slope, model.bias]])
        return pa.table({
            "n": [len(own)], "good": [sum(own)], "both": [0 < sum(own) < len(own)],
            "weights": pa.array([weights.tolist()], pa.list_(pa.float64())),
        })

    return work


def keep_good(
    items: DataFrame,
    labels: DataFrame,
    key: str = "item_id",
    text: str = "document",
    label: str = "quality",
    learn: Column | None = None,
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
) -> DataFrame:
    """All rows and columns of the items whose document is predicted good."""
    model = fitted_quality(items, labels, key, text, label, learn, fit_rows, fit_chars)
    sent = items.sparkSession.sparkContext.broadcast(model)
    at = items.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(batch.num_rows)), batch.column(at).fill_null("")],
                names=["row", "_text"],
            )
            scores = [sent.value.score(b.column(1).to_pylist()) for b in blocks(iter([texts]))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= THRESHOLD))

    return items.mapInArrow(run, items.schema)
