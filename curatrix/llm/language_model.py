"""Log-bilinear language model of item documents, trained by noise-contrastive
estimation.

Words get slots: the most frequent ones a slot each, all others a slot per
ending. The model predicts the slot of a word from the slots of the two words
before it; within a slot, words have the add-one share of their counts. So the
probabilities of all known words and of one unknown word per ending sum to one.
Slot probabilities are normalised exactly, by matrix products over all contexts."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import blocks, key_type, keyed_texts

# Fixed value: the end of a text as a word; no word holds white space.
END = " "
# Slots of single words and of endings; characters of an ending.
SINGLE, ENDINGS, SUFFIX = 896, 128, 3
SLOTS = SINGLE + ENDINGS
# Words whose counts are sent to the tasks, and the most bytes of one of them.
HEAD, HEAD_BYTES = 200_000, 64
# Distinct words a task holds before it hands its counts on.
HELD_WORDS = 200_000
DIMENSION, NOISE, BATCH, ROUNDS, RATE = 32, 32, 2048, 3, 0.1


def tokens(text: str) -> list[bytes]:
    """White-space words with A-Z in lower case."""
    return text.encode().lower().split()


def ending_slot(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-SUFFIX:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, c) over docs(_text): how often each word occurs, the end
    of a text included; counts merge in the tasks before they are shuffled."""

    def emit(held: Counter) -> pa.RecordBatch:
        words = list(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words, type=pa.binary()),
                pa.array([ending_slot(w) for w in words], type=pa.int32()),
                pa.array(list(held.values()), type=pa.int64()),
            ],
            names=["word", "ending", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for block in blocks(batches):
            texts = block.column(0).to_pylist()
            for t in texts:
                held.update(tokens(t))
            held[END.encode()] += len(texts)
            if len(held) > HELD_WORDS:
                yield emit(held)
                held = Counter()
        if held:
            yield emit(held)

    found = docs.select("_text").mapInArrow(run, "word binary, ending int, c long")
    return found.groupBy("word", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """Counts: all training tokens, distinct words, the most frequent words with
    their counts and slots, tokens and words of each slot."""

    total: int
    distinct: int
    head: dict[bytes, tuple[int, int]]
    slot_tokens: np.ndarray
    slot_words: np.ndarray

    @classmethod
    def gather(cls, counts: DataFrame, head: int = HEAD) -> Words:
        """Bring the head to the driver: words above a count chosen so that at
        most `head` words, of at most HEAD_BYTES bytes each, lie above it."""
        bins = (
            counts.groupBy(F.floor(F.log2("c") * 8).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("c").alias("least"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        held, least = 0, None
        for b in bins:
            if held + b["n"] > head:
                break
            held, least = held + b["n"], b["least"]
        top = (
            []
            if least is None
            else counts.where((F.col("c") >= least) & (F.octet_length("word") <= HEAD_BYTES)).collect()
        )
        top = sorted(((r["c"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
        slot_tokens, slot_words = np.zeros(SLOTS), np.zeros(SLOTS)
        for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
            slot_tokens[r["ending"]], slot_words[r["ending"]] = r["c"], r["n"]
        total, distinct = int(slot_tokens.sum()), int(slot_words.sum())
        words = {}
        for i, (c, w) in enumerate(top):
            slot = ending_slot(w)
            if i < SINGLE:
                slot_tokens[slot] -= c
                slot_words[slot] -= 1
                slot, slot_tokens[i], slot_words[i] = i, c, 1
            words[w] = (c, slot)
        return cls(total, distinct, words, slot_tokens, slot_words)

    def inner(self) -> np.ndarray:
        """Per slot, the log10 of what a word's count + 1 is divided by. A slot
        of an ending holds one unknown word too; a single word has its slot."""
        sizes = self.slot_tokens + self.slot_words + (np.arange(SLOTS) >= SINGLE)
        return np.log10(np.maximum(sizes, 1.0))

    def unigram(self) -> np.ndarray:
        share = self.slot_tokens + self.slot_words + 1.0
        return share / share.sum()


@dataclass
class Model:
    """read[s]: vector of slot s in a context (the last row stands before the
    text), scaled per place by near and far; write[s]: vector of a predicted
    slot; bias."""

    read: np.ndarray
    write: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 9) -> Model:
        rng = np.random.default_rng(seed)
        small = lambda n: (rng.standard_normal((n, DIMENSION)) * 0.1).astype(np.float32)
        one = np.ones(DIMENSION, dtype=np.float32)
        return cls(small(SLOTS + 1), small(SLOTS), one, one * 0.5, np.log(unigram).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.read, self.write, self.near, self.far, self.bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpacked(self, flat: np.ndarray) -> Model:
        sizes = np.cumsum([p.size for p in self.parts()])[:-1]
        new = np.split(flat.astype(np.float32), sizes)
        return Model(*(n.reshape(p.shape) for n, p in zip(new, self.parts(), strict=True)))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, bias, norm): the score of slot w after far slot a and
        near slot b is far[a, w] + near[b, w] + bias[w] - norm[a, b]; norm is
        the log of the sum over all slots, for every context."""
        near = (self.read * self.near) @ self.write.T
        far = (self.read * self.far) @ self.write.T
        norm = np.empty((SLOTS + 1, SLOTS + 1), dtype=np.float32)
        left = np.exp(near - near.max(axis=1, keepdims=True))
        grow = np.exp(far + self.bias - (far + self.bias).max(axis=1, keepdims=True))
        # exp(a + b) is a product, so all contexts are one matrix product.
        norm[:] = np.log(np.maximum(grow @ left.T, 1e-30))
        norm += (far + self.bias).max(axis=1, keepdims=True)
        norm += near.max(axis=1)[None, :]
        return near, far, self.bias, norm


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by number."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    held = at[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    out[held[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with one draw of noise slots per batch,
    shared by its tokens, and AdaGrad steps."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model, self.noise = model.unpacked(model.packed()), noise
        self.rng = np.random.default_rng(seed)
        self.past = [np.full(p.shape, 1e-3, dtype=np.float32) for p in self.model.parts()]

    def step(self, far: np.ndarray, near: np.ndarray, word: np.ndarray) -> None:
        m, n = self.model, len(word)
        a, b, own_write = m.read.take(far, 0), m.read.take(near, 0), m.write.take(word, 0)
        context = a * m.far + b * m.near
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        own = np.einsum("ij,ij->i", context, own_write) + (m.bias - log_noise).take(word)
        drawn = self.rng.choice(SLOTS, size=NOISE, p=self.noise)
        other = context @ m.write[drawn].T + (m.bias - log_noise)[drawn]
        up = 1.0 / (1.0 + np.exp(np.minimum(own, 30)))
        down = 1.0 / (1.0 + np.exp(-np.maximum(other, -30)))
        pull = up[:, None] * own_write - down @ m.write[drawn]
        write = _sums(word, up[:, None] * context, SLOTS)
        np.subtract.at(write, drawn, down.T @ context)
        bias = np.bincount(word, weights=up, minlength=SLOTS)
        np.subtract.at(bias, drawn, down.sum(axis=0))
        read = _sums(far, pull * m.far, SLOTS + 1) + _sums(near, pull * m.near, SLOTS + 1)
        slopes = [read, write, np.einsum("ij,ij->j", pull, b), np.einsum("ij,ij->j", pull, a), bias]
        for value, past, slope in zip(m.parts(), self.past, slopes, strict=True):
            slope = slope / np.float32(n)
            past += slope * slope
            value += (RATE * slope / np.sqrt(past)).astype(np.float32)


def _contexts(slots: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(far, near): the slots two and one before each, SLOTS before a text."""
    near = np.concatenate([[SLOTS], slots[:-1]])
    near[starts] = SLOTS
    far = np.concatenate([[SLOTS], near[:-1]])
    far[starts] = SLOTS
    return far, near


def train(docs: DataFrame, shard: Column, words: Words, rounds: int = ROUNDS) -> Model:
    """Train on all docs(_text): in each round, every task passes over its part
    of one shard, starting from the same model, and the results are averaged,
    weighted by tokens, first in a few tasks, then on the driver."""
    spark = docs.sparkSession
    noise = words.unigram()
    model = Model.start(noise)
    known = spark.sparkContext.broadcast({w: s for w, (_, s) in words.head.items()})
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((model, noise))

        def run(batches: Iterator[pa.RecordBatch], number=number, sent=sent) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(*sent.value, seed=number)
            slot_of = known.value
            seen, rest = 0, [np.zeros(0, np.int64)] * 3
            for block in blocks(batches):
                slots, starts = _slots(block.column(0).to_pylist(), slot_of)
                far, near = _contexts(slots, starts)
                rest = [np.concatenate(p) for p in zip(rest, (far, near, slots), strict=True)]
                whole = len(rest[0]) // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    trainer.step(*(r[at : at + BATCH] for r in rest))
                rest = [r[whole:] for r in rest]
                seen += len(slots)
            if len(rest[0]):
                trainer.step(*rest)
            if seen:
                yield _packed(trainer.model.packed().astype(np.float64) * seen, seen)

        part = docs.where(shard == number).select("_text")
        sums = part.mapInArrow(run, "sums binary, seen long")
        merged = sums.repartition(8).mapInArrow(_merge, "sums binary, seen long").collect()
        total = sum(r["seen"] for r in merged)
        if total:
            flat = sum(np.frombuffer(r["sums"], dtype=np.float64) for r in merged) / total
            model = model.unpacked(flat)
        sent.unpersist()
    return model


def _packed(sums: np.ndarray, seen: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([sums.tobytes()], type=pa.binary()), pa.array([seen], type=pa.int64())],
        names=["sums", "seen"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, seen = None, 0
    for batch in batches:
        for row in batch.to_pylist():
            one = np.frombuffer(row["sums"], dtype=np.float64)
            sums = one.copy() if sums is None else sums + one
            seen += row["seen"]
    if sums is not None:
        yield _packed(sums, seen)


def _slots(texts: list[str], slot_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all texts in a row, where each text starts)."""
    out: list[int] = []
    starts = []
    end = slot_of.get(END.encode(), ending_slot(END.encode()))
    for t in texts:
        starts.append(len(out))
        words = tokens(t)
        out += [
            ending_slot(w) if s is None else s
            for w, s in zip(words, map(slot_of.get, words), strict=True)
        ]
        out.append(end)
    return np.array(out, dtype=np.int64), np.array(starts, dtype=np.int64)


def _scored_heads(docs: DataFrame, words: Words, model: Model) -> DataFrame:
    """Per row of docs(_row, _key, _text): tokens, what is known from the head,
    and the words beyond it, with how often each occurs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((words.head, words.inner(), model.tables()))
    kind = key_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, inner, (near, far, bias, norm) = sent.value
        nothing = (0, -1)
        for block in blocks(batches):
            texts = block.column(2).to_pylist()
            counts, slots, starts, rest = [], [], [], []
            for t in texts:
                starts.append(len(slots))
                found = tokens(t)
                found.append(END.encode())
                beyond: Counter = Counter()
                for w in found:
                    c, s = head.get(w, nothing)
                    if s < 0:
                        s = ending_slot(w)
                        beyond[w] += 1
                    counts.append(c)
                    slots.append(s)
                rest.append(list(beyond.items()))
            starts = np.array(starts, dtype=np.int64)
            slots = np.array(slots, dtype=np.int64)
            counts = np.array(counts, dtype=np.int64)
            a, b = _contexts(slots, starts)
            chance = far[a, slots] + near[b, slots] + bias[slots] - norm[a, b]
            share = np.log10(counts + 1.0)
            add = lambda x: np.add.reduceat(x.astype(np.float64), starts)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    block.column(1),
                    pa.array(np.diff(np.append(starts, len(slots)))),
                    pa.array(add(counts > 0).astype(np.int64)),
                    pa.array(add(share)),
                    pa.array(add(chance) / np.log(10) + add(share - inner[slots])),
                    pa.array(
                        [[{"word": w, "n": n} for w, n in r] for r in rest],
                        type=pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])),
                    ),
                ],
                names=["_row", "_key", "tokens", "known", "share", "score", "rest"],
            )

    return docs.mapInArrow(
        run,
        f"_row long, _key {kind}, tokens long, known long, share double, score double, "
        "rest array<struct<word:binary,n:int>>",
    )


def score_texts(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    learn: Column | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) per item row.

    Words are white-space words with A-Z in lower case, then one end of text.
    base_score is the log10 probability under add-one word counts, score that
    under the log-bilinear model; both learn from the rows for which `learn` (a
    condition on the column _key, null meaning no) holds. n_known counts tokens
    seen in training, train_tokens all training tokens.

    Counts cover all training rows and are shuffled once. The frequent words, of
    bounded number and size, go to the tasks; all others meet their counts in a
    join, where none can be hot. Training passes over all rows, a shard of them
    per round, in parallel; models of fixed size are averaged. Null and empty
    texts are one end of text; null keys stay null and are not learnt from; without training
    rows every word is unknown; repeated rows are scored, and counted, each; an
    empty table gives an empty one; further columns are left out."""
    docs = keyed_texts(items, key, text)
    wanted = F.lit(True) if learn is None else learn
    part = docs.where(F.col("_key").isNotNull() & wanted)
    counts = settle(count_words(part), "word_counts")
    words = Words.gather(counts)
    shard = F.pmod(F.xxhash64("_key", F.lit("shard")), F.lit(rounds))
    model = train(part, shard, words, rounds)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "_key", "_text")
    # Written before it is used twice: row numbers must not be made anew.
    scored = settle(_scored_heads(rows, words, model), "scored")
    beyond = scored.select("_row", F.explode("rest").alias("r")).select("_row", "r.word", "r.n")
    rare = counts.select("word", "c")
    found = (
        beyond.join(rare, "word")
        .groupBy("_row")
        .agg(
            F.sum("n").alias("more"),
            F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("bonus"),
        )
    )
    size = float(np.log10(max(1.0, words.total + words.distinct + 1.0)))
    bonus = F.coalesce("bonus", F.lit(0.0))
    return scored.drop("rest").join(found, "_row", "left").select(
        F.col("_key").alias(key),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("share") + bonus - F.col("tokens") * F.lit(size)).alias("base_score"),
        (F.col("score") + bonus).alias("score"),
    )
