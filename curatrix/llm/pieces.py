"""Sampled segmentation of item documents into the pieces of a SentencePiece
vocabulary, and lossless decoding.

All ways to cut a text into pieces form a lattice. A forward pass sums the
weights of all paths into every position; a backward pass then draws the last
piece of each position in proportion, from the end to the start. Draws come from
a hash of the row's key and the position, so a row is always cut the same way."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import blocks, key_type, keyed_texts, quoted

# Place of the public vocabulary; any other model file may be named.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Every path covers the same characters, so a factor per character leaves all
# probabilities alone; this one keeps the forward sums near one.
PER_CHARACTER = 3.5
# Factor of a character that no piece covers and that becomes bytes.
BARE = 1e-4
BLOCK = 700_000
# No piece crosses from other characters to a space, nor holds a line end, so
# the lattice falls apart at these places and words can be treated alike.
_WORDS = re.compile(" *[^ \n]+| +|\n")
_DENSE = 192
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces by id: the bytes that an id decodes to, its weight times the
    factor of its characters, and a trie over the characters."""

    decoded: list[bytes]
    factor: np.ndarray
    byte_id: np.ndarray
    classes: np.ndarray
    dense: np.ndarray
    sparse_keys: np.ndarray
    sparse_next: np.ndarray
    ends: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Vocabulary:
        """Read a model file. Its scores order the pieces by usefulness but
        are no probabilities; rank r gets the weight 1 / (r + 2.7) of Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain, byte_id = {}, np.full(256, -1)
        decoded, factor = [b""] * n, np.zeros(n, dtype=np.float32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                byte_id[value] = i
                decoded[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {i} holds a space after other characters")
                plain[text] = i
                decoded[i] = text.encode()
                factor[i] = np.exp(PER_CHARACTER * len(text)) / (max(0.0, -model.get_score(i)) + 2.7)
        if (byte_id < 0).any():
            raise ValueError("the vocabulary needs a piece for every byte")
        return cls._with_trie(plain, decoded, factor, byte_id)

    @classmethod
    def _with_trie(cls, plain, decoded, factor, byte_id) -> Vocabulary:
        counts: dict[str, int] = {}
        for p in plain:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        chars = sorted(counts, key=lambda c: (-counts[c], c))
        number = {c: i + 1 for i, c in enumerate(chars)}
        children: dict[tuple[int, int], int] = {}
        ends = [-1]
        for p, i in plain.items():
            node = 0
            for c in p:
                step = (node, number[c])
                if step not in children:
                    children[step] = len(ends)
                    ends.append(-1)
                node = children[step]
            ends[node] = i
        classes = np.zeros(0x110000, dtype=np.int16)
        classes[[ord(c) for c in chars]] = [number[c] for c in chars]
        dense = np.full((len(ends), _DENSE), -1, dtype=np.int32)
        rare = []
        for (node, c), to in children.items():
            if c < _DENSE:
                dense[node, c] = to
            else:
                rare.append((node << 16 | c, to))
        rare.sort()
        return cls(
            decoded, factor, byte_id, classes, dense,
            np.array([k for k, _ in rare] or [-1], dtype=np.int64),
            np.array([t for _, t in rare] or [-1], dtype=np.int32),
            np.array(ends, dtype=np.int32), max(map(len, plain)),
        )

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.dense[node, np.minimum(c, _DENSE - 1)]
        rare = np.flatnonzero(c >= _DENSE - 1)
        if len(rare):
            key = node[rare].astype(np.int64) << 16 | c[rare]
            at = np.minimum(np.searchsorted(self.sparse_keys, key), len(self.sparse_keys) - 1)
            found = np.where(self.sparse_keys[at] == key, self.sparse_next[at], -1)
            out[rare] = np.where(c[rare] >= _DENSE, found, out[rare])
        return out


class Lattice:
    """Forward pass over distinct words side by side, longest first.

    Cell (position p, word r) is stored at first[p] + r, so that the words alive
    at a position stand next to one another. share[cell, k] starts as the weight
    of the piece of k + 1 characters that ends there, or 0, and ends as the
    summed probability of the pieces of up to k + 1 characters."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        v = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[order] = np.arange(len(words))
        self.lengths = lengths
        longest = int(lengths.max())
        alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
        self.alive = alive
        self.first = np.cumsum(alive) - alive
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        place = np.repeat(np.arange(longest, dtype=np.int32), alive)
        rank = np.arange(len(code)) - self.first[place]
        code = code[(np.cumsum(lengths) - lengths)[order][rank] + place]
        classes = v.classes[code].astype(np.int64)
        self.piece = np.full((len(code), v.longest), -1, dtype=np.int32)
        self.share = np.zeros((len(code), v.longest), dtype=np.float32)
        room = lengths[order][rank] - place
        at = np.arange(len(code))
        node = np.zeros(len(code), dtype=np.int64)
        place, held = place.astype(np.int64), classes > 0
        for k in range(v.longest):
            at, node, place, rank, room = (x[held] for x in (at, node, place, rank, room))
            node = v.step(node, classes[at]).astype(np.int64)
            found = v.ends[node]
            hit = np.flatnonzero((node >= 0) & (found >= 0))
            self.piece[at[hit], k] = found[hit]
            self.share[at[hit], k] = v.factor[found[hit]]
            held = np.flatnonzero((node >= 0) & (room > k + 1))
            if not len(held):
                break
            node, place, rank, room = node[held], place[held] + 1, rank[held], room[held]
            at = self.first[place] + rank
            held = classes[at] > 0
        # Characters without a piece of their own fall back to bytes: their code
        # point, marked by a negative id.
        bare = np.flatnonzero(self.piece[:, 0] < 0)
        self.piece[bare, 0] = -2 - code[bare].astype(np.int32)
        self.share[bare, 0] = BARE
        self._forward()

    def _forward(self) -> None:
        width = self.share.shape[1]
        # Only the last `width` positions are ever needed.
        sums = [np.ones(int(self.alive[0]))]
        for end, n in enumerate(self.alive.tolist()):
            cell = slice(int(self.first[end]), int(self.first[end]) + n)
            total = np.zeros(n)
            parts = []
            for k in range(min(width, end + 1)):
                total = total + sums[-1 - k][:n] * self.share[cell, k]
                parts.append(total)
            for k, part in enumerate(parts):
                self.share[cell, k] = part / total
            if len(parts) < width:
                self.share[cell, len(parts) :] = 1.0
            sums = [*sums[-(width - 1) :], total]
            if end % width == width - 1:
                sums = [s[:n] / total for s in sums]

    def sample(
        self, word: np.ndarray, seeds: np.ndarray, base: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count per occurrence): one path for each occurrence of a word
        whose text starts at character `base` of its row."""
        rank, left = self.rank[word], self.lengths[word]
        live = np.arange(len(word))
        steps, counts = [], np.zeros(len(word), dtype=np.int64)
        while len(live):
            cell = self.first[left - 1] + rank
            u = _uniform(seeds, (base + left).astype(np.uint64))
            k = (self.share[cell] >= u[:, None]).argmax(axis=1)
            steps.append((live, self.piece[cell, k]))
            counts[live] += 1
            left = left - k - 1
            on = np.flatnonzero(left > 0)
            live, rank, left, seeds, base = (x[on] for x in (live, rank, left, seeds, base))
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        last = np.cumsum(counts) - 1
        for back, (at, found) in enumerate(steps):
            ids[last[at] - back] = found
        return ids, counts


def _uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a mixing function of seed and counter."""
    x = seed + counter * _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def encode_texts(
    vocabulary: Vocabulary, keys: list, texts: list[str], seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, ids per text)."""
    number: dict[str, int] = defaultdict(count().__next__)
    words, per_text = [], []
    for t in texts:
        found = _WORDS.findall(t)
        per_text.append(len(found))
        words += map(number.__getitem__, found)
    per_text = np.array(per_text, dtype=np.int64)
    if not words:
        return np.zeros(0, dtype=np.int32), per_text
    lattice = Lattice(vocabulary, list(number))
    word = np.fromiter(words, np.int64, len(words))
    seeds = np.array(
        [xxhash.xxh64_intdigest(str(k).encode(), seed) for k in keys], dtype=np.uint64
    )
    row = np.repeat(np.arange(len(texts)), per_text)
    sizes = lattice.lengths[word]
    base = np.cumsum(sizes) - sizes
    shift = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    ids, counts = lattice.sample(word, seeds[row], base - shift[row])
    ids, counts = _expanded(vocabulary, ids, counts)
    return ids, np.bincount(row, weights=counts, minlength=len(texts)).astype(np.int64)


def _expanded(v: Vocabulary, ids: np.ndarray, counts: np.ndarray):
    """Replace code points by the ids of their bytes."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, counts
    raw = [chr(-2 - int(i)).encode() for i in ids[bare].tolist()]
    repeat = np.ones(len(ids), dtype=np.int64)
    repeat[bare] = [len(r) for r in raw]
    out = np.repeat(ids, repeat)
    first = np.cumsum(repeat) - repeat
    at = np.concatenate([np.arange(s, s + len(r)) for s, r in zip(first[bare], raw, strict=True)])
    out[at] = v.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(owner, weights=repeat, minlength=len(counts)).astype(np.int64)


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text of an id sequence; bytes that form no UTF-8 are replaced."""
    return b"".join(map(vocabulary.decoded.__getitem__, ids)).decode(errors="replace")


def encode_documents(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    model_path: str = MODEL_PATH,
    seed: int = 0,
) -> DataFrame:
    """(key, pieces, lossless): one sampled segmentation per item document.

    pieces is the array of ids; lossless says that decoding them gave back the
    text, character by character, which holds for every text. Rows of equal key,
    text and seed are cut alike, wherever they are processed. Whole texts are
    cut, in blocks of bounded size; only the vocabulary is sent to the tasks. Null
    and empty texts give no pieces; rows with a null key share one seed; an empty
    table gives an empty one; further columns are left out."""
    docs = keyed_texts(items, key, text)
    sent = items.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for block in blocks(batches, BLOCK):
            texts = block.column(1).to_pylist()
            ids, counts = encode_texts(v, block.column(0).to_pylist(), texts, seed)
            ends = np.concatenate([[0], np.cumsum(counts)])
            same = [
                decode_ids(v, ids[a:b].tolist()) == t
                for a, b, t in zip(ends, ends[1:], texts, strict=False)
            ]
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), lists, pa.array(same, type=pa.bool_())],
                names=["_key", "pieces", "lossless"],
            )

    out = docs.mapInArrow(run, f"_key {key_type(docs)}, pieces array<int>, lossless boolean")
    return out.withColumnRenamed("_key", key)


def decode_documents(
    encoded: DataFrame,
    key: str = "item_id",
    pieces: str = "pieces",
    model_path: str = MODEL_PATH,
) -> DataFrame:
    """(key, document): the texts of piece arrays; null arrays give empty texts.
    Ids outside the vocabulary are an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path).decoded)
    rows = encoded.select(quoted(key).alias("_key"), quoted(pieces).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = sent.value
        for batch in batches:
            texts = [
                b"".join(map(decoded.__getitem__, ids or ())).decode(errors="replace")
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, type=pa.string())], names=["_key", "document"]
            )

    out = rows.mapInArrow(run, f"_key {key_type(rows)}, document string")
    return out.withColumnRenamed("_key", key)
