"""Packing of tokenised item documents into sequences of a fixed capacity.

How many sequences a set of pieces needs depends on their lengths alone, and there
are at most `capacity` lengths, however many documents. Spark counts the pieces of
each length; the dominance reduction of Martello and Toth fixes sets of up to three
pieces that some optimal packing must hold, many equal sets at a time; best fit by
falling length packs what is left, again over counts. Pieces are then numbered
within their length and take the place that the plan has for that number."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .common import blocks, key_type, keyed_texts

CAPACITY = 4096
# Id that ends every document.
END = 1
# Pieces of one length numbered in one group.
PART = 65_536
# Words, and pre-tokens, whose ids a worker remembers.
WORDS = 800_000
_RANKS = 48


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, works word by word, drops
    white space and marks the last id of every pre-token by its end.

    Distinct white-space words are encoded once and remembered. An ASCII word is
    cut into its pre-tokens, which are remembered too; new ones go to the
    tokenizer's merges together and are told apart by their ends. Other words go
    to the whole tokenizer together, told apart by a mark that has one id. Words
    that hold the mark or a special token are encoded alone."""

    MARK = "\0"
    # Fixed value: the tokenizer's pre-tokens, as far as ASCII goes.
    _CUT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, path: str):
        # Spark gives every task its core; the library would take all of them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.mark = self._alone(self.MARK)
        if len(self.mark) != 4:
            raise ValueError("the tokenizer has no single id for the mark")
        # For pre-tokens that are cut and in lower case already.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _alone(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    @staticmethod
    def _ids(tokenizer, text: str) -> np.ndarray:
        (batch,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(batch.ids, dtype="<u4")

    @staticmethod
    def _runs(words: list[bytes], ids: np.ndarray, ends: list[int], gap: int) -> dict[bytes, bytes]:
        if len(ends) != len(words):
            raise ValueError("words and runs of ids differ in number")
        held, starts = ids.tobytes(), [0, *[e + gap for e in ends[:-1]]]
        return {w: held[4 * a : 4 * b] for w, a, b in zip(words, starts, ends, strict=True)}

    def _encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        plain, other, found = [], {}, {}
        for w in words:
            if w.isascii():
                plain.append(w)
            else:
                other[w] = w.decode("utf-8", "replace")
        joined = "\n".join(other.values())
        if any(s in joined for s in (self.MARK, *self.special)):
            for w, t in list(other.items()):
                if any(s in t for s in (self.MARK, *self.special)):
                    found[w] = self._alone(t)
                    del other[w]
        joined = b"\n".join(plain)
        if any(s.encode() in joined for s in self.special):
            for w in plain:
                if any(s.encode() in w for s in self.special):
                    found[w] = self._alone(w.decode())
            plain = [w for w in plain if w not in found]
        if other:
            ids = self._ids(self.whole, f" {self.MARK} ".join(other.values()))
            ends = np.flatnonzero(ids == np.frombuffer(self.mark, "<u4")[0])
            found |= self._runs(list(other), ids, [*ends.tolist(), len(ids)], 1)
        cuts = list(map(self._CUT.findall, map(bytes.lower, plain)))
        asked = list(set().union(*cuts))
        table = dict(zip(asked, map(self.parts.get, asked), strict=True))
        new = [p for p, ids in table.items() if ids is None]
        if new:
            ids = self._ids(self.merges, b" ".join(new).decode())
            fresh = self._runs(new, ids, (np.flatnonzero(self.ending[ids]) + 1).tolist(), 0)
            table.update(fresh)
            _remember(self.parts, fresh)
        at = table.__getitem__
        for w, cut in zip(plain, cuts, strict=True):
            found[w] = at(cut[0]) if len(cut) == 1 else b"".join(map(at, cut))
        return found

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of every text."""
        # ASCII white space only: all of it ends a word for the tokenizer too.
        split = [t.split() for t in texts]
        asked = list(set().union(*split))
        # A table of these texts' words alone is small enough to stay near.
        table = dict(zip(asked, map(self.known.get, asked), strict=True))
        new = {w for w, ids in table.items() if ids is None}
        if new:
            fresh = self._encode(new)
            table.update(fresh)
            _remember(self.known, fresh)
        for words in split:
            yield b"".join(map(table.__getitem__, words))


def _remember(known: dict, fresh: dict) -> None:
    """Fresh entries are remembered until there are WORDS; frequent ones come
    early."""
    if len(known) + len(fresh) <= WORDS:
        known.update(fresh)


_OPEN: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """A worker's tokenizer, opened once."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles within the block: millions of short lists of words
    set it off again and again, and none of them is in a cycle."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def cut_documents(
    items: DataFrame, key: str, text: str, capacity: int, end: int, path: str, with_ids: bool
) -> DataFrame:
    """(_key, piece, start, length, ids_crc32, _row[, ids]): every document's ids
    and the ending one, in pieces of at most `capacity`. _row tells rows of one
    task apart."""
    docs = keyed_texts(items, key, text)
    shape = f"_key {key_type(docs)}, piece int, start long, length int, ids_crc32 long, _row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, row = word_ids(path), 0
        last = np.array([end], dtype="<u4").tobytes()
        for block in blocks(batches):
            texts = block.column(1).cast(pa.binary(), safe=False).to_pylist()
            which, piece, start, length, crc, ids = [], [], [], [], [], []
            with _uncollected():
                encoded = list(opened.encode(texts))
            for at, held in enumerate(encoded):
                held += last
                total = len(held) // 4
                for number, s in enumerate(range(0, total, capacity)):
                    part = held[4 * s : 4 * (s + capacity)]
                    which.append(at)
                    piece.append(number)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            m = len(which)
            columns = [
                block.column(0).take(pa.array(which, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int32()),
                pa.array(crc, pa.int64()),
                pa.array(np.arange(row, row + m), pa.int64()),
            ]
            names = ["_key", "piece", "start", "length", "ids_crc32", "_row"]
            row += m
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, shape + (", ids array<int>" if with_ids else ""))


def _fixed_set(j: int, counts: dict[int, int], sizes: list[int], capacity: int) -> tuple[int, ...] | None:
    """Pieces, j among them, that some optimal packing has in one sequence: a
    feasible set whose pieces take the place of any other feasible set with j.
    sizes: the lengths still there, rising."""
    left = lambda s: counts[s] - (s == j)
    room = capacity - j
    light: list[int] = []
    for s in sizes:
        light += [s] * min(left(s), 3 - len(light))
        if len(light) == 3:
            break
    if not light or light[0] > room:
        return (j,)
    at = bisect_left(sizes, room + 1) - 1
    while not left(sizes[at]):
        at -= 1
    largest = sizes[at]
    if largest == room or len(light) < 2 or light[0] + light[1] > room:
        return (j, largest)
    if len(light) == 3 and sum(light) <= room:
        return None
    # Two further pieces at most: the pair of the largest sum that fits.
    best, low, high = (0, 0, 0), 0, at
    while low <= high:
        a, b = sizes[high], sizes[low]
        enough = left(a) and left(b) and (a != b or left(a) > 1)
        if a + b > room:
            high -= 1
            continue
        if enough and a + b > best[0]:
            best = (a + b, a, b)
        low += 1
    total, a, b = best
    if largest >= total:
        return (j, largest)
    if a != largest:
        return None
    # No pair may hold two pieces heavier than b.
    heavier: list[int] = []
    for s in sizes[bisect_left(sizes, b + 1) :]:
        heavier += [s] * min(left(s), 2 - len(heavier))
        if len(heavier) == 2:
            break
    if len(heavier) == 2 and sum(heavier) <= room:
        return None
    return (j, a, b)


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """(fixed, rest): fixed holds (times, set of lengths) whose sets are in some
    optimal packing of counts(length -> pieces); rest is what they leave. A set
    that is fixed once is fixed as often as its pieces last: taking pieces away
    leaves fewer sets to dominate."""
    counts = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(counts)
    fixed = []
    moved = True
    while moved:
        moved = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                chosen = _fixed_set(j, counts, sizes, capacity)
                if chosen is None:
                    break
                times = min(counts[s] // chosen.count(s) for s in chosen)
                fixed.append((times, chosen))
                moved = True
                for s in chosen:
                    counts[s] -= times
                    if not counts[s]:
                        del counts[s]
                        sizes.remove(s)
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, contents) by best fit over falling lengths; contents are
    (length, copies) in order. Equal sequences are kept as one entry."""
    # Sequences by the room they have left: [how many, contents as a chain].
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, many: int, contents: tuple) -> None:
        if not many:
            return
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((many, contents))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                full, over = divmod(n, per)
                put(capacity - per * size, full, (None, size, per))
                put(capacity - over * size, 1 if over else 0, (None, size, over))
                break
            room = rooms[at]
            many, contents = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            per = room // size
            full, over = divmod(n, per)
            full = min(full, many)
            put(room - per * size, full, (contents, size, per))
            n -= full * per
            if full < many:
                # Fewer than a whole sequence takes are left over.
                put(room - n * size, 1 if n else 0, (contents, size, n))
                put(room, many - full - (1 if n else 0), contents)
                n = 0
    out = []
    for held in by_room.values():
        for many, chain in held:
            contents = []
            while chain:
                chain, size, copies = chain
                contents.append((size, copies))
            out.append((many, contents[::-1]))
    return out


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[int, np.ndarray]:
    """(sequences, runs): run (length, first number, first sequence, copies a
    sequence, offset) places the pieces of a length from that number on."""
    fixed, rest = reduce_counts(counts, capacity)
    groups = [(times, [(s, 1) for s in chosen]) for times, chosen in fixed]
    groups += best_fit(rest, capacity)
    used = dict.fromkeys(counts, 0)
    runs, sequence = [], 0
    for many, contents in groups:
        offset = 0
        for size, copies in contents:
            runs.append((size, used[size], sequence, copies, offset))
            used[size] += many * copies
            offset += size * copies
        sequence += many
    return sequence, np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _numbered(pieces: DataFrame, part: int) -> DataFrame:
    """pieces with _number, from 0 within each length. A length of many pieces
    is dealt into groups of some `part`, which are numbered apart and shifted."""
    # At most one row per length of a piece.
    sizes = pieces.groupBy("length").agg(F.ceil(F.count("*") / F.lit(part)).alias("_cuts"))
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn(
        "_cut", F.pmod(F.xxhash64("_row", "_key", "piece"), "_cuts")
    )
    before = F.sum("_n").over(
        Window.partitionBy("length").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        dealt.groupBy("length", "_cut")
        .agg(F.count("*").alias("_n"))
        .select("length", "_cut", F.coalesce(before, F.lit(0)).alias("_shift"))
    )
    order = Window.partitionBy("length", "_cut").orderBy("_key", "piece", "ids_crc32", "_row")
    return (
        dealt.withColumn("_own", F.row_number().over(order))
        .join(shifts, ["length", "_cut"])
        .withColumn("_number", F.col("_shift") + F.col("_own") - 1)
        .drop("_cuts", "_cut", "_shift", "_own")
    )


def pack_documents(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    capacity: int = CAPACITY,
    end: int = END,
    path: str | None = None,
    with_ids: bool = False,
    part: int = PART,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one
    row per piece of an item document and its place in a training sequence.

    A document is its text's ids by the tokenizer file `path` and the id `end`;
    longer ones than `capacity` are cut into pieces of that length, the last one
    shorter, and no other is cut. start counts the document's ids before a piece,
    ids_crc32 is the CRC-32 of its ids as little-endian unsigned 32-bit numbers,
    offset its place in the sequence; sequences have no gaps and at most
    `capacity` ids, and are numbered from 0. with_ids adds the ids themselves.

    Sets that the dominance reduction fixes are optimal; the rest is best fit by
    falling length. Both work on the counts of the `capacity` possible lengths,
    the only thing gathered; runs of the plan go to the tasks as arrays.

    Null and empty texts are a document of the ending id alone; null and repeated
    keys and repeated rows are documents of their own; ties between pieces of one
    length change which piece takes which place, never the number of sequences;
    an empty table gives an empty one; further columns are left out. Pieces are
    written once to the shared folder, which fixes their numbering."""
    cut = cut_documents(items, key, text, capacity, end, path or tokenizer_path(), with_ids)
    pieces = settle(cut, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    _, runs = plan_sequences(counts, capacity)
    starts = (runs[:, 0] << _RANKS) + runs[:, 1]
    ranked = _numbered(pieces, part)
    columns = ["_key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy().astype(np.int64)
            number = batch.column(len(columns)).to_numpy()
            at = np.searchsorted(starts, (length << _RANKS) + number, "right") - 1
            _, first, sequence, copies, offset = runs[at].T
            step, copy = np.divmod(number - first, copies)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(columns)],
                    pa.array(sequence + step, pa.int64()),
                    pa.array(offset + copy * length, pa.int64()),
                ],
                names=[*columns, "sequence_id", "offset"],
            )

    shape = f"_key {key_type(pieces)}, piece int, start long, length int, ids_crc32 long"
    shape += (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    placed = ranked.select(*columns, "_number").mapInArrow(place, shape)
    return placed.select(
        F.col("_key").alias(key), "piece", "start", F.col("length").cast("long").alias("length"),
        "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []),
    )


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from the rows of pack_documents with ids. A
    sequence holds at most its capacity, so no group grows."""
    inner = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform("held", lambda h: h["ids"]))
    return (
        packed.groupBy("sequence_id")
        .agg(inner.alias("held"))
        .select("sequence_id", ids.alias("ids"))
        .select("sequence_id", F.size("ids").alias("length"), "ids")
    )
