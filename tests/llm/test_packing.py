"""Packing: ids against the tokenizer, sequences without gaps, and the reduction
and best fit against exhaustive and item-by-item packing."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import packing, queries

SF = "/root/testdata/sf0.01"
DOCS = "item_id long, document string, length string, `_row` string"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "len", "row") for k, t in rows], DOCS)


def check_layout(rows, capacity):
    """Rows (sequence_id, offset, length) fill sequences without gaps."""
    held = {}
    for sequence, offset, length in rows:
        held.setdefault(sequence, []).append((offset, length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


def item_by_item(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def fewest(lengths, capacity):
    """Sequences that a packing needs at least, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                at = rooms.index(r)
                go(i + 1, [*rooms[:at], r - lengths[i], *rooms[at + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_best_fit_equals_item_by_item():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(0, 60))]
        groups = packing.best_fit(dict(Counter(lengths)), capacity)
        rooms = sorted(
            capacity - sum(s * c for s, c in held) for many, held in groups for _ in range(many)
        )
        assert rooms == item_by_item(lengths, capacity)
        packed = Counter()
        for many, held in groups:
            for s, c in held:
                packed[s] += many * c
        assert packed == Counter(lengths)


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(4)
    kinds = Counter()
    for _ in range(700):
        capacity = rng.choice([12, 20, 31])
        least = rng.choice([1, capacity // 5, capacity // 4, capacity // 3])
        lengths = [rng.randint(max(1, least), capacity) for _ in range(rng.randrange(1, 10))]
        fixed, rest = packing.reduce_counts(dict(Counter(lengths)), capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert Counter(left) + Counter(
            {s: sum(t * c.count(s) for t, c in fixed) for s in set(lengths)}
        ) == Counter(lengths)
        assert all(sum(c) <= capacity for _, c in fixed)
        kinds.update(len(c) for _, c in fixed)
        assert sum(t for t, _ in fixed) + (fewest(left, capacity) if left else 0) == fewest(lengths, capacity)
    assert kinds[1] and kinds[2] and kinds[3]


def test_many_equal_pieces_are_fixed_at_once():
    fixed, rest = packing.reduce_counts({3000: 10**9, 1096: 10**9, 4096: 5}, 4096)
    assert sorted(fixed) == [(5, (4096,)), (10**9, (3000, 1096))] and not rest
    sequences, runs = packing.plan_sequences({2049: 10**9, 10: 3 * 10**9}, 4096)
    assert sequences == 10**9 and len(runs) < 10


def test_words_encode_as_whole_texts(spark):
    rng = random.Random(3)
    parts = ["a", "B", "'s", "don't", " ", "\n", "\x0b", "\x85", "　", "é", "é", "ß", "Σς", "語", "7",
             "12", "!?", "<|endoftext|>", "🎬", "\x00", "İ", "́", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    opened = packing.WordIds(packing.tokenizer_path())
    for _ in range(2):
        got = list(opened.encode([t.encode() for t in texts]))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain_ids(t)[:-1] for t in texts]


def test_full_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 3)
    opened = packing.WordIds(packing.tokenizer_path())
    for t in ("one two", "three four five one", "one six", "two seven eight"):
        (got,) = opened.encode([t.encode()])
        assert np.frombuffer(got, "<u4").tolist() == plain_ids(t)[:-1]
    assert len(opened.known) <= 3


@pytest.mark.parametrize("part", [packing.PART, 4])
def test_pieces_and_sequences_of_awkward_rows(spark, part):
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 7, 7, 7, 40, 63, 64, 65, 200])]
    rows += [(20, None), (21, ""), (None, "no key here"), (None, "no key here"), (5, "a key again"),
             (22, "x" * 3000), (23, "é" * 500), *[(30, "copies of one row")] * 40]
    df = docs_of(spark, rows).repartition(3)
    packed = packing.pack_documents(df, capacity=64, with_ids=True, part=part)
    got = packed.collect()
    pieces = []
    for k, t in rows:
        ids = plain_ids(t)
        for number, s in enumerate(range(0, len(ids), 64)):
            part_ids = ids[s : s + 64]
            crc = zlib.crc32(np.array(part_ids, "<u4").tobytes())
            pieces.append(repr((k, number, s, len(part_ids), crc, part_ids)))
    assert sorted(repr((*tuple(r)[:5], r.ids)) for r in got) == sorted(pieces)
    number = check_layout([(r.sequence_id, r.offset, r.length) for r in got], 64)
    lengths = [r.length for r in got]
    assert number <= len(item_by_item(lengths, 64)) and number >= -(-sum(lengths) // 64)
    whole = packing.packed_sequences(packed).collect()
    assert len(whole) == number and sum(r.length for r in whole) == sum(lengths)
    want = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        want.setdefault(r.sequence_id, []).extend(r.ids)
    assert {r.sequence_id: r.ids for r in whole} == want


def test_empty_table_and_column_names(spark):
    df = docs_of(spark, [(1, "some text")])
    assert packing.pack_documents(df.limit(0)).count() == 0
    named = df.select(F.col("item_id").cast("string").alias("the `id"), F.col("document").alias("a text"))
    row = packing.pack_documents(named, key="the `id", text="a text").first()
    assert row["the `id"] == "1" and (row.length, row.sequence_id, row.offset) == (3, 0, 0)


def test_query_packs_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_best_fit_packing"](spark, SF).collect()
    assert list(rows[0].asDict()) == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
    ]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for d, held in by_doc.items():
        ids = plain_ids(texts[d])
        total += len(ids)
        for number, r in enumerate(sorted(held, key=lambda r: r.piece)):
            part = ids[r.start : r.start + r.length]
            assert (r.piece, r.start, r.length) == (number, 4096 * number, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert sum(r.length for r in held) == len(ids)
    number = check_layout([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert number <= len(item_by_item([r.length for r in rows], 4096))
    assert -(-total // 4096) <= number <= -(-total // 4096) + 1


def test_words_are_encoded_without_a_search_for_cycles(monkeypatch):
    import gc

    import pyarrow as pa

    seen = []
    real = packing.WordIds.encode

    def encode(self, texts):
        seen.append(gc.isenabled())
        return real(self, texts)

    class Rows:
        def mapInArrow(self, run, shape):
            return run

    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", ""])], names=["_key", "_text"])
    monkeypatch.setattr(packing, "keyed_texts", lambda *_: Rows())
    monkeypatch.setattr(packing, "key_type", lambda _: "long")
    monkeypatch.setattr(packing.WordIds, "encode", encode)
    run = packing.cut_documents(None, "k", "t", 4, 1, packing.tokenizer_path(), False)
    (out,) = run(iter([docs]))
    assert out.column(0).to_pylist() == [1, 2] and out.column(3).to_pylist()[1] == 1
    # Off while words are cut, on again after it.
    assert seen == [False] and gc.isenabled()
