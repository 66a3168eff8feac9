"""Near-duplicate item documents: SimHash fingerprints linked through covering
locality-sensitive hashing.

Bit i of the 64 gets a vector of radius + 1 bits, none of them zero. For every
non-zero vector v a table keeps the bits whose vector has an odd product with
v. The at most `radius` bits in which two fingerprints differ span less than the
whole space, so some v is orthogonal to all of them, and in v's table the two
agree: no pair within the radius is missed, whatever the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import growing, settle
from .common import blocks, key_type, keyed_texts, quoted
from .components import least_reachable

BITS = 64
# Fixed value: seed of the shingle hash.
SEED = 42
# Fingerprints of one bucket compared in one task at a time.
CHUNK = 8192
_COPY = "_copy_number"


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of a text: letters A-Z in lower case, white-space words, shingles
    of `words` words with repeats, XXH64 of each; a bit is set if it is in over
    half of the hashes. Fewer words form one shingle; none give zero."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1)[:n].tolist()
    stops = (ends[min(words, len(tokens)) - 1 :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 8192):
        held = np.fromiter(
            (
                digest(line[a:b], SEED)
                for a, b in zip(starts[at : at + 8192], stops[at : at + 8192], strict=True)
            ),
            np.uint64,
        )
        bits = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(
    items: DataFrame, key: str = "item_id", text: str = "document", words: int = 4
) -> DataFrame:
    """(_key, _bits) with the fingerprint as a long, one row per item row."""
    docs = keyed_texts(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            bits = np.fromiter(
                (fingerprint(t, words) for t in block.column(1).to_pylist()), np.uint64
            )
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(bits.view(np.int64))], names=["_key", "_bits"]
            )

    return docs.mapInArrow(run, f"_key {key_type(docs)}, _bits long")


def covering_masks(radius: int) -> list[int]:
    """One mask per table, 2^(radius+1) - 1 of them, as unsigned numbers.

    The bits' vectors are spread so that every mask keeps about half of the
    bits (one keeps all for radius 6): all non-zero vectors in turn, or, where
    there are more vectors than bits, those with the leading bit set."""
    if not 0 <= radius <= 6:
        raise ValueError("64 bits are covered evenly up to a radius of 6")
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 if top < BITS else BITS + i for i in range(BITS)]
    return [
        sum(1 << i for i, v in enumerate(vectors) if (v & table).bit_count() % 2)
        for table in range(1, top + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(bits: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id) that connect all ids within the radius of one
    another, directly or through others of this chunk; fewer than ids."""
    order = np.argsort(ids)
    bits, ids = bits[order], ids[order]
    left = np.ones(len(ids), dtype=bool)
    out_a, out_b = [], []
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i] = False
        front = bits[i : i + 1]
        while len(front) and left.any():
            rest = np.flatnonzero(left)
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 256):
                open_ = np.flatnonzero(~near)
                if not len(open_):
                    break
                apart = np.bitwise_count(bits[rest[open_], None] ^ front[None, at : at + 256])
                near[open_] = (apart <= radius).any(axis=1)
            met = rest[near]
            left[met] = False
            out_a.append(ids[met])
            out_b.append(np.full(len(met), ids[i]))
            front = bits[met]
    if not out_a:
        return ids[:0], ids[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def near_links(prints: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of prints(_id long,
    _bits long) within `radius` differing bits; _bits are distinct.

    Every fingerprint goes to its bucket in each table. A bucket of up to
    `chunk` fingerprints is compared in one task; a larger one is cut into parts
    of half a chunk at most on average, and every two parts meet, so that no
    task holds more and no pair is missed. A task emits stars, never pairs."""
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col("_bits").bitwiseAND(F.lit(_signed(m))).alias("k"))
            for t, m in enumerate(covering_masks(radius))
        ]
    )
    # Every row becomes one per table, so few input files must not mean few tasks.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.repartition(parts, "_id")
    rows = spread.select("_id", "_bits", F.explode(tables).alias("_b")).select(
        "_id", "_bits", "_b.t", "_b.k"
    )
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    # Rows are exploded and weigh far more than Spark expects: neither side is broadcast.
    held = rows.join(growing(sizes), ["t", "k"])
    cuts = F.when(F.col("n") <= chunk, F.lit(1)).otherwise(
        F.ceil(F.col("n") / F.lit(chunk / 2)).cast("int")
    )
    own = F.pmod(F.xxhash64("_id"), cuts)
    met = held.withColumn("_o", F.explode(F.sequence(F.lit(0), (cuts - 1).cast("int"))))
    gathered = met.groupBy("t", "k", F.least(own, "_o").alias("p"), F.greatest(own, "_o").alias("q")).agg(
        F.collect_list(F.struct("_id", "_bits")).alias("held")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids = flat.field(0).to_numpy()
            bits = flat.field(1).to_numpy().view(np.uint64)
            found = [
                _stars(bits[a:b], ids[a:b], radius) for a, b in zip(at, at[1:], strict=False)
            ]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)],
                    names=["a", "b"],
                )

    return gathered.select("held").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    words: int = 4,
    radius: int = 4,
) -> DataFrame:
    """(key, fingerprint, component_id, links): one row per item row.

    fingerprint is the SimHash as 16 lower-case hex digits; component_id is the
    least key reachable over links of at most `radius` differing bits, the own
    key included; links counts the rows sharing exactly this fingerprint, the
    row itself included. Keys are numbers.

    Fingerprints are written once to the shared folder. Copies fold into one
    entry per distinct fingerprint before any search, so a group of copies of
    any size is one entry. Null and empty texts have fingerprint zero and are
    linked like any other; rows with a null key take part in no link and get the
    component of their fingerprint; repeated rows give repeated results; an empty
    table gives an empty one; further columns are left out."""
    prints = settle(fingerprints(items, key, text, words), "prints")
    folded = prints.groupBy("_bits").agg(
        F.min("_key").cast("long").alias("_id"), F.count("*").alias("links")
    )
    distinct = settle(folded, "folded")
    roots = least_reachable(near_links(distinct.where("_id is not null"), radius))
    named = distinct.join(growing(roots), distinct["_id"] == roots["node"], "left").select(
        "_bits", "links", F.coalesce("root", "_id").alias("component_id")
    )
    return prints.join(growing(named), "_bits", "left").select(
        F.col("_key").alias(key),
        F.lower(F.lpad(F.hex("_bits"), 16, "0")).alias("fingerprint"),
        "component_id",
        "links",
    )


def keep_representatives(
    items: DataFrame, key: str = "item_id", text: str = "document", **options
) -> DataFrame:
    """All columns of one row per group of near duplicates: the row with the
    least key, one of them where it is repeated. Rows with a null key stay."""
    found = near_duplicates(items, key, text, **options)
    kept = found.where(quoted(key) == F.col("component_id")).select(quoted(key)).distinct()
    named = items.where(quoted(key).isNotNull())
    # One row per key first: the limit by key works before the exchange too.
    copy = F.row_number().over(Window.partitionBy(quoted(key)).orderBy(F.lit(1)))
    single = named.withColumn(_COPY, copy).where(F.col(_COPY) == 1).drop(_COPY)
    return single.join(kept, key, "left_semi").unionByName(items.where(quoted(key).isNull()))
