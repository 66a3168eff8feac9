"""Approximate nearest item vectors by collision counting.

Every vector is projected on random lines; each line is a sorted array of
projections. A query opens a window around its own projection on each line and
widens it step by step (virtual rehashing: the width grows, nothing is hashed
again). Vectors falling into the windows of enough lines are verified with their
exact inner product; widening ends when enough of them have been verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import quoted

LINES = 64
# A vector is verified once it collides on this share of the lines.
COLLISIONS = 0.55
# Share of a segment verified before a query stops widening, and the least.
VERIFY, VERIFY_LEAST = 0.2, 400
# Vectors of a segment (places of up to 65,535 fit 16 bits), queries of a block.
SEGMENT, QUERY_BLOCK = 16_384, 4096
# First window, in standard deviations, and the factor of each widening.
FIRST, WIDEN = 0.35, 1.2
# Queries that tell the others of a block how wide a window to begin with.
SCOUTS = 24
SEED = 20


class Segment:
    """Sorted projections of one segment of vectors, and the place of every
    vector in each sorted array."""

    def __init__(self, vectors: np.ndarray, lift: np.ndarray, lines: int, seed: int):
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, lines))
        placed = (np.hstack([vectors, lift[:, None]]) @ self.lines).T
        order = np.argsort(placed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed, order, axis=1)
        self.kind = np.uint16 if len(vectors) < 1 << 16 else np.uint32
        self.place = np.empty(order.shape, dtype=self.kind)
        places = np.broadcast_to(np.arange(order.shape[1], dtype=self.kind), order.shape)
        np.put_along_axis(self.place, order, places, axis=1)

    def own(self, queries: np.ndarray) -> np.ndarray:
        """Projections of queries, one row per line."""
        return (np.hstack([queries, np.zeros((len(queries), 1))]) @ self.lines).T

    def windows(self, own: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(first place, size) of the window of each (line, query)."""
        pairs = list(zip(self.sorted, own, strict=True))
        low = np.array([np.searchsorted(s, o - half, "left") for s, o in pairs])
        high = np.array([np.searchsorted(s, o + half, "right") for s, o in pairs])
        return low, high - low

    def collisions(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many lines each vector of the segment collides on, for one query.
        A place below the window wraps round to a number beyond its size."""
        inside = (self.place - low.astype(self.kind)[:, None]) < size.astype(self.kind)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint16)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """A further component that makes all vectors equally long, so that the
    largest inner product is the least distance to a query that has zero there."""
    return np.sqrt(np.maximum(longest * longest - np.square(vectors).sum(axis=1), 0.0))


def nearest_in_segment(
    query_ids, queries, ids, vectors, longest, k, lines, share, verify, seed
):
    """(query id, id, inner product): up to k ids per query, exact products; of
    an id's vectors the best counts."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    # Directions of the queries decide the order; their lengths do not.
    norms = np.sqrt(np.square(queries).sum(axis=1, keepdims=True))
    asked = queries / norms * longest
    segment = Segment(vectors, lifted(vectors, longest), lines, seed)
    need = int(np.ceil(share * lines))
    enough = max(verify, k + 1)
    enough = min(enough, len(ids))
    # With repeated ids, enough vectors need not be enough ids.
    known = len(np.unique(ids))
    repeated, wanted = known < len(ids), min(k + 1, known)
    first = FIRST * max(float(segment.sorted.std()), 1e-12)
    own = segment.own(asked)
    out, halves = [], []

    def search(at: np.ndarray, half: float) -> None:
        """Widen the windows of some queries until each has enough."""
        while len(at):
            low, size = segment.windows(own[:, at], half)
            later = []
            for i, q in enumerate(at.tolist()):
                met = np.flatnonzero(segment.collisions(low[:, i], size[:, i]) >= need)
                few = len(met) < enough or (repeated and len(np.unique(ids[met])) < wanted)
                if few and (size[:, i] < len(ids)).any():
                    later.append(q)
                    continue
                halves.append(half)
                met = met[ids[met] != query_ids[q]]
                score = vectors[met] @ queries[q]
                best = np.lexsort((ids[met], -score))
                if repeated:
                    best = best[np.sort(np.unique(ids[met][best], return_index=True)[1])]
                best = best[:k]
                out.append((np.full(len(best), query_ids[q]), ids[met][best], score[best]))
            at, half = np.array(later, dtype=np.int64), half * WIDEN

    search(np.arange(min(SCOUTS, len(asked))), first)
    if len(asked) > SCOUTS:
        search(np.arange(SCOUTS, len(asked)), float(np.median(halves)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def usable_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(_key, _vec): vectors that are not null, not zero, and finite throughout,
    one per row; null keys are left out."""
    v = F.col("_vec")
    finite = F.forall(
        v,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return (
        table.select(
            quoted(key).cast("long").alias("_key"), quoted(vector).cast("array<double>").alias("_vec")
        )
        .where(F.col("_key").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(finite & F.exists(v, lambda x: x != 0))
    )


def nearest_by_collisions(
    queries: DataFrame,
    items: DataFrame,
    k: int = 20,
    query_key: str = "query_id",
    key: str = "item_id",
    vector: str = "vector",
    lines: int = LINES,
    share: float = COLLISIONS,
    verify: float = VERIFY,
    segment: int = SEGMENT,
    query_block: int = QUERY_BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_key, rank, key, score): the k item vectors of the largest inner
    product found for each query vector, an item of the query's own id left out;
    score is the exact product in double precision, ties go to the smaller key.

    Item vectors are dealt by a digest into segments of bounded size, each with
    its own sorted projections, and queries into bounded blocks; every block
    meets every segment in one task. A query verifies at least the share `verify`
    of a segment (VERIFY_LEAST vectors at least), in the order in which they reach
    the collision threshold, and no fewer than k + 1 where there are as many.
    Recall is measured by the tests; it grows with `verify`.

    Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part, nor do null keys; all vectors must be of one length. Rows of
    equal key and vector count once; of several vectors of an id, as query or
    item, the best pair counts, so an id has one rank. Empty tables give an empty
    result; further columns are left out."""
    asked = usable_vectors(queries, query_key, vector).distinct()
    rows = usable_vectors(items, key, vector).distinct()
    measured = rows.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x)).alias("square"),
    ).first()
    parts = max(1, -(-measured["n"] // segment))
    query_parts = max(1, -(-asked.count() // query_block))
    longest = float(np.sqrt(measured["square"] or 1.0)) or 1.0
    deal = lambda n: F.pmod(F.xxhash64("_key", "_vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("*", deal(parts).alias("s"), every(query_parts).alias("b"))
    left = asked.select("*", deal(query_parts).alias("b"), every(parts).alias("s"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            least = max(VERIFY_LEAST, int(verify * b.num_rows))
            found = nearest_in_segment(
                *_matrix(a), *_matrix(b), longest, k, lines, share, least, seed
            )
        return pa.table({"_query": found[0], "_key": found[1], "score": found[2]})

    found = (
        left.groupBy("s", "b")
        .cogroup(right.groupBy("s", "b"))
        .applyInArrow(meet, "_query long, _key long, score double")
        .groupBy("_query", "_key")
        .agg(F.max("score").alias("score"))
    )
    place = F.row_number().over(
        Window.partitionBy("_query").orderBy(F.desc("score"), F.asc("_key"))
    )
    return (
        found.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select(
            F.col("_query").alias(query_key), "rank", F.col("_key").alias(key), "score"
        )
    )


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("_key").to_numpy()
    flat = table.column("_vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)
