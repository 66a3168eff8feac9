"""Hybrid scores of a part of items against a block of queries at once: which
items a query's filter lets through, their cosines as one matrix product, their
BM25 from the words that queries ask for, and their metadata match.

Min-max norms need a query's bounds over everything it lets through, so blocks
are worked twice: for the bounds of each (part, query), then, with the bounds at
hand, for the rows of a part that can still be among a query's first k. No row
per (query, item) leaves a block unless all of them are asked for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scores import l2_normalise
from ..functions.text import lowered
from ..functions.understanding import keyword_preferences
from ..session import settle
from .bm25 import B, K1, document_frequency, query_terms, term_weights
from .filters import LISTS, NUMBERS, filter_demands, filter_fields
from .fusion import METADATA, SEMANTIC, TEXT, fuse
from .grouping import top_k
from .predicate_index import meet

# Preference lists of an intent and the item list each is matched with.
_PREFERENCES = ["genres", "keywords", "cast", "directors"]
# Fused scores closer than this are told apart by exact expressions only.
NEAR = 1e-7


def item_side(
    items: DataFrame, vectors: DataFrame, texts: DataFrame, terms: DataFrame
) -> DataFrame:
    """Filter fields, preference lists, unit vector and counts of asked words of
    every item with a vector. texts(item_id, words); terms(term) are all words
    that some query asks for: other words never leave their task."""
    unit = vectors.select("item_id", l2_normalise(F.col("vector")).alias("vector"))
    # Words of items that cannot be candidates are not counted.
    held = texts.join(unit.select("item_id"), "item_id", "left_semi")
    hits = (
        held.select("item_id", F.size("words").alias("doc_len"), F.explode("words").alias("term"))
        .join(terms, "term")
        .groupBy("item_id", "doc_len", "term")
        .agg(F.count("*").cast("int").alias("tf"))
        .groupBy("item_id", "doc_len")
        .agg(F.collect_list(F.struct("term", "tf")).alias("hits"))
    )
    lists = items.select(
        "item_id", *[lowered(F.col(c)).alias(f"have_{c}") for c in _PREFERENCES]
    )
    return (
        filter_fields(items)
        .join(lists, "item_id")
        .join(unit, "item_id")
        .join(hits, "item_id", "left")
    )


def query_side(
    queries: DataFrame, loosened: DataFrame | None, query_vectors: DataFrame, weights: DataFrame
) -> DataFrame:
    """(query_id, demands, want_..., query_vector, weights) of every query.
    Filters go by the loosened intents, all scores by those asked."""
    i = F.col("intent")
    wants = {
        "genres": lowered(i["genres"]), "keywords": keyword_preferences(i),
        "cast": lowered(i["preferred_actors"]), "directors": lowered(i["preferred_directors"]),
    }
    unit = query_vectors.select("query_id", l2_normalise(F.col("vector")).alias("query_vector"))
    asked = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("weights"))
    filtered = (queries if loosened is None else loosened).select(
        "query_id", filter_demands(i).alias("demands")
    )
    return (
        queries.select("query_id", *[w.alias(f"want_{n}") for n, w in wants.items()])
        .join(filtered, "query_id")
        .join(unit, "query_id", "left")
        .join(asked, "query_id", "left")
    )


def _flat(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if len(values) else np.zeros((rows, 0))


def _cosines(rows: pa.Table, asked: pa.Table) -> np.ndarray:
    """Inner products of unit vectors held in [-1, 1]; 0 without a query vector."""
    out = np.zeros((rows.num_rows, asked.num_rows))
    vectors = asked.column("query_vector").combine_chunks()
    given = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False))
    if len(given):
        out[:, given] = _flat(rows.column("vector"), rows.num_rows) @ _flat(
            pa.chunked_array([vectors.take(pa.array(given))]), len(given)
        ).T
    return np.clip(out, -1.0, 1.0)


def _posted(lists: list) -> dict:
    """value -> places of the lists that hold it."""
    out: dict = {}
    for place, values in enumerate(lists):
        for v in set(values or ()):
            out.setdefault(v, []).append(place)
    return {v: np.array(places) for v, places in out.items()}


def _texts(rows: pa.Table, asked: pa.Table, mean_length: float) -> np.ndarray:
    """BM25 of every (item, query); 0 without a common word."""
    out = np.zeros((rows.num_rows, asked.num_rows))
    posted: dict = {}
    for place, weights in enumerate(asked.column("weights").to_pylist()):
        for w in weights or ():
            at = posted.setdefault(w["term"], ([], []))
            at[0].append(place)
            at[1].append(w["weight"])
    posted = {t: (np.array(a), np.array(b)) for t, (a, b) in posted.items()}
    lengths = rows.column("doc_len").to_pylist()
    for i, hits in enumerate(rows.column("hits").to_pylist()):
        for h in hits or ():
            if h["term"] in posted:
                at, weight = posted[h["term"]]
                tf = h["tf"]
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean_length))
                out[i, at] += weight * gain
    return out


def _matches(rows: pa.Table, asked: pa.Table) -> np.ndarray:
    """Mean share of preferences that an item's lists meet, repeats counted; 1
    without any preference."""
    total = np.zeros((rows.num_rows, asked.num_rows))
    signals = np.zeros(asked.num_rows)
    for name in _PREFERENCES:
        wants = asked.column(f"want_{name}").to_pylist()
        sizes = np.array([len(w or ()) for w in wants], dtype=np.float64)
        signals += sizes > 0
        posted = _posted(wants)
        hits = np.zeros_like(total)
        for i, have in enumerate(rows.column(f"have_{name}").to_pylist()):
            for v in have or ():
                if v is not None and v in posted:
                    hits[i, posted[v]] += 1
        total += hits / np.maximum(sizes, 1.0)
    return np.where(signals > 0, total / np.maximum(signals, 1.0), 1.0)


def _bound_table(mean_length: float) -> Callable:
    def work(rows: pa.Table, asked: pa.Table, mask: np.ndarray) -> pa.Table:
        columns = {"query_id": asked.column("query_id"), "n": mask.sum(axis=0)}
        scores = {"s": _cosines(rows, asked), "b": _texts(rows, asked, mean_length)}
        for name, held in scores.items():
            columns[f"{name}0"] = np.where(mask, held, np.inf).min(axis=0)
            columns[f"{name}1"] = np.where(mask, held, -np.inf).max(axis=0)
        met = pa.array(np.flatnonzero(columns["n"]))
        return pa.table(
            {n: (c if n == "query_id" else pa.array(c)).take(met) for n, c in columns.items()}
        )

    return work


def _pick(fused: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of all that can be among the first k by (fused falling, id): rows
    clearly ahead of the k-th, and of each set of equal scores near it the k
    least ids."""
    if len(fused) <= k:
        return np.arange(len(fused))
    edge = np.partition(fused, len(fused) - k)[len(fused) - k]
    near = np.flatnonzero(np.abs(fused - edge) <= NEAR)
    ahead = np.flatnonzero(fused > edge + NEAR)
    if len(near) > k:
        order = near[np.lexsort((ids[near], *scores[:, near]))]
        held = scores[:, order]
        fresh = np.append(True, (held[:, 1:] != held[:, :-1]).any(axis=0))
        starts = np.flatnonzero(fresh)
        place = np.arange(len(order)) - starts[np.cumsum(fresh) - 1]
        near = order[place < k]
    return np.concatenate([ahead, near])


def _top_table(mean_length: float, k: int | None) -> Callable:
    """Scores of the pairs let through: all, or those among a part's first k."""

    def work(rows: pa.Table, asked: pa.Table, mask: np.ndarray) -> pa.Table:
        held = np.stack([_cosines(rows, asked), _texts(rows, asked, mean_length), _matches(rows, asked)])
        if k is None:
            item, query = np.nonzero(mask)
        else:
            ids = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)[1]
            low, high = (
                np.array([asked.column(f"{c}{side}").to_numpy() for c in "sb"]) for side in (0, 1)
            )
            width = high - low
            norm = (held[:2] - low[:, None]) / np.where(width > 0, width, 1.0)[:, None]
            norm = np.where((width > 0)[:, None], norm, 0.0)
            fused = SEMANTIC * norm[0] + TEXT * norm[1] + METADATA * held[2]
            picked = []
            for q in range(asked.num_rows):
                own = np.flatnonzero(mask[:, q])
                picked.append(own[_pick(fused[own, q], ids[own], held[:, own, q], k)])
            item = np.concatenate(picked)
            query = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
        return pa.table({
            "query_id": asked.column("query_id").take(pa.array(query)),
            "item_id": rows.column("item_id").take(pa.array(item)),
            **{n: pa.array(held[j, item, query]) for j, n in enumerate(("semantic", "bm25", "metadata"))},
        })

    return work


class HybridScores:
    """Prepared sides of a hybrid retrieval, each written once, and the ways to
    read them: all pairs, or the first k of every query."""

    def __init__(
        self, items: DataFrame, queries: DataFrame, loosened: DataFrame | None,
        vectors: DataFrame, query_vectors: DataFrame, texts: DataFrame, query_texts: DataFrame,
    ):
        """texts(item_id, words) of all items, query_texts(query_id, q)."""
        size = texts.agg(
            F.count("*").alias("n"), F.avg(F.size("words").cast("double")).alias("mean")
        ).first()
        self.mean_length = size["mean"] or 1.0
        once = texts.select("item_id", F.explode(F.array_distinct("words")).alias("term"))
        # Written once: the mean idf and the weights both read it.
        frequency = settle(document_frequency(once), "frequency")
        vocabulary = term_weights(frequency, F.lit(size["n"]).cast("long"))
        wanted = query_terms(query_texts, "q")
        weights = settle(
            vocabulary.join(wanted, "term").select(
                "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
            ),
            "weights",
        )
        terms = weights.select("term").distinct()
        self.items = settle(item_side(items, vectors, texts, terms), "items")
        self.queries = settle(query_side(queries, loosened, query_vectors, weights), "asked")
        kinds = dict(self.items.dtypes) | dict(self.queries.dtypes)
        self._ids = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}"
        self._query = f"query_id {kinds['query_id']}"
        self.intents = queries.select("query_id", "intent")

    def _meet(self, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
        return meet(self.items, queries, LISTS, NUMBERS, work, schema)

    def _pairs(self, queries: DataFrame, k: int | None) -> DataFrame:
        schema = f"{self._ids}, semantic double, bm25 double, metadata double"
        return self._meet(queries, _top_table(self.mean_length, k), schema)

    def pairs(self) -> DataFrame:
        """(query_id, item_id, semantic, bm25, metadata) of every pair let through."""
        return self._pairs(self.queries, None)

    def bounds(self) -> DataFrame:
        """(query_id, n, s0, s1, b0, b1): how many items a query lets through,
        and the least and largest semantic and text score among them."""
        schema = f"{self._query}, n long, s0 double, s1 double, b0 double, b1 double"
        parts = self._meet(self.queries, _bound_table(self.mean_length), schema)
        ends = [F.min(c).alias(c) if c.endswith("0") else F.max(c).alias(c) for c in ("s0", "s1", "b0", "b1")]
        return parts.groupBy("query_id").agg(F.sum("n").alias("n"), *ends)

    def top(self, k: int) -> DataFrame:
        """The first k of every query by fused score, `rank` added: rows of
        fuse() with query_id and item_id."""
        bounds = settle(self.bounds(), "bounds")
        found = self._pairs(self.queries.join(bounds, "query_id"), k)
        fused = fuse(found, bounds)
        return top_k(fused, ["query_id"], [F.desc("fusion"), F.asc("item_id")], k)
