"""Whole answers: from query texts and intents to ranked, diverse lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.documents import query_document
from ..functions.scores import l2_normalise
from ..functions.understanding import pathway
from ..operators.filters import strict_candidates
from ..operators.fusion import with_cosine
from ..operators.grouping import top_k
from ..session import settle
from .assembly import CAST_FILMS, POOL, candidate_pool, first_cut
from .embedding import Encoder, encode_texts, hashing_encoder
from .search import STAGE_2, funnel, rank_and_diversify, reference_vectors

# Fixed value: films per actor when a query accepts nothing but its people.
STRICT_CAST_FILMS = 60


def encode_queries(
    queries: DataFrame, factory: Callable[[], Encoder] = hashing_encoder
) -> DataFrame:
    """(query_id, vector) of queries(query_id, text, intent): the encoder sees
    the text with the genres, themes, moods and keywords of its intent."""
    texts = queries.select(
        "query_id", query_document(F.col("text"), F.col("intent")).alias("document")
    )
    return encode_texts(texts, "query_id", "document", factory)


def search_vectors(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, encoded: DataFrame
) -> DataFrame:
    """(query_id, vector) written once: the named item's vector for a similarity
    query, the encoded text for all others."""
    return settle(reference_vectors(items, queries, vectors, encoded), "query_vectors")


def answer(
    items: DataFrame, queries: DataFrame, vectors: DataFrame,
    encoded: DataFrame | None = None, limit: int = 10,
) -> DataFrame:
    """The search funnel over queries(query_id, text, intent), each searching
    with the vector that its pathway asks for. vectors and encoded must come
    from one encoder; without encoded, texts go through the default one."""
    encoded = encode_queries(queries) if encoded is None else encoded
    asked = search_vectors(items, queries, vectors, encoded)
    return funnel(items, queries, vectors, asked, limit)


def shortlist(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    cut: int = POOL, keep: int = STAGE_2,
) -> DataFrame:
    """Candidate rows with `semantic`, `waived` and `slot`: candidates gathered
    from all sources, strict constraints (waived for a query of which none
    passes), the `cut` best by popularity x rating, of these the `keep` nearest
    to the query vector. Items without a vector count as distance one."""
    i = F.col("intent")
    strict = pathway(i, strict_last=True) == "strict_person"
    asked = settle(queries.select("query_id", "text", "intent"), "queries")
    pools = [
        candidate_pool(items, asked.where(~strict), vectors, cast_films=CAST_FILMS, pool=cut),
        candidate_pool(items, asked.where(strict), vectors, cast_films=STRICT_CAST_FILMS, pool=cut),
    ]
    # At most `cut` rows per query from here on.
    pool = settle(pools[0].unionByName(pools[1]).select("query_id", "item_id"), "pool")
    pairs = items.join(pool, "item_id").join(asked.select("query_id", "intent"), "query_id")
    best = first_cut(strict_candidates(pairs), cut).drop("rank")
    unit = vectors.select("item_id", l2_normalise(F.col("vector")).alias("vector"))
    near = query_vectors.select("query_id", l2_normalise(F.col("vector")).alias("query_vector"))
    scored = with_cosine(best.join(unit, "item_id", "left"), near)
    scored = scored.withColumn("semantic", F.round("semantic", 10)).drop("vector", "query_vector")
    return top_k(scored, ["query_id"], [F.desc("semantic"), F.asc("item_id")], keep, "slot")


def recommend(
    items: DataFrame, queries: DataFrame, vectors: DataFrame,
    encoded: DataFrame | None = None, limit: int = 10,
) -> DataFrame:
    """Recommendations for queries(query_id, text, intent): the shortlist,
    ranked by weighted scores and made diverse, `limit` per query."""
    encoded = encode_queries(queries) if encoded is None else encoded
    asked = search_vectors(items, queries, vectors, encoded)
    short = shortlist(items, queries, vectors, asked, keep=max(STAGE_2, limit))
    return rank_and_diversify(settle(short, "shortlist"), queries, limit)
