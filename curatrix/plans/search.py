"""Hybrid retrieval over tables of queries and items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.documents import query_search_text, search_text
from ..functions.text import tokens
from ..functions.understanding import pathway
from ..operators.block_scores import HybridScores
from ..operators.diversity import diversify
from ..operators.filters import relax
from ..operators.fusion import fuse
from ..operators.grouping import narrow_two_lists, top_k
from ..operators.lookups import reference_items
from ..operators.ranking import rank_candidates, with_weights
from ..schema import make_intent
from ..session import settle

# List lengths of the funnel stages and of the audit.
STAGE_1, STAGE_2_HEAD, STAGE_2, AUDIT = 50, 10, 15, 100


def hybrid_scores(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    loosened: DataFrame | None = None,
) -> HybridScores:
    """Scores of the items that pass each query's filter.

    Filters go by the loosened intents where they are given; scores always go
    by the intents as asked, so a genre that was dropped to find anything still
    counts in the text score and the metadata match.

    vectors(item_id, vector), query_vectors(query_id, vector). BM25 statistics
    come from all items; only items with a vector are candidates."""
    # Written first: what reads an intent then does not run the rules behind it.
    queries = settle(queries.select("query_id", "text", "intent"), "queries")
    texts = settle(items.select("item_id", tokens(search_text()).alias("words")), "words")
    asked = queries.select(
        "query_id", query_search_text(F.col("text"), F.col("intent")).alias("q")
    )
    return HybridScores(items, queries, loosened, vectors, query_vectors, texts, asked)


def score_pairs(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    loosened: DataFrame | None = None,
) -> DataFrame:
    """(query_id, item_id, semantic, bm25, metadata) of every pair that passes
    the filters."""
    return hybrid_scores(items, queries, vectors, query_vectors, loosened).pairs()


def retrieve(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    k: int = STAGE_1, limit: int = 50, relaxing: bool = True,
) -> DataFrame:
    """Top k per query by fused score, `rank` added. queries(query_id, text,
    intent); items carry item_id and the item columns."""
    loose = relax(items, queries, limit).drop("relax_level") if relaxing else None
    top = hybrid_scores(items, queries, vectors, query_vectors, loose).top(k)
    return items.join(top, "item_id").join(queries.select("query_id", "intent"), "query_id")


def reference_vectors(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, encoded: DataFrame
) -> DataFrame:
    """(query_id, vector): a similarity query searches with the vector of the
    item it names; every other query with its encoded text."""
    similar = queries.where(pathway(F.col("intent")) == "similarity")
    named = reference_items(items, similar, vectors).select("query_id", "item_id")
    own = named.join(vectors, "item_id").select("query_id", "vector")
    return own.unionByName(
        encoded.select("query_id", "vector").join(own.select("query_id"), "query_id", "left_anti")
    )


def funnel(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    limit: int = 10, relaxing: bool = True, first: int | None = None, second: int | None = None,
) -> DataFrame:
    """Three stages, first -> second -> limit: fused retrieval, narrowing by
    two lists, weighted ranking with diversity. The stages keep 50 and 15 rows
    per query, or limit where that is more, unless lengths are given. The
    original intent ranks."""
    first, second = first or max(STAGE_1, limit), second or max(STAGE_2, limit)
    stage_1 = retrieve(items, queries, vectors, query_vectors, first, limit, relaxing)
    # `first` rows per query.
    stage_1 = settle(stage_1, "stage")
    return rank_and_diversify(narrow_two_lists(stage_1, STAGE_2_HEAD, second), queries, limit)


def rank_and_diversify(short: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    weighted = with_weights(queries.select("query_id", "intent"))
    ranked = rank_candidates(short.drop("intent").join(weighted, "query_id"))
    # The second stage per query: one write saves ranking twice.
    ranked = settle(ranked, "ranked")
    final = diversify(ranked).where(F.col("position") <= limit)
    return ranked.join(final, ["query_id", "item_id"])


def semantic_search(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    limit: int = 10,
) -> DataFrame:
    """Retrieval with an empty intent: queries(query_id, text)."""
    plain = queries.withColumn("intent", make_intent())
    return retrieve(items, plain, vectors, query_vectors, limit, limit, relaxing=False)


def audit(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame,
    limit: int = 10, relaxing: bool = True,
) -> DataFrame:
    """(query_id, stage, position, item_id, score): the hundred best per
    signal and the lists of the three stages."""
    loose = relax(items, queries, limit).drop("relax_level") if relaxing else None
    fused = settle(fuse(score_pairs(items, queries, vectors, query_vectors, loose)), "audit")
    first, second = max(STAGE_1, limit), max(STAGE_2, limit)

    def stage(df, name, order, score, k):
        ranked = top_k(df, ["query_id"], [order, F.asc("item_id")], k, "position")
        return ranked.select(
            "query_id", F.lit(name).alias("stage"), "position", "item_id",
            F.round(F.col(score).cast("double"), 4).alias("score"),
        )

    top = top_k(fused, ["query_id"], [F.desc("fusion"), F.asc("item_id")], first)
    stage_1 = items.join(top, "item_id").join(queries.select("query_id", "intent"), "query_id")
    stage_1 = settle(stage_1, "stage")
    stage_2 = narrow_two_lists(stage_1, STAGE_2_HEAD, second)
    final = rank_and_diversify(stage_2, queries, limit)
    parts = [
        stage(fused, "metadata", F.desc("metadata"), "metadata", AUDIT),
        stage(fused, "semantic", F.desc("semantic"), "semantic", AUDIT),
        stage(fused, "bm25", F.desc("bm25_norm"), "bm25_norm", AUDIT),
        stage(stage_1, "stage_1", F.desc("fusion"), "fusion", first),
        stage(stage_2, "stage_2", F.asc("slot"), "semantic", second),
        stage(final, "stage_3", F.asc("position"), "score", limit),
    ]
    return reduce(DataFrame.unionByName, parts)


def signal_counts(scored: DataFrame) -> DataFrame:
    """Candidates and text hits per query."""
    return scored.groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("bm25") > 0).alias("bm25_hits")
    )
