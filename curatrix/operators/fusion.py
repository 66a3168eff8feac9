"""Score fusion of vector, text and metadata signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import dot, match_share, minmax
from ..functions.text import lowered
from ..functions.understanding import keyword_preferences

# Share of each signal in the fused score.
SEMANTIC, TEXT, METADATA = 0.55, 0.25, 0.20
# Places kept of scores that decide an order.
DIGITS = 10


def metadata_match(i: Column) -> Column:
    """Mean match share over the preference lists given; 1 when none is."""
    prefs = {
        "genres": lowered(i["genres"]),
        "keywords": keyword_preferences(i),
        "cast": lowered(i["preferred_actors"]),
        "directors": lowered(i["preferred_directors"]),
    }
    total, signals = F.lit(0.0), F.lit(0)
    for column, wanted in prefs.items():
        total = total + match_share(F.col(column), wanted)
        signals = signals + (F.size(wanted) > 0).cast("int")
    return F.when(signals > 0, total / signals).otherwise(F.lit(1.0))


def with_cosine(pairs: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Add `semantic`: cosine of the (unit) vectors, 0 when either is absent."""
    return pairs.join(query_vectors, "query_id", "left").withColumn(
        "semantic", F.coalesce(dot(F.col("query_vector"), F.col("vector")), F.lit(0.0))
    )


def fuse(scored: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Add min-max norms per query and `fusion`. The bounds are a small
    aggregate joined back, not a window that would gather all candidates of a
    query in one task; they are given, as (query_id, n, s0, s1, b0, b1), where
    scored holds a part of the candidates only. Scores and norms are rounded to DIGITS places before
    anything is ranked by them: sums of doubles depend on the order in which a
    shuffle delivers them."""
    scored = scored.withColumns(
        {n: F.round(n, DIGITS) for n in ("semantic", "bm25", "metadata")}
    )
    if bounds is None:
        bounds = scored.groupBy("query_id").agg(
            F.count("*").alias("n"),
            F.min("semantic").alias("s0"),
            F.max("semantic").alias("s1"),
            F.min("bm25").alias("b0"),
            F.max("bm25").alias("b1"),
        )
    ends = [F.round(e, DIGITS).alias(f"_{e}") for e in ("s0", "s1", "b0", "b1")]
    bounds = bounds.select("query_id", F.col("n").alias("_n"), *ends)
    c = F.col
    return (
        scored.join(bounds, "query_id")
        .withColumn(
            "semantic_norm",
            F.round(minmax(c("semantic"), c("_s0"), c("_s1"), c("_n")), DIGITS),
        )
        .withColumn(
            "bm25_norm", F.round(minmax(c("bm25"), c("_b0"), c("_b1"), c("_n")), DIGITS)
        )
        .withColumn(
            "fusion",
            F.round(
                SEMANTIC * c("semantic_norm") + TEXT * c("bm25_norm") + METADATA * c("metadata"),
                DIGITS,
            ),
        )
        .drop("_n", "_s0", "_s1", "_b0", "_b1")
    )
