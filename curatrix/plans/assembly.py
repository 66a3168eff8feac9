"""Candidate assembly from several sources of the item table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import canonical_genres, empty_if_null
from ..operators.filters import discover
from ..operators.grouping import first_wins, top_k
from ..operators.lookups import filmography, reference_items
from ..schema import with_intent
from ..session import lookup_join

# List lengths per source.
CAST_FILMS, POOL, STUDIO_FILMS = 40, 50, 20


def collection_members(items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, item_id): every item of the collections of the seed items."""
    named = items.select("item_id", "collection_name").where(F.col("collection_name").isNotNull())
    asked = seeds.join(named, "item_id").select("query_id", "collection_name").distinct()
    return lookup_join(named, asked, ["collection_name"], spread_by="item_id").select(
        "query_id", "item_id"
    )


def enrich_from_reference(
    items: DataFrame, queries: DataFrame, vectors: DataFrame, keywords: int | None = None
) -> DataFrame:
    """Queries that name an item take over its genres, keywords (all, or the
    first few), directors and collection."""
    words = empty_if_null(F.col("keywords"))
    ref = reference_items(items, queries, vectors).select("query_id", "item_id")
    about = ref.join(
        items.select(
            "item_id",
            canonical_genres(F.col("genres")).alias("_g"),
            (words if keywords is None else F.slice(words, 1, keywords)).alias("_k"),
            empty_if_null(F.col("directors")).alias("_d"),
            F.filter(F.array("collection_name"), lambda c: c.isNotNull()).alias("_c"),
        ),
        "item_id",
    ).drop("item_id")
    i = F.col("intent")

    def plus(field: str, extra: str):
        more = empty_if_null(F.col(extra))
        return F.concat(i[field], F.array_except(more, i[field]))

    return queries.join(about, "query_id", "left").withColumn(
        "intent",
        with_intent(
            i,
            genres=plus("genres", "_g"),
            keywords=plus("keywords", "_k"),
            preferred_directors=plus("preferred_directors", "_d"),
            ref_collections=F.when(F.size("_c") > 0, F.col("_c")).otherwise(i["ref_collections"]),
        ),
    ).select(queries.columns)


def candidate_pool(
    items: DataFrame, queries: DataFrame, vectors: DataFrame,
    cast_films: int = CAST_FILMS, studio_films: int = STUDIO_FILMS, pool: int = POOL,
) -> DataFrame:
    """(query_id, item_id, source, rank): discovery pages, filmographies,
    referenced items and their collections, an item counted for the first
    source naming it, then the `pool` best by popularity x rating."""
    i = F.col("intent")
    paged = discover(items, queries).select(
        "query_id", "item_id", F.lit(1).alias("source"), F.col("position").alias("pos")
    )
    studio = items.withColumn(
        "_company", F.explode(F.transform(F.col("production_companies"), lambda c: F.lower(c)))
    )
    asked = queries.where(i["studio"].isNotNull()).select(
        "query_id", F.lower(i["studio"]).alias("_company")
    )
    from_studio = lookup_join(
        studio.select("item_id", "_company", "popularity"), asked, ["_company"],
        spread_by="item_id",
    )
    from_studio = top_k(
        from_studio, ["query_id"], [F.col("popularity").desc_nulls_last(), F.asc("item_id")], studio_films,
        "pos",
    ).select("query_id", "item_id", F.lit(2).alias("source"), "pos")

    def people(field: str, column: str, limit: int | None, order: int) -> DataFrame:
        names = queries.select("query_id", F.explode(i[field]).alias("name"))
        films = filmography(items, names, column, limit)
        return films.select(
            "query_id", "item_id", F.lit(order).alias("source"), F.col("rank").alias("pos")
        )

    ref = reference_items(items, queries, vectors).select("query_id", "item_id")
    named = ref.select("query_id", "item_id", F.lit(5).alias("source"), F.lit(1).alias("pos"))
    series = collection_members(items, ref).select(
        "query_id", "item_id", F.lit(6).alias("source"), F.lit(1).alias("pos")
    )
    sources = [
        paged,
        from_studio,
        people("preferred_directors", "directors", None, 3),
        people("preferred_actors", "cast", cast_films, 4),
        named,
        series,
    ]
    merged = first_wins(
        reduce(DataFrame.unionByName, sources), ["query_id", "item_id"], ["source", "pos"]
    )
    worth = items.select(
        "item_id",
        (
            F.coalesce(F.col("popularity").cast("double"), F.lit(0.0))
            * F.coalesce(F.col("rating_value").cast("double"), F.lit(0.0))
        ).alias("_worth"),
    )
    return top_k(
        merged.join(worth, "item_id"), ["query_id"], [F.desc("_worth"), F.asc("item_id")], pool
    ).select("query_id", "item_id", "source", "rank")


def first_cut(pairs: DataFrame, k: int = POOL) -> DataFrame:
    """Best k per query by popularity x rating."""
    worth = F.coalesce(F.col("popularity"), F.lit(0.0)) * F.coalesce(
        F.col("rating_value"), F.lit(0.0)
    )
    return top_k(pairs, ["query_id"], [worth.desc(), F.asc("item_id")], k)


def catalogue_statistics(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, value): items, vectors, distinct genres and languages."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")

    def distinct(column: str) -> DataFrame:
        return items.select(F.explode(column).alias("v")).dropna().distinct()

    return reduce(
        DataFrame.unionByName,
        [
            counted(items, "total_items"),
            counted(vectors, "total_vectors"),
            counted(distinct("genres"), "total_genres"),
            counted(distinct("languages"), "total_languages"),
        ],
    )


def standard_result(results: DataFrame) -> DataFrame:
    """Common result projection. A zero or blank counts as absent, so the
    next fallback is taken."""
    def first_given(*names: str):
        options = [
            F.nullif(F.col(n).cast("double"), F.lit(0.0)) for n in names if n in results.columns
        ]
        return F.coalesce(*options, F.lit(None).cast("double"))

    have = set(results.columns)
    keep = ["overview", "poster_path", "release_year", "popularity", "original_title",
            "vote_count", "trailer_url", "certification"]
    return results.select(
        *(["query_id"] if "query_id" in have else []),
        F.coalesce("tmdb_id", F.lit(0)).cast("bigint").alias("tmdb_id"),
        F.coalesce("title", F.lit("Unknown Movie")).alias("title"),
        *[F.col(c) for c in keep if c in have],
        *[
            empty_if_null(F.col(c)).alias(c)
            for c in ("genres", "directors", "cast", "streaming_providers")
            if c in have
        ],
        first_given("runtime_minutes", "runtime").cast("int").alias("runtime"),
        first_given("rating_value", "rating").alias("rating"),
        F.coalesce(first_given("reranked_score", "score"), F.lit(0.0)).alias("retrieval_score"),
        F.coalesce(first_given("match_pct", "boosted"), F.lit(0.0)).alias("confidence_score"),
    )


