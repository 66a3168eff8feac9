"""Mapping the cleaned tables of each provider to the item schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import split_names
from ..operators.grouping import ordered_names
from ..schema import conform_items
from ..session import growing, lookup_join

# Credit categories that count as cast.
CAST_CATEGORIES = ["actor", "actress", "self"]


def resolve_names(df: DataFrame, key: str, ids: str, names: DataFrame, alias: str) -> DataFrame:
    """(key, alias) with a list of ids turned into names, list order kept and
    unknown ids dropped. A person on a third of the titles does not skew the
    join: names are broadcast when few, else met over salted copies."""
    spread = df.select(key, F.posexplode(ids).alias("pos", "nconst")).where(F.col("nconst") != "")
    named = lookup_join(
        spread, names.select("nconst", "primaryName"), ["nconst"], spread_by=key
    )
    return ordered_names(named, key, "pos", "primaryName", alias)


def conform_titles(
    basics: DataFrame,
    ratings: DataFrame | None = None,
    crew: DataFrame | None = None,
    principals: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Title source: ratings, people and cast joined onto the base table."""
    df = basics
    if ratings is not None:
        df = df.join(growing(ratings.select("tconst", "averageRating", "numVotes")), "tconst", "left")
    if crew is not None and names is not None:
        for role in ("directors", "writers"):
            df = df.join(growing(resolve_names(crew, "tconst", role, names, role)), "tconst", "left")
    if principals is not None and names is not None:
        acting = principals.where(F.col("category").isin(CAST_CATEGORIES)).select(
            "tconst", "ordering", "nconst"
        )
        named = lookup_join(
            acting, names.select("nconst", "primaryName"), ["nconst"], spread_by="tconst"
        )
        cast = ordered_names(named, "tconst", "ordering", "primaryName", "cast")
        df = df.join(growing(cast), "tconst", "left")
    return conform_items(
        df.withColumnsRenamed(
            {
                "tconst": "imdb_id",
                "primaryTitle": "title",
                "originalTitle": "original_title",
                "runtimeMinutes": "runtime_minutes",
                "startYear": "release_year",
                "averageRating": "rating_value",
                "numVotes": "vote_count",
            }
        ),
        "imdb",
    )


def conform_metadata(
    metadata: DataFrame, credits: DataFrame | None = None, keywords: DataFrame | None = None
) -> DataFrame:
    """Metadata source; the single language becomes a list, empty when null."""
    df = metadata.drop("keywords")
    if credits is not None:
        df = df.join(growing(credits.select("id", "cast_names", "director_names")), "id", "left")
    if keywords is not None:
        df = df.join(growing(keywords.select("id", "keywords")), "id", "left")
    df = df.withColumn(
        "languages",
        F.filter(F.array("original_language"), lambda x: x.isNotNull()),
    ).withColumn("release_year", F.year("release_date"))
    return conform_items(
        df.withColumnsRenamed(
            {
                "id": "tmdb_id",
                "cast_names": "cast",
                "director_names": "directors",
                "runtime": "runtime_minutes",
                "vote_average": "rating_value",
            }
        ),
        "tmdb",
    )


def rating_stats(ratings: DataFrame, key: str = "movieId", value: str = "rating") -> DataFrame:
    """Mean and number of ratings per item."""
    return ratings.groupBy(key).agg(
        F.avg(value).alias("rating_value"), F.count(value).alias("vote_count")
    )


def conform_movies(
    movies: DataFrame, ratings: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """Ratings source: ids from the links, statistics from the ratings."""
    df = movies
    if links is not None:
        df = df.join(growing(links.select("movieId", "imdbId", "tmdbId")), "movieId", "left")
    if ratings is not None:
        df = df.join(growing(rating_stats(ratings)), "movieId", "left")
    return conform_items(
        df.withColumnsRenamed(
            {"imdbId": "imdb_id", "tmdbId": "tmdb_id", "movieId": "movielens_id"}
        ),
        "movielens",
    )


def conform_plots(plots: DataFrame) -> DataFrame:
    """Plot source: names split on commas, genres on slashes as well."""
    return conform_items(
        plots.select(
            F.col("Wiki Page").alias("wiki_page"),
            F.col("Title").alias("title"),
            F.col("Plot").alias("plot_summary"),
            F.col("Release Year").alias("release_year"),
            split_names(F.col("Genre"), ",/").alias("genres"),
            split_names(F.col("Director")).alias("directors"),
            split_names(F.col("Cast")).alias("cast"),
        ),
        "wikipedia",
    )
