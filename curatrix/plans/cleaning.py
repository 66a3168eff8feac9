"""Per-table cleaning and its before/after report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators.grouping import keep_one

# Title kinds kept, the id shape of the metadata source.
TITLE_KINDS = ["movie", "short", "tvMovie"]
NUMERIC_ID = r"^\d+$"


def _apply(df: DataFrame, changes: dict) -> DataFrame:
    return df.withColumns(changes)


def _texts(*names: str) -> dict:
    return {n: X.clean_text(F.col(f"`{n}`")) for n in names}


def _numbers(dtype: str, *names: str) -> dict:
    return {n: X.lenient(F.col(f"`{n}`"), dtype) for n in names}


def _lists(sep: str, *names: str) -> dict:
    return {n: X.split_list(F.col(n), sep) for n in names}


def clean_titles(df: DataFrame) -> DataFrame:
    df = df.where(F.col("titleType").isin(TITLE_KINDS))
    df = _apply(
        df,
        _texts("tconst", "titleType", "primaryTitle", "originalTitle")
        | _numbers("tinyint", "isAdult")
        | _numbers("int", "startYear", "endYear", "runtimeMinutes")
        | _lists(",", "genres"),
    )
    return keep_one(df, ["tconst"])


def clean_title_ratings(df: DataFrame) -> DataFrame:
    df = _apply(
        df, _texts("tconst") | _numbers("float", "averageRating") | _numbers("bigint", "numVotes")
    )
    return keep_one(df, ["tconst"])


def clean_principals(df: DataFrame) -> DataFrame:
    return _apply(
        df,
        _texts("tconst", "nconst", "category", "job")
        | _numbers("int", "ordering")
        | {"characters": X.quoted_tokens(F.col("characters"))},
    )


def clean_crew(df: DataFrame) -> DataFrame:
    return keep_one(_apply(df, _texts("tconst") | _lists(",", "directors", "writers")), ["tconst"])


def clean_names(df: DataFrame) -> DataFrame:
    df = _apply(
        df,
        _texts("nconst", "primaryName")
        | _numbers("int", "birthYear", "deathYear")
        | _lists(",", "primaryProfession", "knownForTitles"),
    )
    return keep_one(df, ["nconst"])


def numeric_id_rows(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is all digits, with the id as a number."""
    return df.where(F.col(column).cast("string").rlike(NUMERIC_ID)).withColumn(
        column, F.col(column).try_cast("bigint")
    )


def clean_metadata(df: DataFrame) -> DataFrame:
    df = _apply(
        numeric_id_rows(df),
        _texts("title", "overview", "original_language")
        | {
            "release_date": X.iso_date(F.col("release_date")),
            "genres": X.json_values(F.col("genres")),
            "production_companies": X.json_values(F.col("production_companies")),
        }
        | _numbers("float", "vote_average")
        | _numbers("bigint", "vote_count"),
    )
    return keep_one(df, ["id"])


def clean_credits(df: DataFrame) -> DataFrame:
    df = _apply(
        numeric_id_rows(df),
        {
            "cast_names": X.json_values(F.col("cast")),
            "director_names": X.director_names(F.col("crew")),
        },
    )
    return keep_one(df, ["id"])


def clean_keywords(df: DataFrame) -> DataFrame:
    df = _apply(numeric_id_rows(df), {"keywords": X.json_values(F.col("keywords"))})
    return keep_one(df, ["id"])


def clean_links(df: DataFrame) -> DataFrame:
    df = _apply(
        df.where(F.col("movieId").isNotNull()),
        _numbers("bigint", "movieId", "tmdbId") | {"imdbId": X.title_id(F.col("imdbId"))},
    )
    return keep_one(df, ["movieId"])


def clean_ratings(df: DataFrame) -> DataFrame:
    return _apply(
        df,
        _numbers("bigint", "userId", "movieId", "timestamp")
        | {"rating": X.rescale(F.col("rating"), 5.0)},
    )


def clean_tags(df: DataFrame) -> DataFrame:
    return _apply(df, _numbers("bigint", "userId", "movieId", "timestamp") | _texts("tag"))


def clean_movies(df: DataFrame) -> DataFrame:
    df = df.select(
        "*", X.title_year(F.col("title")).alias("release_year")
    ).withColumns(
        {"title": X.title_without_year(F.col("title"))}
        | _lists("|", "genres")
        | _numbers("bigint", "movieId")
    )
    return keep_one(df, ["movieId"])


def clean_plots(df: DataFrame) -> DataFrame:
    df = _apply(
        df,
        _numbers("int", "Release Year")
        | _texts("Title", "Origin/Ethnicity", "Director", "Cast", "Genre", "Wiki Page", "Plot"),
    )
    return keep_one(df, ["Wiki Page"])


# (provider, table) -> cleaner, for the sixteen source tables.
CLEANERS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("imdb", "title.basics"): clean_titles,
    ("imdb", "title.ratings"): clean_title_ratings,
    ("imdb", "title.principals"): clean_principals,
    ("imdb", "title.crew"): clean_crew,
    ("imdb", "name.basics"): clean_names,
    ("tmdb", "movies_metadata"): clean_metadata,
    ("tmdb", "credits"): clean_credits,
    ("tmdb", "keywords"): clean_keywords,
    ("tmdb", "links"): clean_links,
    ("tmdb", "links_small"): clean_links,
    ("tmdb", "ratings_small"): clean_ratings,
    ("movielens", "movies"): clean_movies,
    ("movielens", "ratings"): clean_ratings,
    ("movielens", "tags"): clean_tags,
    ("movielens", "links"): clean_links,
    ("wikipedia", "wiki_movie_plots"): clean_plots,
}


def _volume(df: DataFrame, side: str) -> DataFrame:
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias(f"{side}_rows"), nulls.cast("bigint").alias(f"{side}_nulls")
    )


def cleaning_report(raw: DataFrame, cleaned: DataFrame, table: str) -> DataFrame:
    """One row: rows and nulls before and after. Removed rows include those a
    cleaner filters out."""
    rows = (
        _volume(raw, "initial").withColumn("table", F.lit(table))
        .join(_volume(cleaned, "final").withColumn("table", F.lit(table)), "table")
    )
    return rows.select(
        "table",
        "initial_rows",
        "final_rows",
        F.greatest(F.lit(0), F.col("initial_rows") - F.col("final_rows")).alias("removed_rows"),
        F.greatest(F.lit(0), F.col("final_nulls") - F.col("initial_nulls")).alias(
            "null_corrections"
        ),
    )


def cleaning_reports(raw: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """The report of every known table that is given, one row each, by its
    name `provider/table`. Counts come from the rows themselves, not from
    metrics observed while they are written: these count a task again that
    runs again after its executor was lost."""
    reports = [
        cleaning_report(raw[key], fn(raw[key]), "/".join(key))
        for key, fn in CLEANERS.items()
        if key in raw
    ]
    if not reports:
        raise ValueError("no known table is given")
    return reduce(DataFrame.unionByName, reports)


def clean_provider(provider: str, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean every known table of a provider; absent tables are skipped."""
    return {
        table: fn(raw[table])
        for (owner, table), fn in CLEANERS.items()
        if owner == provider and table in raw
    }
