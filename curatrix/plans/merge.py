"""Entity resolution over four providers and merging by source priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.documents import item_document
from ..functions.text import match_key
from ..operators.grouping import first_by, merged_lists, sole_owner
from ..schema import ID_COLUMNS, ITEM_COLUMNS, LIST_COLUMNS, conform_items
from ..session import growing

# Votes a title without link needs; source order on conflicts.
MIN_VOTES = 50
SOURCE_PRIORITY = {"tmdb": 1, "imdb": 2, "movielens": 3}
OTHER_PRIORITY = 4

_FIRST = [
    c
    for c in ITEM_COLUMNS
    if c not in LIST_COLUMNS + ID_COLUMNS + ["rating_value", "vote_count", "document"]
]


def linked_ids(metadata: DataFrame, movies: DataFrame) -> DataFrame:
    """Distinct title ids the two link-bearing sources name."""
    return (
        metadata.select("imdb_id").union(movies.select("imdb_id")).dropna().distinct()
    )


def admitted_titles(titles: DataFrame, linked: DataFrame) -> DataFrame:
    """Titles that are linked, or rated with enough votes."""
    flagged = titles.join(growing(linked.withColumn("_linked", F.lit(True))), "imdb_id", "left")
    rated = F.col("rating_value").isNotNull() & (F.col("vote_count") >= MIN_VOTES)
    return flagged.where(F.col("_linked") | rated).select(titles.columns)


def link_pages(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(wiki_page, imdb_id or null): pages matched on title key and year.
    Both sides are reduced to one row per key before they meet, so a key many
    pages or titles share yields one row, not all pairs; of several pages the
    first wins and the others stay matched without a title."""
    key = [match_key(F.col("title")).alias("_t"), F.col("release_year").alias("_y")]
    by_title = titles.select(*key, "imdb_id").dropna().groupBy("_t", "_y").agg(
        F.min("imdb_id").alias("imdb_id")
    )
    keyed = pages.select(*key, "wiki_page").where(F.col("wiki_page").isNotNull())
    winners = keyed.dropna().groupBy("_t", "_y").agg(F.min("wiki_page").alias("wiki_page"))
    return winners.join(growing(by_title), ["_t", "_y"]).select("wiki_page", "imdb_id")


def unmatched_pages(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Pages whose title key and year no title has."""
    key = [match_key(F.col("title")).alias("_t"), F.col("release_year").alias("_y")]
    known = titles.select(*key).dropna().distinct()
    keyed = pages.select(*key, "wiki_page").where(F.col("wiki_page").isNotNull())
    return keyed.join(growing(known), ["_t", "_y"], "left_anti").select("wiki_page").distinct()


def id_links(metadata: DataFrame, movies: DataFrame) -> DataFrame:
    """One (imdb_id, tmdb_id, movielens_id) per title id; an id claimed by
    several titles stays with the first."""
    both = movies.select("imdb_id", "tmdb_id", "movielens_id").unionByName(
        metadata.select("imdb_id", "tmdb_id"), allowMissingColumns=True
    )
    links = both.where(F.col("imdb_id").isNotNull()).groupBy("imdb_id").agg(
        F.min("tmdb_id").alias("tmdb_id"), F.min("movielens_id").alias("movielens_id")
    )
    links = sole_owner(links, "imdb_id", "tmdb_id")
    return sole_owner(links, "imdb_id", "movielens_id")


def master_map(
    titles: DataFrame, metadata: DataFrame, movies: DataFrame, pages: DataFrame,
    compat: bool = False,
) -> DataFrame:
    """One row per merged item: item_key and the four ids. `titles` are the
    admitted ones. With compat, a page that matches a title neither of the
    link-bearing sources names is lost, as in the original flow."""
    links = id_links(metadata, movies)
    page_links = link_pages(pages, titles)
    alone = titles.select("imdb_id").dropna().distinct().join(growing(links), "imdb_id", "left_anti")
    if compat:
        linked = links.join(growing(page_links), "imdb_id", "left")
        rows = linked.unionByName(alone, allowMissingColumns=True)
    else:
        rows = links.unionByName(alone, allowMissingColumns=True).join(
            growing(page_links), "imdb_id", "left"
        )
    taken = links.select("tmdb_id").dropna()
    tmdb_only = (
        metadata.where(F.col("imdb_id").isNull() & F.col("tmdb_id").isNotNull())
        .select("tmdb_id")
        .distinct()
        .join(growing(taken), "tmdb_id", "left_anti")
    )
    parts = [rows.select(*ID_COLUMNS), tmdb_only, unmatched_pages(pages, titles)]
    full = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # A digest of the ids is stable over recomputation, unlike a row index, and
    # wide enough not to collide over billions of items.
    key = F.md5(F.to_json(F.struct(*ID_COLUMNS), {"ignoreNullFields": "false"}))
    return full.select(key.alias("item_key"), *ID_COLUMNS)


def rekeyed(
    master: DataFrame, titles: DataFrame, metadata: DataFrame, movies: DataFrame,
    pages: DataFrame,
) -> DataFrame:
    """All source rows with their item_key, each source over its own id."""
    def over(df: DataFrame, key: str) -> DataFrame:
        keys = master.select("item_key", key).dropna()
        return df.join(growing(keys), key).select("item_key", *ITEM_COLUMNS)

    return (
        over(titles, "imdb_id")
        .unionByName(over(metadata, "tmdb_id"))
        .unionByName(over(movies, "movielens_id"))
        .unionByName(over(pages, "wiki_page"))
    )


def source_rank() -> Column:
    rank = F.lit(OTHER_PRIORITY)
    for name, n in SOURCE_PRIORITY.items():
        rank = F.when(F.col("source_dataset") == name, n).otherwise(rank)
    return rank


def weighted_rating(rank: Column) -> Column:
    """Vote-weighted mean; the first rating by rank when nobody voted."""
    r, v = F.col("rating_value").cast("double"), F.col("vote_count")
    votes = F.coalesce(F.sum(v), F.lit(0))
    return F.when(votes > 0, F.coalesce(F.sum(r * v), F.lit(0.0)) / votes).otherwise(
        F.min_by(r, F.when(r.isNotNull(), rank))
    )


def merge_rows(rows: DataFrame, key: str = "item_key") -> DataFrame:
    """One row per key: first non-null by source rank, union of lists,
    weighted rating, sum of votes. Aggregates merge partially on the map side;
    ids and lists travel separately so that no row holds a whole group."""
    # The tie-break makes equal ranks deterministic.
    rank = F.struct(source_rank(), F.xxhash64(*[c for c in ITEM_COLUMNS if c != "document"]))
    ranked = rows.withColumn("_rank", rank)
    scalars = ranked.groupBy(key).agg(
        *[first_by(c, F.col("_rank")) for c in _FIRST],
        weighted_rating(F.col("_rank")).alias("rating_value"),
        F.coalesce(F.sum("vote_count"), F.lit(0)).alias("vote_count"),
    )
    return scalars.join(growing(merged_lists(rows, key, LIST_COLUMNS)), key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in LIST_COLUMNS}
    )


def merge_catalogue(
    titles: DataFrame, metadata: DataFrame, movies: DataFrame, pages: DataFrame,
    compat: bool = False,
) -> DataFrame:
    """Merged catalogue in the item schema, plus item_key."""
    titles = admitted_titles(titles, linked_ids(metadata, movies))
    master = master_map(titles, metadata, movies, pages, compat)
    merged = merge_rows(rekeyed(master, titles, metadata, movies, pages))
    full = merged.drop(*ID_COLUMNS).join(growing(master), "item_key")
    full = full.withColumn("document", item_document())
    return full.select("item_key", *[c for c in conform_items(full).columns])


def overlap_statistics(
    master: DataFrame, merged: DataFrame, sources: dict[str, DataFrame]
) -> DataFrame:
    """(name, value): source sizes, id overlaps and merged coverage."""
    def pair(a: str, b: str) -> Column:
        return F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())

    overlaps = {
        "overlap_imdb_tmdb": pair("imdb_id", "tmdb_id"),
        "overlap_imdb_movielens": pair("imdb_id", "movielens_id"),
        "overlap_imdb_wiki": pair("imdb_id", "wiki_page"),
    }
    coverage = {
        "total_items": F.count("*"),
        "with_ratings": F.count_if(F.col("rating_value").isNotNull()),
        "with_plots": F.count_if(
            F.col("plot_summary").isNotNull() | F.col("overview").isNotNull()
        ),
    }

    def long(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        wide = df.agg(*[a.alias(n) for n, a in aggs.items()])
        return wide.unpivot([], list(aggs), "name", "value")

    parts = [long(master, overlaps), long(merged, coverage)]
    parts += [long(df, {f"{n}_source_rows": F.count("*")}) for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)
