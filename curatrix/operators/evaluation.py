"""Judging result lists: confidence, expected, missing, irrelevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import lowered, lowered_set
from .grouping import top_k

# Titles a good answer to each known query holds.
CURATED = {
    "best superhero movie": [
        "The Dark Knight", "The Avengers", "Spider-Man: Into the Spider-Verse", "Iron Man",
        "The Dark Knight Rises",
    ],
    "best crime movie": [
        "The Godfather", "Pulp Fiction", "Goodfellas", "Scarface", "The Departed",
    ],
    "best sci-fi movie": [
        "Interstellar", "Inception", "The Matrix", "2001: A Space Odyssey", "Blade Runner 2049",
    ],
    "mind bending movies": [
        "Inception", "Interstellar", "Shutter Island", "Memento", "The Prestige",
    ],
    "movies like interstellar": [
        "Gravity", "The Martian", "Contact", "Arrival", "2001: A Space Odyssey",
    ],
    "best animated movie": [
        "Spirited Away", "Toy Story", "Spider-Man: Into the Spider-Verse", "Coco", "WALL·E",
    ],
    "best comedy movie": [
        "Superbad", "The Hangover", "Monty Python and the Holy Grail", "Step Brothers",
    ],
    "psychological thriller": [
        "Shutter Island", "Se7en", "The Silence of the Lambs", "Black Swan", "Gone Girl",
    ],
    "palme dor winner slow burn mystery": [
        "Anatomy of a Fall", "Parasite", "Blow-Up", "The White Ribbon",
    ],
    "studio ghibli style family safe fantasy": [
        "Spirited Away", "My Neighbor Totoro", "Howl's Moving Castle", "Princess Mononoke",
        "Ponyo",
    ],
    "underrated a24 thriller": [
        "Green Room", "It Comes at Night", "Under the Silver Lake",
        "The Killing of a Sacred Deer",
    ],
    "fast paced action movies starring tom cruise": [
        "Mission: Impossible - Fallout", "Edge of Tomorrow", "Top Gun: Maverick",
        "Minority Report",
    ],
    "niche mind-bending sci-fi": [
        "Coherence", "Primer", "Upstream Color", "Predestination", "The Man from Earth",
    ],
}
# Shares of top score, list length and completeness.
TOP_SHARE, LENGTH_SHARE, FILLED_SHARE = 0.7, 0.15, 0.15
SHOWN, POOL = 10, 50


def confidence(results: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, confidence) for results(query_id, position, semantic, title,
    overview, genres); 0 for a query without results."""
    filled = (
        F.when(F.col("title") != "", 1).otherwise(0)
        + F.when(F.col("overview") != "", 1).otherwise(0)
        + F.when(F.size("genres") > 0, 1).otherwise(0)
    ) / F.lit(3.0)
    c = F.col
    stats = results.groupBy("query_id").agg(
        F.max(F.when(c("position") == 1, c("semantic"))).alias("_top"),
        F.count("*").alias("_n"),
        F.avg(F.when(c("position") <= 3, filled)).alias("_filled"),
    )
    score = (
        TOP_SHARE * c("_top")
        + LENGTH_SHARE * F.least(c("_n") / F.lit(float(limit)), F.lit(1.0))
        + FILLED_SHARE * c("_filled")
    )
    return queries.select("query_id").join(stats, "query_id", "left").select(
        "query_id", F.round(F.coalesce(score, F.lit(0.0)), 4).alias("confidence")
    )


def curated_titles(queries: DataFrame) -> DataFrame:
    """(query_id, order, title): titles of the first known query that contains
    or is contained in the text, both without punctuation."""
    plain = lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", "")
    q = F.col("_q")
    hit = F.lit(None).cast("array<string>")
    for known, titles in reversed(CURATED.items()):
        key = plain(F.lit(known))
        hit = F.when(q.contains(key) | key.contains(q), F.array(*[F.lit(t) for t in titles])
                     ).otherwise(hit)
    return (
        queries.select("query_id", plain(F.lower(F.trim("text"))).alias("_q"))
        .select("query_id", F.posexplode(hit).alias("order", "title"))
    )


def judge_results(queries: DataFrame, pool: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, verdict, order, title) with verdict expected, missing or
    irrelevant, at most ten each.

    queries(query_id, text, intent); pool and results(query_id, position,
    title, genres, cast, directors). Curated titles decide for known queries;
    else every pool item meeting genres, actors and directors is expected."""
    shown = results.where(
        (F.col("position") <= SHOWN) & F.col("title").isNotNull() & (F.col("title") != "")
    )
    pool = pool.where(F.col("title") != "")
    low = F.lower("title").alias("_t")
    shown_titles = shown.select("query_id", low).distinct()
    known = curated_titles(queries).withColumn("_t", F.lower("title"))
    curated_hit = known.join(shown_titles, ["query_id", "_t"], "left_semi").select(
        "query_id", F.lit("expected").alias("verdict"), "order", "title"
    )
    in_pool = pool.groupBy("query_id", low).agg(
        F.max_by("title", F.col("position")).alias("_pool_title")
    )
    curated_miss = (
        known.join(shown_titles, ["query_id", "_t"], "left_anti")
        .join(in_pool, ["query_id", "_t"])
        .select("query_id", F.lit("missing").alias("verdict"), "order",
                F.col("_pool_title").alias("title"))
    )

    i = F.col("intent")

    def meets(column: str, wanted):
        want = lowered(wanted)
        return (F.size(want) == 0) | F.arrays_overlap(lowered_set(F.col(column)), want)

    free = queries.join(known.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", "intent"
    )
    fitting = (
        pool.where(F.col("position") <= POOL)
        .join(free, "query_id")
        .where(
            meets("genres", i["genres"])
            & meets("cast", i["preferred_actors"])
            & meets("directors", i["preferred_directors"])
        )
        .select("query_id", "position", "title")
    )
    exact_shown = shown.select("query_id", "title").distinct().withColumn("_hit", F.lit(True))
    free_rows = fitting.join(exact_shown, ["query_id", "title"], "left").select(
        "query_id",
        F.when(F.col("_hit"), "expected").otherwise("missing").alias("verdict"),
        F.col("position").alias("order"),
        "title",
    )
    g = lowered_set(F.col("genres"))
    avoid = lowered(i["avoid_genres"])
    wrong = (
        F.arrays_overlap(g, avoid)
        | F.array_contains(lowered(i["avoid_movies"]), F.lower("title"))
        | ((F.size(i["genres"]) > 0) & ~F.arrays_overlap(g, lowered(i["genres"])))
    )
    irrelevant = (
        shown.join(queries.select("query_id", "intent"), "query_id")
        .where(wrong)
        .select("query_id", F.lit("irrelevant").alias("verdict"),
                F.col("position").alias("order"), "title")
    )
    rows = curated_hit.unionByName(curated_miss).unionByName(free_rows).unionByName(irrelevant)
    return top_k(
        rows, ["query_id", "verdict"], [F.asc("order"), F.asc("title")], SHOWN, "place"
    ).drop("order").withColumnRenamed("place", "order")
