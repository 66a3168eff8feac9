"""From query texts to routed, expanded intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.understanding import (
    expand_themes,
    heuristic_intent,
    intent_label,
    pathway,
    person_intent,
    with_person_route,
)
from ..operators.lookups import exact_titles, fuzzy_titles, validated_people
from ..schema import make_intent
from ..session import settle


def route_queries(queries: DataFrame, items: DataFrame, fuzzy: bool = True) -> DataFrame:
    """queries(query_id, text) with intent and `routed`: an exact title, else
    a very similar one, else a person pattern, else the word rules."""
    exact = exact_titles(items, queries).withColumnRenamed("title", "_exact")
    df = queries.join(exact, "query_id", "left")
    if fuzzy:
        near = fuzzy_titles(items, queries).select("query_id", F.col("title").alias("_near"))
        df = df.join(near, "query_id", "left")
    else:
        df = df.withColumn("_near", F.lit(None).cast("string"))
    df = with_person_route(df).withColumn("_title", F.coalesce("_exact", "_near"))
    df = df.withColumn("_rules", heuristic_intent(F.trim("text")))
    named = F.col("route")["name"].isNotNull()
    titled = F.col("_title").isNotNull()
    lookup = make_intent(intent=F.lit("movie_lookup"), similar_movies=F.array("_title"))
    return df.select(
        "query_id",
        "text",
        F.when(titled, lookup)
        .when(named, person_intent(F.col("route")))
        .otherwise(F.col("_rules"))
        .alias("intent"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(titled, "fuzzy")
        .when(named, "person")
        .otherwise("rules")
        .alias("routed"),
    )


def understand(queries: DataFrame, items: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Routing, theme expansion, people validation, label and pathway."""
    # Written in between: later steps read the intent as plain columns instead
    # of repeating the rules that made it.
    routed = settle(route_queries(queries, items, fuzzy), "routed")
    expanded = settle(expand_themes(routed), "expanded")
    checked = validated_people(items, expanded)
    i = F.col("intent")
    return checked.withColumn("label", intent_label(i)).withColumn(
        "pathway", pathway(i, strict_last=True)
    )
