"""Item schema, query-intent schema and schema enforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_STRINGS = T.ArrayType(T.StringType())

# The 29 item columns, their order and types.
ITEM_SCHEMA = T.StructType(
    [
        T.StructField("imdb_id", T.StringType()),
        T.StructField("tmdb_id", T.LongType()),
        T.StructField("movielens_id", T.LongType()),
        T.StructField("wiki_page", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("original_title", T.StringType()),
        T.StructField("overview", T.StringType()),
        T.StructField("plot_summary", T.StringType()),
        T.StructField("genres", _STRINGS),
        T.StructField("cast", _STRINGS),
        T.StructField("directors", _STRINGS),
        T.StructField("writers", _STRINGS),
        T.StructField("runtime_minutes", T.IntegerType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("rating_value", T.FloatType()),
        T.StructField("vote_count", T.LongType()),
        T.StructField("popularity", T.FloatType()),
        T.StructField("production_companies", _STRINGS),
        T.StructField("languages", _STRINGS),
        T.StructField("keywords", _STRINGS),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("poster_path", T.StringType()),
        T.StructField("backdrop_path", T.StringType()),
        T.StructField("trailer_url", T.StringType()),
        T.StructField("streaming_providers", _STRINGS),
        T.StructField("collection_name", T.StringType()),
        T.StructField("certification", T.StringType()),
        T.StructField("tagline", T.StringType()),
        T.StructField("document", T.StringType()),
    ]
)
ITEM_COLUMNS = ITEM_SCHEMA.fieldNames()
LIST_COLUMNS = [f.name for f in ITEM_SCHEMA if isinstance(f.dataType, T.ArrayType)]
ID_COLUMNS = ["imdb_id", "tmdb_id", "movielens_id", "wiki_page"]

# The 32 intent fields.
INTENT_SCHEMA = T.StructType(
    [
        T.StructField("intent", T.StringType()),
        T.StructField("ranking_mode", T.StringType()),
        T.StructField("genres", _STRINGS),
        T.StructField("moods", _STRINGS),
        T.StructField("themes", _STRINGS),
        T.StructField("similar_movies", _STRINGS),
        T.StructField("preferred_actors", _STRINGS),
        T.StructField("preferred_directors", _STRINGS),
        T.StructField("language", T.StringType()),
        T.StructField(
            "year_range",
            T.StructType(
                [
                    T.StructField("start", T.IntegerType()),
                    T.StructField("end", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("runtime", T.IntegerType()),
        T.StructField("keywords", _STRINGS),
        T.StructField("avoid_movies", _STRINGS),
        T.StructField("avoid_genres", _STRINGS),
        T.StructField("legacy_soft_genre", T.BooleanType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("exclusions", _STRINGS),
        T.StructField("ref_collections", _STRINGS),
        T.StructField("popularity_preference", T.StringType()),
        T.StructField("critical_acclaim_preference", T.StringType()),
        T.StructField("novelty_preference", T.StringType()),
        T.StructField("awards_preference", T.StringType()),
        T.StructField("complexity", T.StringType()),
        T.StructField("pacing", T.StringType()),
        T.StructField("studio", T.StringType()),
        T.StructField("universe_franchise", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("streaming_preference", T.StringType()),
        T.StructField("family_safety", T.StringType()),
        T.StructField("violence_level", T.StringType()),
        T.StructField("strict_person_filter", T.BooleanType()),
        T.StructField("explicit_genres", _STRINGS),
    ]
)
_INTENT_DEFAULTS = {
    "intent": "recommendation",
    "ranking_mode": "default",
    "legacy_soft_genre": False,
    "strict_person_filter": False,
}


def conform_items(df: DataFrame, source: str | None = None) -> DataFrame:
    """Project to the item schema: typed nulls for absent columns, lenient
    casts for present ones, fixed order, and an optional source stamp."""
    have = set(df.columns)

    def pick(field: T.StructField) -> Column:
        if field.name == "source_dataset" and source is not None:
            return F.lit(source).alias(field.name)
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select([pick(f) for f in ITEM_SCHEMA])


def schema_matches(df: DataFrame) -> bool:
    """True when names, order and types equal the item schema."""
    return [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in ITEM_SCHEMA
    ]


def make_intent(**fields: Column) -> Column:
    """Intent struct with every field present; lists default to empty."""
    unknown = set(fields) - set(INTENT_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"unknown intent fields: {sorted(unknown)}")
    out = []
    for f in INTENT_SCHEMA:
        value = fields.get(f.name)
        if value is None:
            if isinstance(f.dataType, T.ArrayType) and f.name != "explicit_genres":
                value = F.array().cast(f.dataType)
            else:
                value = F.lit(_INTENT_DEFAULTS.get(f.name)).cast(f.dataType)
        else:
            value = value.cast(f.dataType)
            if isinstance(f.dataType, T.ArrayType) and f.name != "explicit_genres":
                value = F.coalesce(value, F.array().cast(f.dataType))
        out.append(value.alias(f.name))
    return F.struct(*out)


def with_intent(intent: Column, **changes: Column) -> Column:
    """Copy of an intent struct with some fields replaced."""
    for name, value in changes.items():
        intent = intent.withField(name, value.cast(INTENT_SCHEMA[name].dataType))
    return intent
