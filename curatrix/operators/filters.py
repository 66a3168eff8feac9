"""Query-by-item filters: structured retrieval, relaxation, strict
constraints and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import (
    empty_if_null,
    genre_key,
    language_code,
    literal_map,
    lowered,
    lowered_set,
)
from ..schema import with_intent
from ..session import settle
from .grouping import top_k
from .predicate_index import all_of, count_table, meet, none_of, pair_table, some_of, within

# Title wording of series and sets, unreleased states, mature
# keywords, and the languages the two later filters know.
SERIES_PATTERN = (
    r"(?iU)\b(tv series|tv show|box set|season \d+|episode \d+|complete series|collection)\b"
)
SERIES_PARTS = ["tv series", "tv show", "box set", "complete series", "season ", "episode "]
UNRELEASED = ["planned", "rumored", "post production", "in production", "cancelled"]
MATURE_KEYWORDS = ["r-rated", "nudity", "gore", "slasher", "mature", "nsfw", "erotic"]
STRICT_LANGUAGES = {
    "korean": "ko",
    "japanese": "ja",
    "english": "en",
    "french": "fr",
    "german": "de",
    "spanish": "es",
    "italian": "it",
    "chinese": "zh",
    "cantonese": "cn",
    "hindi": "hi",
    "russian": "ru",
    "swedish": "sv",
}
DISCOVER_LANGUAGES = {
    "korean": "ko",
    "english": "en",
    "japanese": "ja",
    "french": "fr",
    "spanish": "es",
    "german": "de",
    "italian": "it",
    "chinese": "zh",
    "hindi": "hi",
}
# Minimum votes and rating per ranking mode; a mode not named uses the last.
DISCOVER_FLOORS = {"best": (100, 6.5), "mood": (0, 0.0), "": (50, 0.0)}


def _code(c: Column, table: dict[str, str]) -> Column:
    k = F.lower(F.trim(c))
    return F.coalesce(
        F.try_element_at(literal_map(table), k), F.when(k.isin(sorted(set(table.values()))), k)
    )


def _any_of(values: Column, wanted: Column) -> Column:
    """Some lower-cased entry is wanted; null for a null list."""
    return F.exists(values, lambda x: F.array_contains(wanted, F.lower(x)))


def _asks_documentary(i: Column) -> Column:
    return F.exists(i["genres"], lambda g: F.lower(g).contains("documentary"))


def passes_filters(i: Column, hard_genres: str = "genres") -> Column:
    """Structured hard filter over item columns and an intent. Three-valued
    logic is kept: an item whose value is null fails any test made on it."""
    title, original = F.lower("title"), F.lower("original_title")
    off = F.size
    avoid_g, avoid_t = lowered(i["avoid_genres"]), lowered(i["avoid_movies"])
    banned = F.filter(
        F.transform(i["exclusions"], lambda e: F.lower(F.trim(e))), lambda e: e != ""
    )
    code = language_code(i["language"])
    span = i["year_range"]
    wanted = empty_if_null(i[hard_genres])
    year, runtime = F.col("release_year"), F.col("runtime_minutes")
    tests = [
        (off(avoid_g) == 0) | ~_any_of(F.col("genres"), avoid_g),
        (off(avoid_t) == 0)
        | (~F.array_contains(avoid_t, title) & ~F.array_contains(avoid_t, original)),
        (off(banned) == 0)
        | (
            ~_any_of(F.col("genres"), banned)
            & ~_any_of(F.col("cast"), banned)
            & ~F.array_contains(banned, title)
            & ~F.array_contains(banned, original)
        ),
        code.isNull() | F.array_contains("languages", code),
        span["start"].isNull() | (year >= span["start"]),
        span["end"].isNull() | (year <= span["end"]),
        i["release_year"].isNull() | (year == i["release_year"]),
        i["runtime"].isNull() | (runtime <= i["runtime"]),
        (off(wanted) == 0) | i["legacy_soft_genre"] | _any_of(F.col("genres"), lowered(wanted)),
        _asks_documentary(i) | ~F.exists("genres", lambda g: F.lower(g) == "documentary"),
        ~F.coalesce("title", F.lit("")).rlike(SERIES_PATTERN),
        ~F.coalesce("original_title", F.lit("")).rlike(SERIES_PATTERN),
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


# Item fields that filter and discovery clauses are on.
LISTS = ["genres", "languages", "titles", "cast"]
NUMBERS = ["release_year", "runtime_minutes"]
DISCOVERY_LISTS = ["genres", "languages", "keywords", "cast", "directors"]
DISCOVERY_NUMBERS = [*NUMBERS, "vote_count", "rating_value"]


def filter_fields(items: DataFrame) -> DataFrame:
    """(item_id, LISTS, NUMBERS) of items that are no series or set, as
    filter_demands asks of them."""
    plain = [~F.coalesce(c, F.lit("")).rlike(SERIES_PATTERN) for c in ("title", "original_title")]
    return items.where(plain[0] & plain[1]).select(
        "item_id",
        lowered(F.col("genres")).alias("genres"),
        "languages",
        F.array(F.lower("title"), F.lower("original_title")).alias("titles"),
        lowered(F.col("cast")).alias("cast"),
        *[F.col(n).cast("double").alias(n) for n in NUMBERS],
    )


def filter_demands(i: Column, hard_genres: str = "genres") -> Column:
    """passes_filters as clauses on filter_fields; what it tests of the item
    alone is tested there."""
    span, year = i["year_range"], i["release_year"]
    avoid_g, avoid_t = lowered(i["avoid_genres"]), lowered(i["avoid_movies"])
    banned = F.filter(
        F.transform(i["exclusions"], lambda e: F.lower(F.trim(e))), lambda e: e != ""
    )
    wanted = F.when(
        F.coalesce(i["legacy_soft_genre"], F.lit(False)), F.array().cast("array<string>")
    ).otherwise(lowered(empty_if_null(i[hard_genres])))
    own = F.when(_asks_documentary(i), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("documentary"))
    )
    code = language_code(i["language"])
    return all_of(
        some_of("genres", wanted),
        some_of("languages", F.when(code.isNotNull(), F.array(code))),
        none_of("genres", F.concat(avoid_g, banned, own)),
        none_of("titles", F.concat(avoid_t, banned)),
        none_of("cast", banned),
        within("release_year", F.greatest(span["start"], year), F.least(span["end"], year)),
        within("runtime_minutes", high=i["runtime"]),
        unless=avoid_g.isNull() | avoid_t.isNull() | banned.isNull() | F.exists(avoid_t, F.isnull),
    )


def matching_pairs(
    items: DataFrame, queries: DataFrame, hard_genres: str = "genres"
) -> DataFrame:
    """(query_id, item_id) of every item that passes a query's filter, by the
    index of query predicates. item_id and query_id are unique."""
    # Written first: clauses then read an intent, not the rules it was derived by.
    held = settle(queries.select("query_id", "intent"), "queries")
    asked = held.select("query_id", filter_demands(F.col("intent"), hard_genres).alias("demands"))
    return _pairs(filter_fields(items), asked, LISTS, NUMBERS)


def _pairs(fields: DataFrame, asked: DataFrame, lists: list[str], numbers: list[str]) -> DataFrame:
    kinds = {**dict(fields.dtypes), **dict(asked.dtypes)}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}"
    return meet(settle(fields, "fields"), settle(asked, "demands"), lists, numbers, pair_table, schema)


def survivors(
    items: DataFrame, queries: DataFrame, hard_genres: str = "genres"
) -> DataFrame:
    """Item rows with query_id and intent for each query they pass."""
    pairs = matching_pairs(items, queries, hard_genres)
    return items.join(pairs, "item_id").join(queries.select("query_id", "intent"), "query_id")


def relax(
    items: DataFrame, queries: DataFrame, limit: int = 50, min_results: int = 5
) -> DataFrame:
    """Queries with their intent loosened until min_results items pass (limit,
    where that is less; a tiny catalogue may ask for one), plus the
    `relax_level` used: 0 as asked, 2 without genres, 3 also without years and
    runtime. People are not part of the filter, so the level in between that
    drops them finds the same items and is not run.

    The three forms of a query are three queries of one index, so one pass over
    the items counts them all."""
    threshold = min(min_results, limit)
    queries = settle(queries, "queries")
    i = F.col("intent")
    none, unset = F.array().cast("array<string>"), F.lit(None)
    no_genres = with_intent(i, genres=none)
    free = with_intent(i, genres=none, year_range=unset, runtime=unset)
    forms = {0: i, 2: no_genres, 3: free}
    demands = F.array(
        *[F.struct(F.lit(n).alias("level"), filter_demands(f).alias("demands")) for n, f in forms.items()]
    )
    asked = queries.select("query_id", F.explode(demands).alias("d")).select(
        F.struct("query_id", "d.level").alias("query_id"), "d.demands"
    )
    kind = dict(queries.dtypes)["query_id"]
    counted = meet(
        settle(filter_fields(items), "fields"), settle(asked, "demands"), LISTS, NUMBERS, count_table,
        f"query_id struct<query_id:{kind},level:int>, n long",
    )
    found = counted.groupBy(F.col("query_id.query_id").alias("query_id")).agg(
        *[F.sum(F.when(F.col("query_id.level") == n, F.col("n"))).alias(f"_n{n}") for n in (0, 2)]
    )
    loosenable = (
        (F.size(i["preferred_actors"]) > 0)
        | (F.size(i["preferred_directors"]) > 0)
        | (F.size(i["genres"]) > 0)
        | i["year_range"].isNotNull()
        | i["runtime"].isNotNull()
    )
    short = lambda n: F.coalesce(F.col(f"_n{n}"), F.lit(0)) < threshold
    level = F.when(~(short(0) & F.coalesce(loosenable, F.lit(False))), 0).when(~short(2), 2).otherwise(3)
    loosened = F.when(F.col("relax_level") == 0, i).when(F.col("relax_level") == 2, no_genres).otherwise(free)
    return (
        queries.join(settle(found, "relax"), "query_id", "left")
        .withColumn("relax_level", level)
        .withColumn("intent", loosened)
        .select(*queries.columns, "relax_level")
    )


def _optional(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def _reasons(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def strict_facts(items: DataFrame) -> DataFrame:
    """Add `_facts`: what the strict constraints read of an item, and those it
    breaks whatever is asked. Made before items meet queries, it is worked out
    once per item and not once per pair."""
    genres = empty_if_null(F.col("genres"))
    title = F.lower(
        F.coalesce(
            F.nullif("title", F.lit("")), F.nullif("original_title", F.lit("")), F.lit("Unknown")
        )
    )
    released = _optional(items, "release_date", "string")
    spoken = F.array_compact(
        F.concat(
            lowered(empty_if_null(F.col("languages"))),
            F.array(F.lower(_optional(items, "original_language", "string"))),
        )
    )
    year = F.nullif(F.col("release_year"), F.lit(0))
    mature = F.array(*[F.lit(k) for k in MATURE_KEYWORDS])
    adult = F.coalesce(_optional(items, "adult", "boolean"), F.lit(False))
    series = F.lit(False)
    for part in SERIES_PARTS:
        series = series | title.contains(part)
    fixed = {
        "status": F.lower(_optional(items, "status", "string")).isin(UNRELEASED),
        "release": F.nullif(released.cast("string"), F.lit("")).isNull() & year.isNull(),
        "overview": F.length(F.trim(F.coalesce("overview", F.lit("")))) < 10,
        "genres": F.size(genres) == 0,
        "votes": F.col("vote_count") < 5,
    }
    unfit = F.array_contains(genres, "Horror") | adult
    facts = {
        "fixed": _reasons(fixed),
        "keys": F.transform(genres, genre_key),
        "title": title,
        "spoken": spoken,
        "year": year,
        "directors": lowered_set(F.col("directors")),
        "cast": lowered_set(F.col("cast")),
        "countries": lowered(
            empty_if_null(_optional(items, "production_countries", "array<string>"))
        ),
        "runtime": F.nullif(F.col("runtime_minutes"), F.lit(0)),
        "unfit": unfit | F.arrays_overlap(lowered_set(F.col("keywords")), mature),
        "series": series,
        "documentary": F.array_contains(genres, "Documentary"),
    }
    return items.withColumn("_facts", F.struct(*[c.alias(n) for n, c in facts.items()]))


def strict_demands(queries: DataFrame) -> DataFrame:
    """Add `_demands`: what the strict constraints read of an intent, worked out
    once per query where it is made before queries meet items."""
    i = F.col("intent")
    span = i["year_range"]
    demands = {
        "explicit": F.transform(F.coalesce(i["explicit_genres"], i["genres"]), genre_key),
        "avoid": F.transform(i["avoid_genres"], genre_key),
        "titles": lowered(F.filter(i["avoid_movies"], lambda t: t != "")),
        "code": _code(i["language"], STRICT_LANGUAGES),
        "start": F.nullif(span["start"], F.lit(0)),
        "end": F.nullif(span["end"], F.lit(0)),
        "year": F.nullif(i["release_year"], F.lit(0)),
        "directors": lowered(i["preferred_directors"]),
        "cast": lowered(i["preferred_actors"]),
        "country": F.lower(i["country"]),
        "runtime": F.nullif(i["runtime"], F.lit(0)),
        "family": i["family_safety"] == "family_safe",
        "documentary": _asks_documentary(i),
    }
    return queries.withColumn("_demands", F.struct(*[c.alias(n) for n, c in demands.items()]))


def with_rejections(pairs: DataFrame) -> DataFrame:
    """Add `reject_reasons`: the strict constraints a candidate breaks.
    Constraints on a list pass when the item's list is empty. Pairs of items
    with `strict_facts` and queries with `strict_demands` only compare them;
    what is missing is made per pair."""
    if "_facts" not in pairs.columns:
        pairs = strict_facts(pairs)
    if "_demands" not in pairs.columns:
        pairs = strict_demands(pairs)
    have, want = F.col("_facts"), F.col("_demands")

    def misses(field: str, wanted: str) -> Column:
        h, w = have[field], want[wanted]
        return (F.size(w) > 0) & (F.size(h) > 0) & ~F.arrays_overlap(h, w)

    spoken, countries = have["spoken"], have["countries"]
    asked = {
        "avoid_genre": F.arrays_overlap(have["keys"], want["avoid"]),
        "avoid_title": F.exists(want["titles"], lambda t: have["title"].contains(t)),
        "explicit_genre": misses("keys", "explicit"),
        "language": want["code"].isNotNull()
        & (F.size(spoken) > 0)
        & ~F.array_contains(spoken, want["code"]),
        "years": (have["year"] < want["start"]) | (have["year"] > want["end"]),
        "year": F.abs(have["year"] - want["year"]) > 3,
        "director": misses("directors", "directors"),
        "actor": misses("cast", "cast"),
        "country": want["country"].isNotNull()
        & (F.size(countries) > 0)
        & ~F.exists(countries, lambda c: c.contains(want["country"])),
        "runtime": (want["runtime"] > 0) & (have["runtime"] > want["runtime"] + 10),
        "family": want["family"] & have["unfit"],
        "series": have["series"],
        "documentary": ~want["documentary"] & have["documentary"],
    }
    return pairs.withColumn(
        "reject_reasons", F.concat(have["fixed"], _reasons(asked))
    ).drop("_facts", "_demands")


def strict_candidates(pairs: DataFrame) -> DataFrame:
    """Candidates breaking no constraint; a query whose candidates all break
    some keeps every one of them. Adds `waived`."""
    judged = with_rejections(pairs).withColumn("_ok", F.size("reject_reasons") == 0)
    state = judged.groupBy("query_id").agg((~F.bool_or("_ok")).alias("waived"))
    return judged.join(state, "query_id").where(F.col("_ok") | F.col("waived")).drop("_ok")


def discovery_fields(items: DataFrame) -> DataFrame:
    """(item_id, DISCOVERY_LISTS, DISCOVERY_NUMBERS) as discovery_demands asks
    of them. An item's language is its first one."""
    return items.select(
        "item_id",
        *[lowered_set(F.col(n)).alias(n) for n in ("genres", "keywords", "cast", "directors")],
        F.slice("languages", 1, 1).alias("languages"),
        *[F.col(n).cast("double").alias(n) for n in NUMBERS],
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in ("vote_count", "rating_value")],
    )


def discovery_demands(i: Column) -> Column:
    """Discovery conditions on our own item table as clauses: any wanted genre,
    no avoided one, language, year or years, runtime, any keyword, any actor,
    any director, and the floors of the ranking mode."""
    mode = i["ranking_mode"]
    votes, rating = F.lit(DISCOVER_FLOORS[""][0]), F.lit(DISCOVER_FLOORS[""][1])
    for name, (v, r) in DISCOVER_FLOORS.items():
        if name:
            votes = F.when(mode == name, v).otherwise(votes)
            rating = F.when(mode == name, r).otherwise(rating)
    code = _code(i["language"], DISCOVER_LANGUAGES)
    exact, span = i["release_year"], i["year_range"]
    avoid = lowered(i["avoid_genres"])
    lists = {
        "genres": lowered(i["genres"]),
        "keywords": lowered(F.concat(i["keywords"], i["themes"], i["moods"])),
        "cast": lowered(i["preferred_actors"]),
        "directors": lowered(i["preferred_directors"]),
    }
    unknown = avoid.isNull()
    for values in lists.values():
        unknown = unknown | values.isNull()
    return all_of(
        *[some_of(field, values) for field, values in lists.items()],
        some_of("languages", F.when(code.isNotNull(), F.array(code))),
        none_of("genres", avoid),
        within("release_year", F.coalesce(exact, span["start"]), F.coalesce(exact, span["end"])),
        within("runtime_minutes", high=i["runtime"]),
        within("vote_count", F.nullif(votes, F.lit(0))),
        within("rating_value", F.nullif(rating, F.lit(0.0))),
        unless=unknown,
    )


def discover(
    items: DataFrame, queries: DataFrame, pages: int = 3, page_size: int = 20
) -> DataFrame:
    """First pages per query by popularity, with `position` and `page`: item
    rows with query_id and intent. Pairs carry the popularity alone until the
    pages are known."""
    queries = settle(queries.select("query_id", "intent"), "queries")
    asked = queries.select("query_id", discovery_demands(F.col("intent")).alias("demands"))
    pairs = _pairs(discovery_fields(items), asked, DISCOVERY_LISTS, DISCOVERY_NUMBERS)
    ranked = top_k(
        pairs.join(items.select("item_id", "popularity"), "item_id"),
        ["query_id"],
        [F.col("popularity").desc_nulls_last(), F.asc("item_id")],
        pages * page_size,
        "position",
    ).drop("popularity")
    paged = ranked.withColumn(
        "page", (F.floor((F.col("position") - 1) / page_size) + 1).cast("int")
    )
    return items.join(paged, "item_id").join(queries.select("query_id", "intent"), "query_id")
