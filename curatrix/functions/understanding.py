"""Rule-based query understanding as Column expressions over query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import make_intent, with_intent
from .text import GENRE_NAMES, canonical_genres, empty_if_null, lowered

# ---------------------------------------------------------------------------
# The wording every rule fires on.
# ---------------------------------------------------------------------------
LOOKUP_WORDS = "tell me about|details for|lookup|show details|info for|trailer|details|about"
SEARCH_WORDS = "search|find|list|show me|movies directed by|movies from"
RECOMMEND_WORDS = "recommend|like|similar to|suggest|recommendation"

BEST_WORDS = "best|top|masterpiece|award|oscar|highly rated|acclaimed"
SIMILAR_WORDS = "like|similar to|resemble|type of"
MOOD_WORDS = (
    "dark|funny|feel-good|scary|romantic|intense|thrilling|spooky|creepy|hilarious|"
    "heartwarming|suspenseful|comedy"
)

QUERY_GENRES = [
    "action",
    "adventure",
    "animation",
    "comedy",
    "crime",
    "documentary",
    "drama",
    "family",
    "fantasy",
    "history",
    "horror",
    "music",
    "mystery",
    "romance",
    "science fiction",
    "sci-fi",
    "tv movie",
    "thriller",
    "war",
    "western",
]
MOODS = [
    "dark",
    "funny",
    "feel-good",
    "scary",
    "romantic",
    "intense",
    "thrilling",
    "spooky",
    "creepy",
    "hilarious",
    "heartwarming",
    "suspenseful",
]
THEMES = [
    "mind-bending",
    "heist",
    "time travel",
    "space travel",
    "revenge",
    "dystopian",
    "cyberpunk",
    "magic",
]

YEAR = r"19\d{2}|20\d{2}"
YEAR_SPAN_PATTERN = rf"(?U)\b(?:between\s+)?({YEAR})\s*(?:and|to|-)\s*({YEAR})\b"
YEAR_AFTER_PATTERN = rf"(?U)\b(?:after|since)\s+({YEAR})\b"
YEAR_BEFORE_PATTERN = rf"(?U)\b(?:before|until)\s+({YEAR})\b"
YEAR_PATTERN = rf"(?U)\b({YEAR})\b"

EXCLUSION_PATTERN = (
    r"(?U)\b(?:without|no|except|excluding|avoid|minus)\s+([a-zA-Z0-9\s,-]+)"
)
EXCLUSION_SPLIT = r"(?U),|\band\b"
REFERENCE_PATTERN = r"(?U)\b(?:like|similar to|similar)\s+([A-Z][a-zA-Z0-9\s:\-\.]+)"
LOOKUP_TITLE_PATTERN = (
    r"(?U)\b(?:about|details for|lookup|show details|info for|details)\s+"
    r"([A-Z][a-zA-Z0-9\s:\-\.]+)"
)
TITLE_STOP_PATTERN = (
    r"(?iU)\b(?:without|no|except|excluding|avoid|minus|starring|directed by|in|from|between)\b"
)
LOOKUP_NOISE_PATTERN = (
    r"(?iU)\b(?:tell me about|details for|lookup|show details|info for|details|info|about)\b"
)
ACTOR_PATTERN = r"(?U)\b(?:starring|with|actors|actor)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"
DIRECTOR_PATTERN = r"(?U)\b(?:directed by|director)\s+([A-Z][a-z]+\s+[A-Z][a-z]+)"

# One ordered list of (words, value) per preference; the first hit wins.
PREFERENCES = {
    "popularity_preference": [
        ("hidden gem|underrated|unappreciated|niche|unknown|obscure", "hidden_gem"),
        ("popular|blockbuster|famous|hit|mainstream", "popular"),
    ],
    "critical_acclaim_preference": [
        ("best|top|masterpiece|acclaimed|highly rated|critically acclaimed", "high"),
    ],
    "novelty_preference": [
        ("classic|old|vintage|golden era|retro|ancient", "classic"),
        ("recent|new|modern|latest|recently released", "recent"),
        ("trending|popular right now|viral|now popular", "trending"),
        ("upcoming|soon|future", "upcoming"),
    ],
    "awards_preference": [
        ("oscar|academy award", "oscar"),
        ("cannes|palme d'or|palme dor", "palme_d_or"),
        ("sundance", "sundance"),
        ("bafta", "bafta"),
        ("golden globe", "golden_globe"),
        ("award winner|award-winning|awards", "any"),
    ],
    "complexity": [
        (
            "mind-bending|mindbending|psychological|complex|complicated|intellectual|cerebral",
            "mind_bending",
        ),
        ("simple|straightforward|light|easy|popcorn", "simple"),
    ],
    "pacing": [
        ("slow burn|slow-burn|slowly paced|slow paced|atmospheric", "slow_burn"),
        (
            "fast paced|fast-paced|fast pacing|action packed|action-packed|quick paced",
            "fast_paced",
        ),
    ],
    "family_safety": [
        ("family|kids|children|pg|family safe|family-safe|for kids", "family_safe"),
        ("adult|mature|r-rated|restricted|nsfw|sex|nudity", "mature"),
    ],
    "violence_level": [
        ("bloody|violent|gore|gory|brutal|bloodbath", "high"),
        ("non-violent|no violence|non violent|peaceful", "low"),
    ],
}
# Plain substrings, not words.
COUNTRIES = [
    (["korean", "korea"], "South Korea"),
    (["japanese", "japan"], "Japan"),
    (["french", "france"], "France"),
    (["spanish", "spain"], "Spain"),
    (["italian", "italy"], "Italy"),
    (["british", "uk", "united kingdom"], "United Kingdom"),
]
STUDIOS = [
    (["ghibli"], "Studio Ghibli"),
    (["pixar"], "Pixar"),
    (["marvel"], "Marvel Studios"),
    (["a24"], "A24"),
    (["disney"], "Disney"),
]

PERSON_PATTERNS = [
    r"(?U)^(?:movies?|films?)\s+(?:by|directed by|from)\s+(.+)$",
    r"(?U)^(?:movies?|films?)\s+(?:with|starring|featuring)\s+(.+)$",
    r"(?U)^(.+?)\s+(?:movies?|films?|filmography|directed)$",
    r"(?U)^(?:directed by|films? by)\s+(.+)$",
]
NON_PERSON_WORDS = [
    "recommend", "sci-fi", "science fiction", "horror", "drama", "comedy", "thriller",
    "action", "romance", "romantic", "mystery", "documentary", "family", "fantasy",
    "history", "music", "war", "western", "adventure", "mind-bending", "heist",
    "time travel", "space", "dystopian", "cyberpunk", "magic", "emotional", "sad",
    "happy", "funny", "scary", "intense", "thrilling", "spooky", "creepy", "hilarious",
    "heartwarming", "suspenseful", "best", "top", "good", "great", "nice", "excellent",
    "award", "oscar", "make me cry", "detective", "psychological", "exploration",
    "classic", "recent", "underrated", "movies", "films", "movie", "film", "suggest",
    "recommendation", "recommendations", "show", "shows", "about", "like", "similar",
    "tell", "me",
]
DIRECTOR_HINTS = ["directed by", "director", "directed", "by", "filmography"]
ACTOR_HINTS = ["with", "starring", "featuring", "actor", "actress"]
# Ordered (any of these substrings, confidence).
PERSON_CONFIDENCE = [
    (["starring"], 0.98),
    (["directed by"], 0.99),
    (["director", "directed"], 0.95),
    (["actor", "actress"], 0.95),
    (["with"], 0.90),
    (["featuring"], 0.92),
    (["movies by", "films by"], 0.98),
    (["filmography"], 0.99),
]
PERSON_CONFIDENCE_ELSE = 0.88

SIMPLE_GENRE_WORDS = [
    "action", "adventure", "animation", "comedy", "crime", "documentary", "drama",
    "family", "fantasy", "history", "horror", "music", "mystery", "romance", "sci-fi",
    "science-fiction", "science fiction", "thriller", "war", "western",
]
FILLER_WORDS = [
    "movie", "movies", "film", "films", "show", "shows", "best", "top", "good", "nice",
    "a", "the", "like",
]

# Theme rules: key -> (genres to add, keywords to add).
THEME_RULES = {
    "superhero": (
        ["Action", "Fantasy"],
        ["superhero", "super power", "comic book", "masked superhero",
         "marvel cinematic universe", "dc extended universe"],
    ),
    "mind-bending": (
        ["Mystery", "Thriller"],
        ["mind-bending", "twist ending", "unreliable narrator", "reality distortion",
         "hallucination", "psychological"],
    ),
    "time travel": (
        ["Science Fiction"],
        ["time travel", "time loop", "wormhole", "temporal loop"],
    ),
    "space": (
        ["Science Fiction", "Adventure"],
        ["outer space", "space travel", "astronaut", "spaceship", "alien", "galaxy"],
    ),
    "prison escape": (
        ["Thriller", "Action", "Drama"],
        ["prison escape", "jailbreak", "prison", "escape"],
    ),
    "heist": (
        ["Crime", "Thriller"],
        ["heist", "bank robbery", "caper", "robbery", "thief"],
    ),
    "serial killer": (
        ["Crime", "Thriller", "Mystery"],
        ["serial killer", "psychopathic killer", "investigation", "murder mystery"],
    ),
    "artificial intelligence": (
        ["Science Fiction"],
        ["artificial intelligence", "android", "cyborg", "robot", "sentient computer"],
    ),
    "cyberpunk": (
        ["Science Fiction"],
        ["cyberpunk", "dystopia", "futuristic", "megacorporation", "neon"],
    ),
    "zombie": (
        ["Horror", "Action"],
        ["zombie", "undead", "apocalypse", "zombie apocalypse"],
    ),
    "spy": (
        ["Action", "Thriller"],
        ["spy", "espionage", "secret agent", "covert operation", "cia", "mi6"],
    ),
    "coming of age": (
        ["Drama", "Comedy"],
        ["coming of age", "teenage life", "adolescence", "growing up"],
    ),
    "courtroom": (
        ["Drama"],
        ["courtroom", "legal drama", "trial", "lawyer", "justice system"],
    ),
    "sports": (
        ["Drama"],
        ["sports", "athlete", "coach", "boxing", "football", "baseball", "tournament"],
    ),
    "war": (
        ["War", "History"],
        ["war", "soldier", "military", "battle", "combat"],
    ),
    "historical": (
        ["History", "Drama"],
        ["historical", "period piece", "biography", "true story"],
    ),
    "political": (
        ["Drama", "Thriller"],
        ["politics", "political corruption", "government", "conspiracy"],
    ),
    "musical": (
        ["Music", "Romance"],
        ["musical", "singing", "dancing"],
    ),
    "adventure": (
        ["Adventure"],
        ["adventure", "quest", "journey", "exploration"],
    ),
    "psychological": (
        ["Mystery", "Thriller", "Drama"],
        ["psychological", "mental illness", "identity crisis", "paranoia"],
    ),
    "survival": (
        ["Thriller", "Adventure", "Drama"],
        ["survival", "stranded", "wilderness survival", "hostile environment"],
    ),
    "noir": (
        ["Crime", "Mystery", "Thriller"],
        ["neo-noir", "film noir", "detective", "femme fatale", "cynical"],
    ),
}
# Other spellings, looked for in the query text only.
THEME_SPELLINGS = {
    "mind-bending": "mind bending",
    "coming of age": "coming-of-age",
    "prison escape": "prison-escape",
    "serial killer": "serial-killer",
    "courtroom": "court room",
    "time travel": "time-travel",
}
COMPLETION_MODES = ["best", "similar", "mood", "discover", "classic", "underrated", "recent"]
# ---------------------------------------------------------------------------


def has_word(text: Column, alternatives: str) -> Column:
    """True when one of the alternatives occurs between word boundaries."""
    return text.rlike(rf"(?U)\b(?:{alternatives})\b")


def first_hit(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first rule whose words occur, else null."""
    out = F.lit(None).cast("string")
    for words, value in reversed(rules):
        out = F.when(has_word(text, words), F.lit(value)).otherwise(out)
    return out


def first_substring(text: Column, rules: list[tuple[list[str], object]], default=None) -> Column:
    out = F.lit(default)
    for parts, value in reversed(rules):
        hit = F.lit(False)
        for part in parts:
            hit = hit | text.contains(part)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured text or null; none of the groups used can be empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _one(value: Column) -> Column:
    """One-element list, or an empty one for null and ''."""
    return F.filter(F.array(value), lambda x: x.isNotNull() & (x != ""))


def query_class(text: Column) -> Column:
    q = F.lower(text)
    return (
        F.when(has_word(q, LOOKUP_WORDS), "movie_lookup")
        .when(has_word(q, SEARCH_WORDS) & ~has_word(q, RECOMMEND_WORDS), "general_search")
        .otherwise("recommendation")
    )


def ranking_mode(text: Column) -> Column:
    q = F.lower(text)
    return F.coalesce(
        first_hit(
            q, [(BEST_WORDS, "best"), (SIMILAR_WORDS, "similar_movie"), (MOOD_WORDS, "mood")]
        ),
        F.lit("default"),
    )


def _dictionary_hits(text: Column, terms: list[str], names=lambda t: t) -> Column:
    q = F.lower(text)
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(has_word(q, t), F.lit(names(t))) for t in terms]))
    )


def query_genres(text: Column) -> Column:
    return _dictionary_hits(text, QUERY_GENRES, GENRE_NAMES.__getitem__)


def query_moods(text: Column) -> Column:
    return _dictionary_hits(text, MOODS)


def query_themes(text: Column) -> Column:
    return _dictionary_hits(text, THEMES)


def query_years(text: Column) -> Column:
    """struct(release_year, start, end) by the first form found: a span,
    an open start, an open end, a single year."""
    q = F.lower(text)
    a, b = (_capture(q, YEAR_SPAN_PATTERN, i).cast("int") for i in (1, 2))
    after = _capture(q, YEAR_AFTER_PATTERN).cast("int")
    before = _capture(q, YEAR_BEFORE_PATTERN).cast("int")
    single = _capture(q, YEAR_PATTERN).cast("int")
    open_span = a.isNull() & after.isNull() & before.isNull()
    return F.struct(
        F.when(open_span, single).alias("release_year"),
        F.when(a.isNotNull(), a)
        .when(after.isNotNull(), after)
        .when(open_span, single)
        .alias("start"),
        F.when(a.isNotNull(), b)
        .when(after.isNotNull(), F.lit(None).cast("int"))
        .when(before.isNotNull(), before)
        .otherwise(single)
        .alias("end"),
    )


def query_exclusions(text: Column) -> Column:
    tail = F.coalesce(_capture(F.lower(text), EXCLUSION_PATTERN), F.lit(""))
    parts = F.split(tail, EXCLUSION_SPLIT)
    return F.filter(F.transform(parts, _strip), lambda p: p != "")


def excluded_genres(text: Column) -> Column:
    known = F.array(*[F.lit(g) for g in QUERY_GENRES])
    return canonical_genres(
        F.filter(query_exclusions(text), lambda p: F.array_contains(known, p))
    )


def _cut_title(c: Column) -> Column:
    return _strip(F.split(_strip(c), TITLE_STOP_PATTERN, 2)[0])


def query_references(text: Column) -> Column:
    """Titles the query refers to; capitals matter."""
    similar = _capture(text, REFERENCE_PATTERN)
    looked_up = _capture(text, LOOKUP_TITLE_PATTERN)
    bare = _strip(F.regexp_replace(text, LOOKUP_NOISE_PATTERN, ""))
    title = (
        F.when(similar.isNotNull(), _cut_title(similar))
        .when(
            query_class(text) == "movie_lookup",
            F.when(looked_up.isNotNull(), _cut_title(looked_up)).otherwise(bare),
        )
    )
    return _one(title)


def query_actors(text: Column) -> Column:
    return _one(_strip(_capture(text, ACTOR_PATTERN)))


def query_directors(text: Column) -> Column:
    return _one(_strip(_capture(text, DIRECTOR_PATTERN)))


def query_preference(text: Column, name: str) -> Column:
    return first_hit(F.lower(text), PREFERENCES[name])


def query_country(text: Column) -> Column:
    return first_substring(F.lower(text), COUNTRIES)


def query_studio(text: Column) -> Column:
    return first_substring(F.lower(text), STUDIOS)


def heuristic_intent(text: Column) -> Column:
    """Intent struct from the word rules alone."""
    years = query_years(text)
    span = F.when(
        years["start"].isNotNull() | years["end"].isNotNull(),
        F.struct(years["start"].alias("start"), years["end"].alias("end")),
    )
    return make_intent(
        intent=query_class(text),
        ranking_mode=ranking_mode(text),
        genres=query_genres(text),
        moods=query_moods(text),
        themes=query_themes(text),
        similar_movies=query_references(text),
        preferred_actors=query_actors(text),
        preferred_directors=query_directors(text),
        year_range=span,
        release_year=years["release_year"],
        exclusions=query_exclusions(text),
        avoid_genres=excluded_genres(text),
        country=query_country(text),
        studio=query_studio(text),
        **{name: query_preference(text, name) for name in PREFERENCES},
    )


def with_person_route(df: DataFrame, text: str = "text", into: str = "route") -> DataFrame:
    """Add struct(name, is_director, confidence); the name is null unless one
    of the patterns captures something free of non-person words. Every pattern
    contains a film word or `directed`, so no separate gate is needed."""
    stop = F.array(*[F.lit(w) for w in NON_PERSON_WORDS])
    q = F.col("_q")

    def accepted(got: Column) -> Column:
        words = F.filter(F.split(got, r"(?U)\s+|-"), lambda w: w != "")
        return (F.size(words) > 0) & ~F.arrays_overlap(words, stop)

    def any_of(hints: list[str]) -> Column:
        out = F.lit(False)
        for h in hints:
            out = out | q.contains(h)
        return out

    df = df.withColumn("_q", F.lower(_strip(F.col(text)))).withColumn(
        "_captured", F.array(*[_strip(_capture(F.col("_q"), p)) for p in PERSON_PATTERNS])
    )
    df = df.withColumn("_found", F.get(F.filter("_captured", accepted), 0)).withColumn(
        "_name",
        F.array_join(
            F.transform(
                F.split("_found", r"(?U)\s+"),
                lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)),
            ),
            " ",
        ),
    )
    directs = any_of(DIRECTOR_HINTS) | (q.contains("films") & ~any_of(ACTOR_HINTS))
    sure = first_substring(q, PERSON_CONFIDENCE, PERSON_CONFIDENCE_ELSE)
    named = F.col("_name").isNotNull()
    return df.withColumn(
        into,
        F.struct(
            F.col("_name").alias("name"),
            F.when(named, directs).alias("is_director"),
            F.when(named, sure).alias("confidence"),
        ),
    ).drop("_q", "_captured", "_found", "_name")


def person_intent(route: Column) -> Column:
    """Strict person intent of a resolved route."""
    none = F.array().cast("array<string>")
    return make_intent(
        preferred_directors=F.when(route["is_director"], F.array(route["name"])).otherwise(none),
        preferred_actors=F.when(route["is_director"], none).otherwise(F.array(route["name"])),
        strict_person_filter=F.lit(True),
    )


def is_simple_query(text: Column) -> Column:
    """At most three words, each a genre or a filler."""
    words = F.regexp_extract_all(F.lower(_strip(text)), F.lit(r"[a-zA-Z0-9\-]+"), 0)
    return (F.size(words) <= 3) & F.forall(
        words, lambda w: w.isin(SIMPLE_GENRE_WORDS + FILLER_WORDS)
    )


def expand_themes(df: DataFrame, text: str = "text", intent: str = "intent") -> DataFrame:
    """Add the genres and keywords of every matching theme rule; the genres
    named by the user stay available as explicit_genres."""
    i = F.col(intent)
    q = F.lower(F.col(text))

    def fires(key: str) -> Column:
        hit = q.contains(key) | F.exists("_elements", lambda e: e.contains(key))
        if key in THEME_SPELLINGS:
            hit = hit | q.contains(THEME_SPELLINGS[key])
        return hit

    def added(side: int) -> Column:
        table = F.create_map(
            *[
                x
                for k, rule in THEME_RULES.items()
                for x in (F.lit(k), F.array(*[F.lit(v) for v in rule[side]]))
            ]
        )
        return F.flatten(F.transform("_fired", lambda k: F.try_element_at(table, k)))

    df = df.withColumn("_own", canonical_genres(i["genres"])).withColumn(
        "_elements",
        F.transform(
            F.concat(
                "_own",
                i["keywords"],
                i["themes"],
                i["moods"],
                F.array_compact(F.array(i["complexity"], i["pacing"])),
            ),
            lambda e: F.lower(F.trim(e)),
        ),
    )
    df = df.withColumn(
        "_fired",
        F.array_compact(F.array(*[F.when(fires(k), F.lit(k)) for k in THEME_RULES])),
    )
    return df.withColumn(
        intent,
        with_intent(
            i,
            explicit_genres=F.col("_own"),
            genres=F.concat("_own", F.array_except(added(0), F.col("_own"))),
            keywords=F.concat(i["keywords"], F.array_except(added(1), i["keywords"])),
        ),
    ).drop("_own", "_elements", "_fired")


def intent_label(intent: Column) -> Column:
    """Display class of an intent; the first fitting one."""
    def given(field):
        return F.size(intent[field]) > 0

    mode = intent["ranking_mode"]
    return (
        F.when(
            (intent["intent"] == "movie_lookup")
            | (
                given("similar_movies")
                & (mode == "default")
                & ~given("genres")
                & ~given("preferred_actors")
                & ~given("preferred_directors")
            ),
            "Movie Lookup",
        )
        .when(intent["strict_person_filter"] & given("preferred_directors"), "Director Lookup")
        .when(intent["strict_person_filter"] & given("preferred_actors"), "Actor Lookup")
        .when(
            given("similar_movies") & mode.isin("similar", "similar_movie"),
            "Similar Movie Recommendation",
        )
        .when(given("moods") | given("themes"), "Mood Recommendation")
        .when(given("genres") & ~given("similar_movies"), "Genre Recommendation")
        .when(intent["intent"] == "general_search", "General Search")
        .otherwise("Recommendation")
    )


def pathway(intent: Column, strict_last: bool = False) -> Column:
    """similarity / strict_person / funnel. With strict_last the person test
    runs second and overrides, as in the candidate-assembly flow."""
    similar = (F.size(intent["similar_movies"]) > 0) & intent["ranking_mode"].isin(
        "similar", "similar_movie"
    )
    strict = intent["strict_person_filter"] & (
        (F.size(intent["preferred_directors"]) > 0) | (F.size(intent["preferred_actors"]) > 0)
    )
    first, second = ((strict, "strict_person"), (similar, "similarity"))
    if not strict_last:
        first, second = second, first
    return F.when(*first).when(*second).otherwise("funnel")


# --- model completions -----------------------------------------------------
_LISTED = T.ArrayType(T.StringType())
COMPLETION_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "intent", "ranking_mode", "movie_name", "similar_movies", "language",
            "popularity_preference", "critical_acclaim_preference", "novelty_preference",
            "awards_preference", "complexity", "pacing", "studio", "universe_franchise",
            "country", "streaming_preference", "family_safety", "violence_level",
        )
    ]
    + [
        T.StructField(n, _LISTED)
        for n in (
            "genres", "keywords", "moods", "mood", "themes", "preferred_actors", "actors",
            "preferred_directors", "directors", "avoid_movies", "avoid_genres", "exclusions",
        )
    ]
    + [
        T.StructField("runtime", T.IntegerType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("strict_person_filter", T.BooleanType()),
        T.StructField(
            "year_range",
            T.StructType(
                [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
            ),
        ),
        T.StructField("_broken", T.StringType()),
    ]
)


def unfence(raw: Column) -> Column:
    """Drop a surrounding code fence and blanks."""
    c = F.regexp_replace(_strip(raw), r"^```json", "")
    c = F.regexp_replace(c, r"^```", "")
    return _strip(F.regexp_replace(c, r"```$", ""))


def _surplus(c: Column, opening: str, closing: str) -> Column:
    def count(ch):
        return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))

    return F.greatest(F.lit(0), count(opening) - count(closing))


def repair_json(raw: Column) -> Column:
    """Close open braces, then open brackets, and drop trailing commas."""
    c = unfence(raw)
    balanced = F.concat(
        c,
        F.repeat(F.lit("}"), _surplus(c, "{", "}")),
        F.repeat(F.lit("]"), _surplus(c, "[", "]")),
    )
    return F.regexp_replace(balanced, r",\s*([\]}])", "$1")


def _parse(c: Column) -> Column:
    got = F.from_json(c, COMPLETION_SCHEMA, {"columnNameOfCorruptRecord": "_broken"})
    return F.when(got["_broken"].isNull() & c.startswith("{"), got)


def completion_intents(df: DataFrame, raw: str = "raw", into: str = "intent") -> DataFrame:
    """Add the intent of a raw model completion: parsed as it is, else after
    repair, else null (the caller falls back to the word rules)."""
    df = df.withColumn(
        "_parsed",
        F.coalesce(_parse(unfence(F.col(raw))), _parse(repair_json(F.col(raw)))),
    )
    d = F.col("_parsed")

    def either(*names):
        out = F.array().cast(_LISTED)
        for n in reversed(names):
            out = F.when(F.size(d[n]) > 0, d[n]).otherwise(out)
        return out

    mode = F.lower(F.trim(F.coalesce(d["ranking_mode"], F.lit(""))))
    titles = F.when(
        d["similar_movies"].startswith("["), F.from_json(d["similar_movies"], _LISTED)
    ).otherwise(_one(d["similar_movies"]))
    titles = empty_if_null(titles)
    name = d["movie_name"]
    plain = [
        "language", "runtime", "release_year", "popularity_preference",
        "critical_acclaim_preference", "novelty_preference", "awards_preference",
        "complexity", "pacing", "studio", "universe_franchise", "country",
        "streaming_preference", "family_safety", "violence_level", "year_range",
    ]
    intent = make_intent(
        intent=F.coalesce(F.nullif(d["intent"], F.lit("")), F.lit("recommendation")),
        ranking_mode=F.when(mode.isin(COMPLETION_MODES), mode)
        .when(mode.contains("similar"), "similar")
        .when(mode.contains("best"), "best")
        .otherwise("default"),
        genres=canonical_genres(either("genres")),
        avoid_genres=canonical_genres(either("avoid_genres")),
        similar_movies=F.when(
            name.isNotNull() & (name != "") & ~F.array_contains(titles, name),
            F.concat(F.array(name), titles),
        ).otherwise(titles),
        keywords=either("keywords"),
        moods=either("moods", "mood"),
        themes=either("themes"),
        preferred_actors=either("preferred_actors", "actors"),
        preferred_directors=either("preferred_directors", "directors"),
        avoid_movies=either("avoid_movies"),
        exclusions=either("exclusions"),
        strict_person_filter=F.coalesce(d["strict_person_filter"], F.lit(False)),
        **{n: d[n] for n in plain},
    )
    return df.withColumn(into, F.when(d.isNotNull(), intent)).drop("_parsed")


# --- legacy record ---------------------------------------------------------
def understanding_record(intent: Column) -> Column:
    """Older record form of an intent."""
    span = intent["year_range"]
    kind = intent["intent"]
    has_any = F.lit(False)
    for f in (
        "genres", "moods", "themes", "preferred_actors", "preferred_directors", "similar_movies"
    ):
        has_any = has_any | (F.size(intent[f]) > 0)
    search = F.when(
        kind.isNull() | kind.isin("", "unknown"),
        F.when(has_any, "recommendation").otherwise("search"),
    ).otherwise(kind)
    return F.struct(
        search.alias("search_intent"),
        F.when(F.size(intent["moods"]) > 0, F.array_join(intent["moods"], ", ")).alias("mood"),
        intent["themes"].alias("themes"),
        intent["genres"].alias("genres"),
        intent["preferred_actors"].alias("actors"),
        intent["preferred_directors"].alias("directors"),
        intent["similar_movies"].alias("reference_movies"),
        _one(intent["language"]).alias("preferred_languages"),
        span["start"].alias("start_year"),
        span["end"].alias("end_year"),
        F.when(span["start"] == span["end"], span["start"]).alias("exact_year"),
        intent["avoid_genres"].alias("excluded_genres"),
        F.lit(None).cast("string").alias("user_preferences"),
        intent["ranking_mode"].alias("ranking_mode"),
        intent["release_year"].alias("release_year"),
        intent["exclusions"].alias("exclusions"),
    )


def record_intent(u: Column) -> Column:
    """Intent of an older record; its genres only weigh, they do not filter."""
    return make_intent(
        genres=canonical_genres(u["genres"]),
        moods=_one(u["mood"]),
        themes=u["themes"],
        similar_movies=u["reference_movies"],
        preferred_actors=u["actors"],
        preferred_directors=u["directors"],
        language=F.get(u["preferred_languages"], 0),
        keywords=u["themes"],
        legacy_soft_genre=F.lit(True),
        year_range=F.when(
            u["start_year"].isNotNull() | u["end_year"].isNotNull(),
            F.struct(u["start_year"].alias("start"), u["end_year"].alias("end")),
        ),
        avoid_genres=u["excluded_genres"],
    )


def keyword_preferences(intent: Column) -> Column:
    """Lower-cased keywords, themes and moods, repeats kept."""
    return lowered(F.concat(intent["keywords"], intent["themes"], intent["moods"]))
