"""Query understanding over the typed-query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import understanding as U
from curatrix.operators import lookups as K
from curatrix.plans import routing as R
from curatrix.schema import make_intent
from curatrix.session import settle

from . import query
from .fixtures import asks, cte, items, log, table

_Q = "lower(text)"


def w(words: str) -> str:
    words = words.replace("'", "''")
    return rf"regexp_matches({_Q}, '\b(?:{words})\b')"


def first(rules, default: str = "null") -> str:
    return (
        "case " + " ".join(f"when {w(a)} then '{v}'" for a, v in rules) + f" else {default} end"
    )


def contains(rules, default: str = "null") -> str:
    arms = " ".join(
        "when " + " or ".join(f"contains({_Q}, '{p}')" for p in parts)
        + f" then {v if isinstance(v, float) else repr(v)}"
        for parts, v in rules
    )
    return f"case {arms} else {default} end"


def found(pairs) -> str:
    """Distinct values of the terms found, in dictionary order."""
    arms = ", ".join(f"case when {w(t)} then '{v}' end" for t, v in pairs)
    return f"list_filter([{arms}], lambda x: x is not null)"


_CLASS = f"""case when {w(U.LOOKUP_WORDS)} then 'movie_lookup'
    when {w(U.SEARCH_WORDS)} and not {w(U.RECOMMEND_WORDS)} then 'general_search'
    else 'recommendation' end"""
_MODE = first(
    [(U.BEST_WORDS, "best"), (U.SIMILAR_WORDS, "similar_movie"), (U.MOOD_WORDS, "mood")],
    "'default'",
)
_GENRES = f"""list_distinct({found([(g, U.GENRE_NAMES[g]) for g in U.QUERY_GENRES])})"""


def show(df, **columns):
    return df.select("query_id", *[c.alias(n) for n, c in columns.items()])


def text_list(c):
    return F.array_join(c, "|")


@query("q1_query_class", cte("log") + f"select query_id, {_CLASS} as class from log")
def q1(spark, sf):
    return show(log(spark, sf), **{"class": U.query_class(F.col("text"))})


@query("q2_ranking_mode", cte("log") + f"select query_id, {_MODE} as mode from log")
def q2(spark, sf):
    return show(log(spark, sf), mode=U.ranking_mode(F.col("text")))


@query(
    "q3_genres",
    cte("log")
    + f"""select query_id, array_to_string(list_sort({_GENRES}), '|') as genres from log""",
)
def q3(spark, sf):
    return show(log(spark, sf), genres=text_list(F.array_sort(U.query_genres(F.col("text")))))


@query(
    "q4_moods_themes",
    cte("log")
    + f"""select query_id, array_to_string({found([(m, m) for m in U.MOODS])}, '|') as moods,
      array_to_string({found([(m, m) for m in U.THEMES])}, '|') as themes from log""",
)
def q4(spark, sf):
    t = F.col("text")
    return show(
        log(spark, sf), moods=text_list(U.query_moods(t)), themes=text_list(U.query_themes(t))
    )


def _year(pattern: str, group: int = 1) -> str:
    pattern = pattern.replace("(?U)", "")
    return f"try_cast(nullif(regexp_extract({_Q}, '{pattern}', {group}), '') as int)"


@query(
    "q5_years",
    cte("log")
    + f"""select query_id,
      case when a is null and after is null and before is null then single end as release_year,
      case when a is not null then a when after is not null then after
        when before is null then single end as start,
      case when a is not null then b when after is not null then null
        when before is not null then before else single end as "end"
      from (select query_id, {_year(U.YEAR_SPAN_PATTERN)} as a, {_year(U.YEAR_SPAN_PATTERN, 2)}
        as b, {_year(U.YEAR_AFTER_PATTERN)} as after, {_year(U.YEAR_BEFORE_PATTERN)} as before,
        {_year(U.YEAR_PATTERN)} as single from log)""",
)
def q5(spark, sf):
    y = U.query_years(F.col("text"))
    return show(log(spark, sf), release_year=y["release_year"], start=y["start"], end=y["end"])


_EXCLUDED = rf"""list_filter(list_transform(regexp_split_to_array(regexp_extract({_Q},
    '{U.EXCLUSION_PATTERN.replace("(?U)", "")}', 1), ',|\band\b'), lambda p: trim(p)),
    lambda p: p <> '')"""


@query(
    "q6_exclusions",
    cte("log")
    + f"""select query_id, array_to_string(parts, '|') as exclusions, array_to_string(
      list_filter(list_transform(parts, lambda p: case p when 'horror' then 'Horror'
        when 'comedy' then 'Comedy' when 'romance' then 'Romance' when 'western' then 'Western'
        end), lambda g: g is not null), '|') as avoid
      from (select query_id, {_EXCLUDED} as parts from log)""",
)
def q6(spark, sf):
    t = F.col("text")
    return show(
        log(spark, sf),
        exclusions=text_list(U.query_exclusions(t)),
        avoid=text_list(U.excluded_genres(t)),
    )


def _cut(x: str) -> str:
    stop = U.TITLE_STOP_PATTERN.replace("(?iU)", "")
    return f"trim(regexp_replace({x}, '(?is){stop}.*$', ''))"


_REF = U.REFERENCE_PATTERN.replace("(?U)", "")
_LOOKED = U.LOOKUP_TITLE_PATTERN.replace("(?U)", "")
_NOISE = U.LOOKUP_NOISE_PATTERN.replace("(?iU)", "(?i)")
_TITLES = f"""case when sim <> '' then {_cut('sim')} when class = 'movie_lookup' then
    case when looked <> '' then {_cut('looked')}
    else trim(regexp_replace(text, '{_NOISE}', '', 'g')) end end"""


@query(
    "q7_referenced_titles",
    cte("log")
    + f"""select query_id, coalesce({_TITLES}, '') as titles from (select query_id, text,
      regexp_extract(text, '{_REF}', 1) as sim, regexp_extract(text, '{_LOOKED}', 1) as looked,
      {_CLASS} as class from log)""",
)
def q7(spark, sf):
    return show(log(spark, sf), titles=text_list(U.query_references(F.col("text"))))


@query(
    "q8_people",
    cte("log")
    + f"""select query_id, regexp_extract(text, '{U.ACTOR_PATTERN.replace("(?U)", "")}', 1)
      as actors, regexp_extract(text, '{U.DIRECTOR_PATTERN.replace("(?U)", "")}', 1)
      as directors from log""",
)
def q8(spark, sf):
    t = F.col("text")
    return show(
        log(spark, sf),
        actors=text_list(U.query_actors(t)),
        directors=text_list(U.query_directors(t)),
    )


@query(
    "q9_preferences",
    cte("log")
    + "select query_id, "
    + ", ".join(f"{first(rules)} as {n}" for n, rules in U.PREFERENCES.items())
    + " from log",
)
def q9(spark, sf):
    t = F.col("text")
    return show(log(spark, sf), **{n: U.query_preference(t, n) for n in U.PREFERENCES})


@query(
    "q10_country_studio",
    cte("log")
    + f"""select query_id, {contains(U.COUNTRIES)} as country, {contains(U.STUDIOS)} as studio
      from log""",
)
def q10(spark, sf):
    t = F.col("text")
    return show(log(spark, sf), country=U.query_country(t), studio=U.query_studio(t))


@query(
    "q11_exact_title_route",
    cte("items", "log")
    + """select l.query_id, t.title from log l join (select lower(title) as k, min(title) as title
      from items group by 1) t on t.k = lower(trim(l.text))""",
)
def q11(spark, sf):
    return K.exact_titles(items(spark, sf), log(spark, sf))


_STOP = "[" + ", ".join(f"'{x}'" for x in U.NON_PERSON_WORDS) + "]"


def _person(pattern: str) -> str:
    got = f"trim(regexp_extract({_Q}, '{pattern.replace('(?U)', '')}', 1))"
    words = rf"list_filter(regexp_split_to_array({got}, '\s+|-'), lambda x: x <> '')"
    return f"case when len({words}) > 0 and not list_has_any({words}, {_STOP}) then {got} end"


_NAME = f"coalesce({', '.join(_person(p) for p in U.PERSON_PATTERNS)})"


def _any(parts) -> str:
    return "(" + " or ".join(f"contains({_Q}, '{p}')" for p in parts) + ")"


@query(
    "q12_person_route",
    cte("log")
    + rf"""select query_id, list_aggregate(list_transform(regexp_split_to_array(n, '\s+'),
      lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') as name,
      {_any(U.DIRECTOR_HINTS)} or (contains({_Q}, 'films') and not {_any(U.ACTOR_HINTS)})
        as is_director,
      cast({contains(U.PERSON_CONFIDENCE, str(U.PERSON_CONFIDENCE_ELSE))} as double) as confidence
      from (select query_id, text, {_NAME} as n from log) where n is not null""",
)
def q12(spark, sf):
    rows = U.with_person_route(log(spark, sf)).where(F.col("route")["name"].isNotNull())
    return rows.select("query_id", "route.name", "route.is_director", "route.confidence")


_SIMPLE = "[" + ", ".join(f"'{x}'" for x in U.SIMPLE_GENRE_WORDS + U.FILLER_WORDS) + "]"


@query(
    "q13_simple_queries",
    cte("log")
    + f"""select query_id, len(t) <= 3 and len(list_filter(t, lambda x: not
      list_contains({_SIMPLE}, x))) = 0 as simple from (select query_id,
      regexp_extract_all({_Q}, '[a-zA-Z0-9\\-]+') as t from log)""",
)
def q13(spark, sf):
    return show(log(spark, sf), simple=U.is_simple_query(F.col("text")))


def _fires(key: str) -> str:
    spelled = U.THEME_SPELLINGS.get(key)
    extra = f" or contains({_Q}, '{spelled}')" if spelled else ""
    return (
        f"(contains({_Q}, '{key}') or len(list_filter(elements, lambda e: contains(e, '{key}'))) "
        f"> 0{extra})"
    )


def _added(side: int) -> str:
    arms = ", ".join(
        f"case when {_fires(k)} then ["
        + ", ".join(f"'{v}'" for v in rule[side])
        + "] else [] end"
        for k, rule in U.THEME_RULES.items()
    )
    return f"flatten([{arms}])"


@query(
    "q14_theme_expansion_j16",
    cte("asks")
    + f""", e as (select query_id, text, genres, keywords, list_transform(genres || keywords
      || themes || moods || list_filter([complexity, pacing], lambda x: x is not null),
      lambda x: lower(x)) as elements from asks)
      select query_id, array_to_string(list_sort(list_distinct(genres || {_added(0)})), '|')
        as genres, array_to_string(list_sort(list_distinct(keywords || {_added(1)})), '|')
        as keywords, array_to_string(genres, '|') as explicit from e""",
)
def q14(spark, sf):
    done = U.expand_themes(asks(spark, sf))
    i = F.col("intent")
    return show(
        done,
        genres=text_list(F.array_sort(i["genres"])),
        keywords=text_list(F.array_sort(i["keywords"])),
        explicit=text_list(i["explicit_genres"]),
    )


@query(
    "q14_theme_expansion_of_log",
    cte("log")
    + f""", e as (select query_id, text, list_transform({_GENRES}
        || {found([(m, m) for m in U.THEMES])} || {found([(m, m) for m in U.MOODS])}
        || list_filter([{first(U.PREFERENCES['complexity'])}, {first(U.PREFERENCES['pacing'])}],
        lambda x: x is not null), lambda x: lower(x)) as elements, {_GENRES} as genres from log)
      select query_id, array_to_string(list_sort(list_distinct(genres || {_added(0)})), '|')
        as genres, array_to_string(list_sort(list_distinct({_added(1)})), '|') as keywords
      from e""",
)
def q14_log(spark, sf):
    rows = log(spark, sf).withColumn("intent", U.heuristic_intent(F.col("text")))
    done = U.expand_themes(settle(rows, "intents"))
    i = F.col("intent")
    return show(
        done,
        genres=text_list(F.array_sort(i["genres"])),
        keywords=text_list(F.array_sort(i["keywords"])),
    )


@query(
    "q15_intent_label",
    cte("log")
    + f""", e as (select query_id, {_CLASS} as class, {_MODE} as mode, {_GENRES} as genres,
      {found([(m, m) for m in U.MOODS])} as moods, {found([(m, m) for m in U.THEMES])} as themes,
      coalesce({_TITLES}, '') <> '' as refs,
      regexp_extract(text, '{U.ACTOR_PATTERN.replace("(?U)", "")}', 1) <> '' as actors,
      regexp_extract(text, '{U.DIRECTOR_PATTERN.replace("(?U)", "")}', 1) <> '' as directors
      from (select query_id, text, regexp_extract(text, '{_REF}', 1) as sim,
        regexp_extract(text, '{_LOOKED}', 1) as looked, {_CLASS} as class from log))
      select query_id, case
        when class = 'movie_lookup' or (refs and mode = 'default' and len(genres) = 0
          and not actors and not directors) then 'Movie Lookup'
        when refs and mode = 'similar_movie' then 'Similar Movie Recommendation'
        when len(moods) + len(themes) > 0 then 'Mood Recommendation'
        when len(genres) > 0 and not refs then 'Genre Recommendation'
        when class = 'general_search' then 'General Search' else 'Recommendation' end as label
      from e""",
)
def q15(spark, sf):
    rows = settle(
        log(spark, sf).select("query_id", U.heuristic_intent(F.col("text")).alias("intent")),
        "intents",
    )
    return show(rows, label=U.intent_label(F.col("intent")))


@query(
    "q16_completion_normalise",
    """select event_id as query_id,
      case event_id % 7 when 0 then 'Science Fiction|Film Noir' when 2 then 'War' else '' end
        as genres,
      case event_id % 7 when 0 then 'mood' when 4 then 'similar' when 5 then 'best'
        else 'default' end as mode,
      case event_id % 7 when 0 then 'Alien|Heat' when 2 then 'Solo' else '' end as titles,
      case event_id % 7 when 4 then cast(1980 + user_id as int) end as year_from
      from events where event_id % 7 not in (1, 6)""",
)
def q16(spark, sf):
    k = F.col("event_id") % 7
    e = table(spark, sf, "events")
    raw = (
        F.when(
            k == 0,
            '```json\n{"genres": ["sci-fi", "film noir"], "ranking_mode": " Mood ", '
            '"movie_name": "Alien", "similar_movies": ["Heat"]}\n```',
        )
        .when(k == 1, '{"genres": ["drama", "war"')
        .when(k == 2, '```{"genres": ["war",], "similar_movies": "Solo",')
        .when(k == 3, F.col("props"))
        .when(
            k == 4,
            F.concat(
                F.lit('{"ranking_mode": "most similar", "year_range": {"start": '),
                (F.col("user_id") + 1980).cast("string"),
                F.lit(', "end": null}, "mood": ["dark"]}'),
            ),
        )
        .when(k == 5, '{"ranking_mode": "the best", "runtime": 90')
        .otherwise("sorry, no")
    )
    done = U.completion_intents(e.select(F.col("event_id").alias("query_id"), raw.alias("raw")))
    done = done.where(F.col("intent").isNotNull())
    i = F.col("intent")
    return show(
        done,
        genres=text_list(i["genres"]),
        mode=i["ranking_mode"],
        titles=text_list(i["similar_movies"]),
        year_from=i["year_range"]["start"],
    )


@query(
    "q17_record_to_intent_f45",
    cte("asks")
    + """select query_id, array_to_string(genres, '|') as genres,
      array_to_string(list_filter([nullif(array_to_string(moods, ', '), '')], lambda m: m is not
        null), '|') as moods, array_to_string(themes, '|') as keywords, language,
      year_from as start, year_to as "end", array_to_string(list_transform(avoid_genres,
        lambda g: upper(g[1]) || g[2:]), '|') as avoid, true as soft,
      case when year_from = year_to then year_from end as exact_year from asks""",
)
def q17(spark, sf):
    rows = settle(asks(spark, sf).withColumn("u", U.understanding_record(F.col("intent"))), "u")
    rows = rows.withColumn("i", U.record_intent(F.col("u")))
    i = F.col("i")
    from curatrix.functions.text import canonical_genres

    return show(
        rows,
        genres=text_list(i["genres"]),
        moods=text_list(i["moods"]),
        keywords=text_list(i["keywords"]),
        language=i["language"],
        start=i["year_range"]["start"],
        end=i["year_range"]["end"],
        avoid=text_list(canonical_genres(i["avoid_genres"])),
        soft=i["legacy_soft_genre"],
        exact_year=F.col("u.exact_year"),
    )


@query(
    "q19_people_validation",
    cte("items")
    + """, asked as (select c_custkey as query_id, case c_custkey % 3 when 0
        then 'supplier#' || lpad(cast(c_custkey % 400 as varchar), 9, '0')
        when 1 then 'Brand#' || (c_custkey % 60) else 'Nobody' end as name from customer),
      known as (select distinct lower(p) as p from (select unnest(people) as p from items
        union all select unnest(directors) from items))
      select query_id, case when k.p is not null then name else '' end as directors,
        k.p is not null as strict from asked a left join known k on k.p = lower(a.name)""",
)
def q19(spark, sf):
    c = F.col("c_custkey")
    name = (
        F.when(
            c % 3 == 0,
            F.concat(F.lit("supplier#"), F.lpad((c % 400).cast("string"), 9, "0")),
        )
        .when(c % 3 == 1, F.concat(F.lit("Brand#"), (c % 60).cast("string")))
        .otherwise("Nobody")
    )
    rows = table(spark, sf, "customer").select(c.alias("query_id"), name.alias("name"))
    rows = rows.select(
        "query_id",
        make_intent(
            preferred_directors=F.array("name"), strict_person_filter=F.lit(True)
        ).alias("intent"),
    )
    done = K.validated_people(items(spark, sf), settle(rows, "people"))
    i = F.col("intent")
    return show(
        done,
        directors=text_list(i["preferred_directors"]),
        strict=i["strict_person_filter"],
    )


@query("q0_understand_log")
def understand(spark, sf):
    """Whole understanding job, fuzzy titles included."""
    done = R.understand(log(spark, sf).select("query_id", "text"), items(spark, sf))
    i = F.col("intent")
    return show(
        done, routed=F.col("routed"), label=F.col("label"), pathway=F.col("pathway"),
        genres=text_list(i["genres"]), keywords=text_list(i["keywords"]),
    )
