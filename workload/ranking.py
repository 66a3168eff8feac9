"""Scores, weighted ranking, mode profiles, match percentage, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import scores as S
from curatrix.functions.text import lowered_set
from curatrix.operators import ranking as K
from curatrix.operators.filters import matching_pairs
from curatrix.session import settle

from . import ORACLE, query
from .fixtures import asks, cte, items
from .retrieval import filter_sql, fused_sql

_PAIRS = f"""
  , pairs as (select q.query_id, q.text, i.*, (i.item_id % 97) / 96.0 as semantic
      from asks q join items i on {filter_sql()})
""" + (_JOINED := """
  , p as (select i.*, q.* exclude (query_id, text, genres, keywords, directors),
      q.genres as q_genres,
      list_distinct(list_transform(coalesce(i.genres, []), lambda x: lower(x))) as g,
      list_distinct(list_transform(coalesce(i.keywords, []), lambda x: lower(x))) as k,
      list_distinct(list_transform(coalesce(i.people, []), lambda x: lower(x))) as c,
      list_distinct(list_transform(coalesce(i.directors, []), lambda x: lower(x))) as d,
      list_distinct(list_transform(q.genres, lambda x: lower(x))) as pg,
      list_distinct(list_transform(q.keywords || q.themes || q.moods, lambda x: lower(x))) as pk,
      list_distinct(list_transform(q.actors, lambda x: lower(x))) as pa,
      list_distinct(list_transform(q.directors, lambda x: lower(x))) as pd,
      coalesce(i.rating_value, 0) as r, coalesce(i.vote_count, 0) as v,
      coalesce(i.popularity, 0) as pop
    from pairs i join (select * exclude (runtime), runtime as q_runtime from asks) q
      on q.query_id = i.query_id)
""")


def pairs(spark, sf):
    """Items that pass a query's filter, with a fixed semantic score."""
    q = settle(K.query_sets(K.with_weights(asks(spark, sf))), "asks")
    i = settle(K.item_sets(items(spark, sf)), "items")
    rows = matching_pairs(i, q).join(i, "item_id").join(q, "query_id")
    return rows.withColumn("semantic", (F.col("item_id") % 97) / F.lit(96.0))


def n(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def share(a: str, b: str, none: float) -> str:
    return f"case when len({b}) = 0 then {none} else {n(a, b)} / len({b}) end"


def clip(x: str) -> str:
    return f"coalesce(least(1.0, greatest(0.0, {x})), 0.0)"


_TERMS = "'" + "|".join(S.AWARD_TERMS) + "'"
_AWARD = (
    f"cast(regexp_matches(lower(concat_ws(' ', title, tagline, overview, "
    f"array_to_string(keywords, ' '))), {_TERMS}) as int)"
)
_GRADE_TEXT = (
    "lower(concat_ws(' ', overview, plot_summary, tagline, title, "
    "array_to_string(keywords, ' ')))"
)
_GRADE = (
    "least(1.0, 0.33 * ("
    + " + ".join(f"cast(contains({_GRADE_TEXT}, '{t}') as int)" for t in S.AWARD_TERMS)
    + "))"
)


def bayes(votes: float, prior: float) -> str:
    return f"((v * r + {votes * prior}) / (v + {votes}) / 10.0)"


_QUALITY = f"(0.85 * {bayes(25000.0, 6.8)} + 0.15 * least(1.0, log10(greatest(1.0, v)) / 7.0))"


@query(
    "f22_f23_f24_ratings",
    cte("items")
    + f"""select item_id, round({bayes(1000.0, 6.5)}, 9) as b1000, round({bayes(150.0, 6.5)}, 9)
      as b150, round({bayes(500.0, 5.5)}, 9) as plain, round({_QUALITY}, 9) as quality
      from (select item_id, coalesce(rating_value, 0) as r, coalesce(vote_count, 0) as v
        from items)""",
)
def f22(spark, sf):
    r, v = F.col("rating_value"), F.col("vote_count")
    return items(spark, sf).select(
        "item_id",
        F.round(S.bayesian_rating(r, v), 9).alias("b1000"),
        F.round(S.bayesian_rating(r, v, 150.0), 9).alias("b150"),
        F.round(S.plain_rating(r, v), 9).alias("plain"),
        F.round(S.quality_rating(r, v), 9).alias("quality"),
    )


@query(
    "f25_log_scales",
    cte("items")
    + """select item_id, round(least(1.0, ln(1 + coalesce(popularity, 0)) / 6), 9) as pop6,
      round(least(1.0, ln(1 + coalesce(popularity, 0)) / 5), 9) as pop5,
      round(least(1.0, ln(1 + coalesce(vote_count, 0)) / 12), 9) as votes12,
      round(least(1.0, ln(1 + coalesce(vote_count, 0)) / 15), 9) as votes15 from items""",
)
def f25(spark, sf):
    p, v = F.col("popularity"), F.col("vote_count")
    return items(spark, sf).select(
        "item_id",
        F.round(S.log_scale(p, 6.0), 9).alias("pop6"),
        F.round(S.log_scale(p, 5.0), 9).alias("pop5"),
        F.round(S.log_scale(v, 12.0), 9).alias("votes12"),
        F.round(S.log_scale(v, 15.0), 9).alias("votes15"),
    )


@query(
    "f26_f27_award_scores",
    cte("items")
    + f"select item_id, cast({_AWARD} as double) as flag, round(cast({_GRADE} as double), 9) as grade from items",
)
def f26(spark, sf):
    c = F.col
    return items(spark, sf).select(
        "item_id",
        S.award_flag(c("title"), c("tagline"), c("overview"), c("keywords")).alias("flag"),
        F.round(
            S.award_grade(
                c("title"), c("tagline"), c("overview"), c("plot_summary"), c("keywords")
            ),
            9,
        ).alias("grade"),
    )


@query(
    "f28_overlap_share",
    cte("items", "asks") + _PAIRS
    + f"""select query_id, item_id, round({share('k', 'pk', 1.0)}, 9) as keyword,
      round({share('g', 'pg', 1.0)}, 9) as genre from p""",
)
def f28(spark, sf):
    rows = K.with_sets(pairs(spark, sf))
    c = F.col
    return rows.select(
        "query_id", "item_id",
        F.round(S.overlap_share(c("_k"), c("_pk"), 1.0), 9).alias("keyword"),
        F.round(S.overlap_share(c("_g"), c("_pg"), 1.0), 9).alias("genre"),
    )


@query(
    "f30_year_ramps",
    cte("items")
    + f"""select item_id, round({clip('(release_year - 1980) / 46.0')}, 9) as recency,
      round({clip('(1995 - release_year) / 50.0')}, 9) as classic from items""",
)
def f30(spark, sf):
    y = F.col("release_year")
    return items(spark, sf).select(
        "item_id",
        F.round(S.recency(y), 9).alias("recency"),
        F.round(S.classic(y), 9).alias("classic"),
    )




def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_COMPLEX = (
    f"case when complexity = 'mind_bending' then least(1.0, {n('k', _list(K.COMPLEX_KEYWORDS))}"
    " / 3.0) else 0.0 end"
)
_PACING = (
    f"case when pacing = 'slow_burn' then cast({n('k', _list(K.SLOW_KEYWORDS))} > 0 as int)"
    f" when pacing = 'fast_paced' then cast({n('k', _list(K.FAST_KEYWORDS))} > 0 as int)"
    " else 0 end"
)


@query(
    "f31_pacing_complexity",
    cte("items", "asks")
    + f"""select query_id, item_id, round(cast({_COMPLEX} as double), 9) as complexity,
      cast({_PACING} as double) as pacing from (select q.query_id, i.item_id, q.complexity,
      q.pacing, [case when i.item_id % 3 = 0 then 'twist' else 'x' end,
        case when i.item_id % 4 = 0 then 'puzzle' else 'y' end,
        case when i.item_id % 5 = 0 then 'atmospheric' when i.item_id % 5 = 1 then 'adrenaline'
        else 'z' end] as k from asks q join items i on {filter_sql()})""",
)
def f31(spark, sf):
    i = F.col("item_id")
    words = F.array(
        F.when(i % 3 == 0, "twist").otherwise("x"),
        F.when(i % 4 == 0, "puzzle").otherwise("y"),
        F.when(i % 5 == 0, "atmospheric").when(i % 5 == 1, "adrenaline").otherwise("z"),
    )
    rows = pairs(spark, sf).withColumn("_k", lowered_set(words))
    return rows.select(
        "query_id", "item_id",
        F.round(K.complexity_score(), 9).alias("complexity"), K.pacing_score().alias("pacing"),
    )


# --- weighted ranking ------------------------------------------------------
_THEMATIC = "(len(themes) + len(moods) > 0 or coalesce(complexity, '') = 'mind_bending')"
_NICHE = "coalesce(popularity_preference, '') in ('hidden_gem', 'niche')"
_POPULAR = "coalesce(popularity_preference, '') = 'popular'"
_WEIGHTS = {
    "semantic": f"case when {_THEMATIC} then 0.25 else 0.20 end",
    "quality": f"""case when awards is not null then 0.25 when novelty = 'classic' then 0.25
      when acclaim = 'high' then 0.40 when {_NICHE} then 0.40 when {_POPULAR} then 0.15
      else 0.20 end""",
    "votes": f"""case when acclaim = 'high' then 0.20 when {_NICHE} then -0.10
      when {_POPULAR} then 0.20 else 0.10 end""",
    "popularity": f"""case when novelty = 'recent' then 0.15 when {_NICHE} then -0.30
      when {_POPULAR} then 0.35 else 0.10 end""",
    "genre": "0.15",
    "keyword": f"case when {_THEMATIC} then 0.25 else 0.10 end",
    "actor": "case when len(actors) > 0 then 0.30 else 0.05 end",
    "director": "case when len({d}) > 0 then 0.30 else 0.05 end",
    "classic": "case when novelty = 'classic' then 0.30 else 0.0 end",
    "recency": "case when novelty = 'recent' then 0.35 else 0.0 end",
    "award": "case when awards is not null then 0.30 else 0.0 end",
    "collection": "0.05",
}


def _weights(directors: str) -> str:
    cols = ", ".join(
        f"cast({x.replace('{d}', directors)} as double) as w_{name}"
        for name, x in _WEIGHTS.items()
    )
    total = " + ".join(f"greatest(0.0, w_{name})" for name in _WEIGHTS)
    return f"(select *, {total} as w_sum from (select *, {cols} from {{src}}))"


@query(
    "r4_weights_per_query",
    cte("asks")
    + "select query_id, "
    + ", ".join(f"round(greatest(0.0, w_{x}) / w_sum, 9) as {x}" for x in _WEIGHTS)
    + ", round(greatest(0.0, -w_popularity), 9) as popularity_penalty, "
    "round(greatest(0.0, -w_votes), 9) as votes_penalty from "
    + _weights("directors").replace("{src}", "asks"),
)
def r4_weights(spark, sf):
    rows = K.with_weights(asks(spark, sf))
    names = [*_WEIGHTS, "popularity_penalty", "votes_penalty"]
    return rows.select("query_id", *[F.round(F.col("weights")[x], 9).alias(x) for x in names])


_BOOSTED = (
    f"(semantic + 0.03 * cast({n('g', 'pg')} > 0 as int) + 0.05 * cast({n('c', 'pa')} > 0 as int)"
    f" + 0.05 * cast({n('d', 'pd')} > 0 as int))"
)
_SIGNAL = {
    "semantic": _BOOSTED,
    "quality": f"case when {_NICHE} then {bayes(150.0, 6.5)} else {bayes(1000.0, 6.5)} end",
    "votes": "least(1.0, ln(1 + v) / 12)",
    "popularity": "least(1.0, ln(1 + pop) / 6)",
    "genre": share("g", "pg", 1.0),
    "keyword": share("k", "pk", 1.0),
    "actor": share("c", "pa", 0.0),
    "director": share("d", "pd", 0.0),
    "classic": clip("(1995 - release_year) / 50.0"),
    "recency": clip("(release_year - 1980) / 46.0"),
    "award": _AWARD,
    "collection": """case when len(list_filter(refs, lambda t: contains(
      lower(coalesce(collection_name, '')), lower(t)))) > 0 then 1.0 else 0.0 end""",
}
_REFERRED = "len(list_filter(refs, lambda t: contains(lower(title), lower(t)))) > 0"
_STUDIO = (
    "len(list_filter(production_companies, lambda x: contains(lower(x), lower(studio)))) > 0"
)


def near(value: str, target: str, width: int) -> str:
    return (
        f"case when abs({value} - {target}) <= {width} then 0.05 * (1.0 - abs({value} - {target})"
        f" / {width}.0) else 0.0 end"
    )


_BOOST = " + ".join(
    [
        f"0.15 * coalesce(cast({_STUDIO} as int), 0)",
        f"0.08 * {_PACING}",
        f"0.10 * {_COMPLEX}",
        f"least(0.10, 0.04 * {n('g', 'pg')})",
        f"least(0.10, 0.025 * {n('k', 'pk')})",
        f"0.08 * {share('c', 'pa', 0.0)}",
        f"0.08 * {share('d', 'pd', 0.0)}",
        near("runtime_minutes", "q_runtime", 15),
        near("release_year", "exact_year", 5),
        f"0.15 * cast({_REFERRED} as int)",
    ]
)
_PENALTY = f"""(case when len(pg) > 0 and {n('pg', 'g')} = 0 then 0.5 else 0 end
    + case when r > 0 and r < 4 then 0.3 else 0 end
    + case when v > 0 and v < 10 then 0.2 else 0 end)"""
_MATCH = f"""round(least(0.99, greatest(0.65, 0.65 + 0.34 * (case when exact_year is not null
    then raw * 0.9 + 0.1 * case when release_year is null then 1.0
    else greatest(0.0, 1.0 - abs(release_year - exact_year) / 10.0) end else raw end))), 4)"""
_RAW = f"""(0.35 * least(1.0, greatest(0.0, (semantic - 0.15) / 0.50))
    + 0.20 * {share('g', 'pg', 1.0)} + 0.15 * {share('k', 'pk', 1.0)}
    + 0.10 * cast(len(pd) = 0 or {n('d', 'pd')} > 0 as int)
    + 0.10 * cast(len(pa) = 0 or {n('c', 'pa')} > 0 as int)
    + 0.05 * cast(studio is null or coalesce({_STUDIO}, false) as int) + 0.05)"""


def matched(values: str, wanted: str) -> str:
    return (
        f"nullif(array_to_string(list_sort(list_distinct(list_filter(coalesce({values}, []), "
        f"lambda x: list_contains({wanted}, lower(x))))), ', '), '')"
    )


_SHARED = f"""concat_ws(' and ',
    'matches preferred genre(s) (' || {matched('genres', 'pg')} || ')',
    'features actor(s) you like (' || {matched('people', 'pa')} || ')',
    'features director(s) you like (' || {matched('directors', 'pd')} || ')')"""
_PHRASE = "coalesce(array_to_string(genres[1:2], ', '), 'compelling')"
_EXPLAIN = f"""case when ranking_mode = 'best' then 'Highly rated ' || {_PHRASE} ||
      ' movie with exceptional audience rating of ' || cast(r as varchar) || '/10.'
    when ranking_mode = 'similar' then coalesce('Recommended because it closely matches your '
      || 'request for a film similar to ' || list_filter(refs, lambda t: contains(lower(title),
      lower(t)))[1] || '.', 'Matches the thematic style, genres (' || {_PHRASE}
      || '), and tone of your query.')
    when ranking_mode = 'classic' then 'A critically acclaimed classic ' || {_PHRASE} ||
      ' film released in ' || coalesce(cast(release_year as varchar), 'None') || ' with ' ||
      format('{{:,}}', v) || ' votes.'
    else case when {_SHARED} <> '' then 'This movie ' || {_SHARED} || '.' else
      'Matches your interest in ' || {_PHRASE} || ' themes with strong audience appeal.' end end"""
_BASE = " + ".join(f"greatest(0.0, w_{x}) / w_sum * ({s})" for x, s in _SIGNAL.items())
_SCORED = f""", s as (select *, {_BASE} as base, {_BOOST} as boost, {_PENALTY} as penalty,
        {_RAW} as raw, {_SIGNAL['popularity']} as s_pop, {_SIGNAL['votes']} as s_votes,
        {_BOOSTED} as boosted from {_weights('pd').replace('{src}', 'p')})
      , scored as (select *, round(greatest(0.0, base + least(0.25, boost)
        - greatest(0.0, -w_popularity) * s_pop - greatest(0.0, -w_votes) * s_votes - penalty), 10)
        as score from s)
    """
_RANKED = cte("items", "asks") + _PAIRS + _SCORED


@query(
    "r4_weighted_ranking_f34_r7",
    _RANKED + f"""select query_id, item_id, round(score, 10) as score, round(boosted, 7) as boosted,
      {_MATCH} as match_pct, {_EXPLAIN} as explanation from scored""",
)
def r4(spark, sf):
    done = K.rank_candidates(pairs(spark, sf))
    return done.select(
        "query_id", "item_id", F.round("score", 10).alias("score"),
        F.round("boosted", 7).alias("boosted"), "match_pct", "explanation",
    )


@query(
    "r4_score_ranks",
    _RANKED + """select query_id, item_id, score_rank from (select query_id, item_id,
      row_number() over (partition by query_id order by round(score, 8) desc, item_id)
      as score_rank from scored) where score_rank <= 15""",
)
def r4_ranks(spark, sf):
    from curatrix.operators.grouping import top_k

    done = K.rank_candidates(pairs(spark, sf)).drop("score_rank")
    top = top_k(
        done, ["query_id"], [F.round("score", 8).desc(), F.asc("item_id")], 15, "score_rank"
    )
    return top.select("query_id", "item_id", "score_rank")


# --- mode profiles ---------------------------------------------------------
_YEAR = "coalesce(release_year, 1990)"


def _named(wanted: str, known) -> str:
    terms = (
        f"list_distinct(case when len({wanted}) > 0 then list_transform({wanted}, "
        f"lambda x: lower(x)) else list_filter(list_transform(q_keywords, lambda x: lower(x)), "
        f"lambda x: list_contains({_list(known)}, x)) end)"
    )
    hits = (
        f"list_filter({terms}, lambda t: list_contains(k, t) or list_contains(g, t) "
        "or contains(lower(coalesce(overview, '')), t))"
    )
    return f"case when len({terms}) > 0 then len({hits}) / len({terms}) else 0.0 end"


from curatrix.functions.understanding import MOODS, THEMES  # noqa: E402

_PARTS = {
    "genre": share("g", "pg", 0.0),
    "keyword": share("k", "pk", 0.0),
    "actor": share("c", "pa", 0.0),
    "director": share("d", "pd", 0.0),
    "popularity": "least(1.0, ln(1 + pop) / 5)",
    "obscurity": "greatest(0.0, 1.0 - least(1.0, pop / 100.0))",
    "rating": "r / 10.0",
    "quality": _QUALITY,
    "votes": "least(1.0, ln(1 + v) / 12)",
    "semantic": _BOOSTED,
    "mood": _named("moods", MOODS),
    "theme": _named("themes", THEMES),
    "award": _GRADE,
    "classic": f"least(1.0, greatest(0.0, (1990 - {_YEAR}) / 50.0))",
    "recent": f"least(1.0, greatest(0.0, ({_YEAR} - 2000) / 26.0))",
}
_PROFILE = (
    "case ranking_mode "
    + " ".join(
        f"when '{m}' then " + " + ".join(f"{w} * p_{x}" for x, w in weights.items())
        for m, weights in K.MODE_PROFILES.items()
    )
    + " end"
)
_DIR = matched("directors", "pd")
_ACT = matched("people", "pa")
_TONED = """array_to_string(list_filter(moods || themes, lambda m: list_contains(k, lower(m))
    or list_contains(g, lower(m))), ', ')"""
_NOTED = (
    "regexp_matches(lower(concat_ws(' ', '', tagline, overview)), " + _TERMS + ")"
)
_BEST = f"""concat_ws(', ', 'genre (' || {matched('genres', 'pg')} || ')',
    case when {_NOTED} then 'award recognition' end,
    case when r >= 8 then 'outstanding ratings (' || cast(r as varchar) || '/10)' end)"""
_REASON = f"""case ranking_mode
    when 'best' then case when {_BEST} <> '' then 'Highly recommended due to its ' || {_BEST}
      || '.' else 'One of the highest-rated films ever made with outstanding critical acclaim.'
      end
    when 'similar' then case when {_REFERRED} then 'Recommended because it closely matches your '
        || 'request for a film similar to ' || array_to_string(list_filter(refs,
        lambda t: contains(lower(title), lower(t))), ', ') || '.'
      when {_DIR} is not null then 'Recommended because of the director ('
        || replace({_DIR}, ', ', ', and ') || ').'
      when {_ACT} is not null then 'Recommended because of the shared cast ('
        || replace({_ACT}, ', ', ', and ') || ').'
      else 'Recommended due to strong thematic similarity to your query.' end
    when 'mood' then case when {_TONED} <> '' then 'Matches the mood and theme: ' || {_TONED}
      || '.' else 'Matches the requested mood and tone.' end
    else case when {_SHARED} <> '' then 'This movie ' || {_SHARED} || '.' else
      'Selected for its combination of ' || coalesce(nullif(lower(array_to_string(genres[1:3],
      ' ')), ''), 'compelling') ||
      ' themes, exceptional audience ratings, and storytelling.' end end"""


@query(
    "r5_mode_profiles_f35",
    cte("items", "asks") + _PAIRS.replace(
        "q.genres as q_genres,", "q.genres as q_genres, q.keywords as q_keywords,"
    )
    + ", m as (select *, "
    + ", ".join(f"{x} as p_{name}" for name, x in _PARTS.items())
    + f""" from p)
      select query_id, item_id, round(greatest(0.0, {_PROFILE}
        + case when awards is not null and ranking_mode <> 'best' then 0.10 * p_award else 0 end
        + case when novelty = 'classic' and ranking_mode <> 'classic' then 0.15 * p_classic
          when novelty = 'recent' and ranking_mode <> 'recent' then 0.15 * p_recent else 0 end
        - case when len(pg) > 0 and {n('pg', 'g')} = 0 then 0.5 else 0 end), 10) as score,
        {_REASON} as reason from m""",
)
def r5(spark, sf):
    done = K.profile_scores(pairs(spark, sf))
    return done.select("query_id", "item_id", F.round("score", 10).alias("score"), "reason")


@query(
    "r7_match_percentage",
    cte("items", "asks") + _PAIRS
    + f"select query_id, item_id, {_MATCH} as match_pct from (select *, {_RAW} as raw from p)",
)
def r7(spark, sf):
    rows = K.with_sets(pairs(spark, sf))
    return rows.select("query_id", "item_id", K.match_percentage(rows).alias("match_pct"))


# --- the funnel, from retrieval to diversity --------------------------------
_DIVERSE = r"""
  , facts as (select query_id, score_rank as a, cast(score as double) as score,
      lower(coalesce(collection_name, '')) as coll,
      list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '\s+'),
        lambda x: x <> '')) as words,
      list_distinct(coalesce(people, [])) as people,
      list_distinct(coalesce(directors, [])) as directors, release_year as year from ranked)
  , shared as (select x.query_id, x.a, y.a as b, x.coll <> '' and x.coll = y.coll as same_coll,
      len(list_filter(list_intersect(x.words, y.words), lambda w: w not in ('the', 'a', 'of', 'and',
        'in', 'to', 'for', 'with', 'part', 'movie', 'film'))) as n_words,
      len(list_filter(x.words, lambda w: regexp_matches(w, '^[0-9]+$'))) as n_digits,
      len(list_intersect(x.people, y.people)) as n_people,
      len(list_intersect(x.directors, y.directors)) as n_directors,
      x.year <> 0 and y.year <> 0 and abs(x.year - y.year) <= 3 as near
    from facts x join facts y on x.query_id = y.query_id and x.a <> y.a)
  , pen as (select query_id, a, b, (case when same_coll then 0.35 else 0.0 end)
      + (case when n_words >= 2 or (n_words >= 1 and n_digits > 0) then 0.25 else 0.0 end)
      + (case when n_people >= 2 then 0.20 else 0.0 end)
      + (case when n_directors >= 1 then 0.15 else 0.0 end)
      + (case when near then 0.05 else 0.0 end) as lost from shared)
  , walk as (select distinct query_id, 1 as step, [cast(1 as bigint)] as chosen from facts
    union all
    select query_id, step + 1, list_append(chosen, arg_max(a, v - a * 1e-13)) from (
      select w.query_id, w.step, w.chosen, c.a,
        round(c.score - cast(coalesce(sum(p.lost), 0) as double), 10) as v
      from walk w join facts c on c.query_id = w.query_id and not list_contains(w.chosen, c.a)
      left join pen p on p.query_id = c.query_id and p.a = c.a and list_contains(w.chosen, p.b)
      where w.step < 10 group by w.query_id, w.step, w.chosen, c.a, c.score)
    group by query_id, step, chosen)
  , best as (select query_id, arg_max(chosen, step) as chosen from walk group by query_id)
  , placed as (select r.query_id, r.score_rank, case when list_contains(b.chosen, r.score_rank)
        then list_position(b.chosen, r.score_rank) else 10 + row_number() over (
          partition by r.query_id, list_contains(b.chosen, r.score_rank) order by r.score_rank) end
      as position from ranked r join best b on b.query_id = r.query_id)
"""


def funnel_sql(select: str) -> str:
    """Fused retrieval, the list of 15, weighted ranks and the greedy pass."""
    short = """, shortlist as (select q.query_id, q.text, i.*, s.semantic from stage_2 s
      join items i on i.item_id = s.item_id join asks q on q.query_id = s.query_id
      where s.slot <= 15)"""
    ranks = f""", ranked as (select *, row_number() over (partition by query_id
      order by score desc, item_id) as score_rank, {_MATCH} as match_pct,
      {_EXPLAIN} as explanation from scored)"""
    body = fused_sql() + short + _JOINED.replace("from pairs i", "from shortlist i") + _SCORED + ranks
    # The walk over chosen rows is recursive; the other CTEs are not touched by that.
    return body.replace("with ", "with recursive ", 1) + _DIVERSE + select


ORACLE["r6_diversity"] = funnel_sql(
    """select r.query_id, r.item_id, p.position, r.score_rank from ranked r
       join placed p on p.query_id = r.query_id and p.score_rank = r.score_rank"""
)
ORACLE["r3_funnel"] = funnel_sql(
    """select r.query_id, p.position, r.item_id, r.title, round(r.score, 6) as score,
         round(r.semantic, 6) as semantic, r.match_pct, r.explanation
       from ranked r join placed p on p.query_id = r.query_id and p.score_rank = r.score_rank
       where p.position <= 10"""
)
