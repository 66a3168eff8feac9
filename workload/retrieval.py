"""Filters, fusion, the funnel, similar items, discovery, assembly, judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import evaluation as V, filters as L, lookups as K
from curatrix.operators.fusion import fuse, metadata_match
from curatrix.operators.grouping import first_wins, narrow_two_lists, top_k
from curatrix.plans import assembly as A, recommend as R, search as H, similar as M
from curatrix.session import settle

from . import query
from .catalogue import SEARCH_TEXT as FIRST_TEN_TEXT
from .fixtures import ask_vectors, asks, cte, full_items, items, table, vectors
from .texts import _UNIT, bm25_ctes

# Retrieval searches the whole cast; the cut is an option of the text.
SEARCH_TEXT = FIRST_TEN_TEXT.replace("people[1:10]", "people")

# --- structured filter -----------------------------------------------------
_CODE = "case q.language when 'english' then 'en' when 'fr' then 'fr' end"
_LOW = "list_transform({0}, lambda x: lower(x))"
_SERIES = (
    r"(?i)\b(tv series|tv show|box set|season \d+|episode \d+|complete series|collection)\b"
)


def _has(values: str, wanted: str) -> str:
    return f"list_has_any({_LOW.format(values)}, {_LOW.format(wanted)})"


def filter_sql(genres: str = "q.genres", span: bool = True) -> str:
    """Filter between i (items) and q (asks), with genres or the span and
    runtime taken out for the relaxed levels."""
    year = """(q.year_from is null or i.release_year >= q.year_from)
      and (q.year_to is null or i.release_year <= q.year_to)
      and (q.runtime is null or i.runtime_minutes <= q.runtime)""" if span else "true"
    return f"""
      (len(q.avoid_genres) = 0 or not {_has('i.genres', 'q.avoid_genres')})
      and (len(q.avoid_titles) = 0 or (not list_contains(q.avoid_titles, lower(i.title))
        and not list_contains(q.avoid_titles, lower(i.original_title))))
      and (len(q.exclusions) = 0 or (not {_has('i.genres', 'q.exclusions')}
        and not {_has('i.people', 'q.exclusions')}
        and not list_contains(q.exclusions, lower(i.title))
        and not list_contains(q.exclusions, lower(i.original_title))))
      and ({_CODE} is null or list_contains(i.languages, {_CODE}))
      and {year}
      and (q.exact_year is null or i.release_year = q.exact_year)
      and (len({genres}) = 0 or {_has('i.genres', genres)})
      and (list_contains({genres}, 'Documentary') or not list_contains(i.genres, 'Documentary'))
      and not regexp_matches(coalesce(i.title, ''), '{_SERIES}')
      and not regexp_matches(coalesce(i.original_title, ''), '{_SERIES}')"""


NONE = "cast([] as varchar[])"


@query(
    "p13_structured_filter",
    cte("items", "asks")
    + f"select q.query_id, i.item_id from asks q join items i on {filter_sql()}",
)
def p13(spark, sf):
    return L.matching_pairs(items(spark, sf), asks(spark, sf))


RELAXED = f"""
  n0 as (select q.query_id, count(i.item_id) as n from asks q left join items i
    on {filter_sql()} group by q.query_id),
  n2 as (select q.query_id, count(i.item_id) as n from asks q left join items i
    on {filter_sql(NONE)} group by q.query_id),
  level as (select q.query_id, case when n0.n >= 5 or (len(actors) = 0 and len(directors) = 0
      and len(genres) = 0 and year_from is null and year_to is null and runtime is null) then 0
    when n2.n >= 5 then 2 else 3 end as relax_level
    from asks q join n0 on n0.query_id = q.query_id join n2 on n2.query_id = q.query_id)
"""


@query(
    "p15_relaxation_ladder",
    cte("items", "asks") + "," + RELAXED + "select query_id, relax_level from level",
)
def p15(spark, sf):
    return L.relax(items(spark, sf), asks(spark, sf)).select("query_id", "relax_level")


# --- hybrid retrieval ------------------------------------------------------
def _share(values: str, wanted: str) -> str:
    return (
        f"case when len({wanted}) > 0 and {values} is not null then len(list_filter({values}, "
        f"lambda x: list_contains({wanted}, lower(x)))) / len({wanted}) else 0.0 end"
    )


_KW = _LOW.format("q.keywords || q.themes || q.moods")
_SIGNALS = (
    f"(cast(len(q.genres) > 0 as int) + cast(len({_KW}) > 0 as int)"
    " + cast(len(q.actors) > 0 as int) + cast(len(q.directors) > 0 as int))"
)
_META = (
    f"case when {_SIGNALS} > 0 then ("
    + " + ".join(
        [
            _share("i.genres", _LOW.format("q.genres")),
            _share("i.keywords", _KW),
            _share("i.people", _LOW.format("q.actors")),
            _share("i.directors", _LOW.format("q.directors")),
        ]
    )
    + f") / {_SIGNALS} else 1.0 end"
)


def fused_sql(relaxed: bool = True) -> str:
    """CTEs up to fused(query_id, item_id, semantic, bm25, metadata, ...)."""
    ok = (
        f"""((v.relax_level = 0 and {filter_sql()}) or (v.relax_level = 2 and {filter_sql(NONE)})
          or (v.relax_level = 3 and {filter_sql(NONE, span=False)}))"""
        if relaxed
        else filter_sql()
    )
    level = RELAXED if relaxed else "level as (select query_id, 0 as relax_level from asks)"
    return (
        cte("items", "asks").rstrip() + ",\n"
        + f"""docs as (select item_id as id, {SEARCH_TEXT} as text from items),
      {level},
      asked as (select query_id, concat_ws(' ', text, array_to_string(genres, ' '),
        array_to_string(moods, ' '), array_to_string(themes, ' '), array_to_string(keywords, ' '),
        array_to_string(refs, ' '), array_to_string(actors, ' '),
        array_to_string(directors, ' ')) as text from asks),
      {bm25_ctes('docs', 'asked')}, {_UNIT},
      pairs as (select q.query_id, i.item_id,
          round(case when w.v is null then 0.0 else greatest(-1.0, least(1.0,
          list_dot_product(u.v, w.v))) end, 10) as semantic,
          round(coalesce(s.score, 0), 10) as bm25, round({_META}, 10) as metadata
        from asks q join level v on v.query_id = q.query_id join items i on {ok}
        join unit u on u.vec_id = i.item_id
        left join unit w on w.vec_id = q.query_id
        left join bm25 s on s.query_id = q.query_id and s.id = i.item_id),
      fused as (select *, round(0.55 * sn + 0.25 * bn + 0.20 * metadata, 10) as fusion from (
        select *, round(case when n = 1 then 1.0 when s1 > s0 then (semantic - s0) / (s1 - s0)
            else 0.0 end, 10) as sn,
          round(case when n = 1 then 1.0 when b1 > b0 then (bm25 - b0) / (b1 - b0)
            else 0.0 end, 10) as bn
        from (select *, count(*) over w as n, min(semantic) over w as s0, max(semantic) over w
          as s1, min(bm25) over w as b0, max(bm25) over w as b1 from pairs
          window w as (partition by query_id)))),
      stage_1 as (select * from (select *, row_number() over (partition by query_id
        order by fusion desc, item_id) as rank from fused) where rank <= 50),
      numbered as (select *, row_number() over (partition by query_id
        order by semantic desc, item_id) as s from stage_1),
      stage_2 as (select *, case when s <= 10 then s else 10 + row_number() over (partition by
        query_id, s <= 10 order by bn desc, item_id) end as slot from numbered)
    """
    )


def catalogue(spark, sf):
    """The item table as it is served: written once, then read."""
    return settle(items(spark, sf), "items")


def asked(spark, sf):
    return settle(asks(spark, sf), "asks")


def _inputs(spark, sf):
    v = vectors(spark, sf)
    return catalogue(spark, sf), asked(spark, sf), v, ask_vectors(spark, sf)


@query(
    "r1_hybrid_retrieval",
    fused_sql() + """select query_id, item_id, rank, round(fusion, 6) as fusion,
      round(semantic, 6) as semantic, round(bm25, 5) as bm25, round(metadata, 6) as metadata
      from stage_1""",
)
def r1(spark, sf):
    top = H.retrieve(*_inputs(spark, sf))
    return top.select(
        "query_id", "item_id", "rank",
        F.round("fusion", 6).alias("fusion"), F.round("semantic", 6).alias("semantic"),
        F.round("bm25", 5).alias("bm25"), F.round("metadata", 6).alias("metadata"),
    )


@query(
    "w6_two_list_narrowing",
    fused_sql() + "select query_id, item_id, slot from stage_2 where slot <= 15",
)
def w6(spark, sf):
    stage_1 = H.retrieve(*_inputs(spark, sf))
    return narrow_two_lists(stage_1).select("query_id", "item_id", "slot")


@query("r3_funnel")
def r3(spark, sf):
    done = H.funnel(*_inputs(spark, sf), limit=10)
    return done.select(
        "query_id", "position", "item_id", "title", F.round("score", 6).alias("score"),
        F.round("semantic", 6).alias("semantic"), "match_pct", "explanation",
    )


@query("r6_diversity")
def r6(spark, sf):
    done = H.funnel(*_inputs(spark, sf), limit=15)
    return done.select("query_id", "item_id", "position", "score_rank")


@query(
    "a26_signal_counts",
    fused_sql() + """select query_id, count(*) as candidates, count(*) filter (where bm25 > 0)
      as bm25_hits from pairs group by query_id""",
)
def a26(spark, sf):
    i, q, v, qv = _inputs(spark, sf)
    loose = L.relax(i, q).drop("relax_level")
    return H.signal_counts(H.score_pairs(i, q, v, qv, loose))


@query("r9_audit_trail")
def r9(spark, sf):
    return H.audit(*_inputs(spark, sf))


@query(
    "r9_audit_of_retrieval",
    fused_sql(relaxed=False)
    + """, lists as (select query_id, item_id, 'metadata' as stage, metadata as score,
        row_number() over (partition by query_id order by metadata desc, item_id) as position
        from fused union all
      select query_id, item_id, 'semantic', semantic, row_number() over (partition by query_id
        order by semantic desc, item_id) from fused union all
      select query_id, item_id, 'bm25', bn, row_number() over (partition by query_id
        order by bn desc, item_id) from fused union all
      select query_id, item_id, 'stage_1', fusion, rank + 50 from stage_1 union all
      select query_id, item_id, 'stage_2', semantic, slot + 85 from stage_2)
      select query_id, item_id, stage, case stage when 'stage_1' then position - 50
        when 'stage_2' then position - 85 else position end as position,
        round(score, 4) as score from lists where position <= 100""",
)
def r9_retrieval(spark, sf):
    rows = H.audit(*_inputs(spark, sf), relaxing=False)
    return rows.where(F.col("stage") != "stage_3").select(
        "query_id", "item_id", "stage", "position", "score"
    )


_PLAIN = (
    cte("items").rstrip() + ",\n"
    + f"""docs as (select item_id as id, {SEARCH_TEXT} as text from items),
      asked as (select item_id as query_id, text from benchmark),
      {bm25_ctes('docs', 'asked')}, {_UNIT},
      pairs as (select q.query_id, i.item_id,
        case when w.v is null then 0.0 else greatest(-1.0, least(1.0,
          list_dot_product(u.v, w.v))) end as semantic,
        coalesce(s.score, 0) as bm25 from asked q join items i
        on not list_contains(i.genres, 'Documentary') join unit u on u.vec_id = i.item_id
        left join unit w on w.vec_id = q.query_id
        left join bm25 s on s.query_id = q.query_id and s.id = i.item_id)
      select query_id, item_id, rank, fusion from (select *, row_number() over (
        partition by query_id order by fusion desc, item_id) as rank from (select query_id,
        item_id, round(0.55 * (semantic - min(semantic) over w)
          / (max(semantic) over w - min(semantic) over w)
        + 0.25 * coalesce((bm25 - min(bm25) over w)
          / nullif(max(bm25) over w - min(bm25) over w, 0), 0) + 0.20, 6) as fusion
        from pairs window w as (partition by query_id)))
      where rank <= 10"""
)


@query("r11_semantic_search", _PLAIN)
def r11(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = H.semantic_search(
        items(spark, sf), b, vectors(spark, sf), ask_vectors(spark, sf), limit=10
    )
    # Ranked again on the shown precision, as ties may fall below it.
    found = found.withColumn("fusion", F.round("fusion", 6)).drop("rank")
    again = top_k(found, ["query_id"], [F.desc("fusion"), F.asc("item_id")])
    return again.select("query_id", "item_id", "rank", "fusion")


@query(
    "w5_min_max_per_group_a25",
    """select l_partkey, l_orderkey, l_linenumber, l_suppkey, round(round(case when n = 1 then 1.0
       when hi > lo then (l_quantity - lo) / (hi - lo) else 0.0 end, 10), 8) as norm from (
       select *, count(*) over w as n, min(l_quantity) over w as lo, max(l_quantity) over w as hi
       from lineitem window w as (partition by l_partkey))""",
)
def w5(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("query_id"), "l_orderkey", "l_linenumber", "l_suppkey",
        F.col("l_quantity").alias("semantic"), F.lit(0.0).alias("bm25"),
        F.lit(0.0).alias("metadata"),
    )
    return fuse(rows).select(
        F.col("query_id").alias("l_partkey"), "l_orderkey", "l_linenumber", "l_suppkey",
        F.round("semantic_norm", 8).alias("norm"),
    )


@query(
    "f29_match_share",
    cte("items", "asks")
    + f"""select q.query_id, i.item_id, round({_META}, 8) as metadata from asks q
      join items i on {filter_sql()}""",
)
def f29(spark, sf):
    rows = L.survivors(items(spark, sf), asks(spark, sf))
    return rows.select(
        "query_id", "item_id", F.round(metadata_match(F.col("intent")), 8).alias("metadata")
    )


@query(
    "r2_pathway",
    cte("asks")
    + """select query_id, case when len(refs) > 0 and ranking_mode = 'similar' then 'similarity'
      else 'funnel' end as pathway from asks""",
)
def r2(spark, sf):
    from curatrix.functions.understanding import pathway

    return asks(spark, sf).select("query_id", pathway(F.col("intent")).alias("pathway"))


# --- references ------------------------------------------------------------
@query(
    "j17_reference_items",
    cte("items", "asks")
    + """, t as (select query_id, unnest(refs) as ref, generate_subscripts(refs, 1) as pos
        from asks),
      hits as (select t.query_id, t.pos, i.item_id, case when lower(i.title) = lower(ref) then 1
        else 2 end as how from t join items i on contains(lower(i.title), lower(ref))),
      best as (select * from (select *, row_number() over (partition by query_id, pos
        order by how, item_id) as rn from hits) where rn = 1)
      select query_id, item_id, cast(pos - 1 as bigint) as pos, how from (select *,
        row_number() over (partition by query_id order by pos) as rn2 from best
        where item_id in (select vec_id from embeddings)) where rn2 = 1""",
)
def j17(spark, sf):
    found = K.reference_items(items(spark, sf), asks(spark, sf), vectors(spark, sf))
    return found.select("query_id", "item_id", F.col("pos").cast("bigint").alias("pos"), "how")


# --- similar items ---------------------------------------------------------
_SIM = f"""
  , {_UNIT}, near as (select a.vec_id as query_id, b.vec_id as item_id,
      greatest(-1.0, least(1.0, list_dot_product(a.v, b.v))) as semantic
      from unit a join unit b on a.vec_id <> b.vec_id
      where a.vec_id in (select item_id from items) and b.vec_id in (select item_id from items)),
  cut as (select * from (select *, row_number() over (partition by query_id
      order by semantic desc, item_id) as rn from near) where rn <= 1000),
  shared as (select n.query_id, n.item_id, n.semantic, s.title as source_title, i.rating_value,
      i.popularity, i.vote_count,
      list_filter(coalesce(i.genres, []), lambda x: list_contains(coalesce(s.genres, []), x)) as g,
      list_filter(coalesce(i.people, []), lambda x: list_contains(coalesce(s.people, []), x)) as c,
      list_filter(i.directors, lambda x: list_contains(s.directors, x)) as d
    from cut n join items i on i.item_id = n.item_id join items s on s.item_id = n.query_id),
  scored as (select *, least(1.0, semantic + 0.03 * len(g) + 0.05 * len(c) + 0.05 * len(d))
      as boosted from shared),
  blended as (select *, round(0.6 * boosted + 0.2 * coalesce(rating_value, 5) / 10
      + 0.1 * least(1.0, ln(1 + coalesce(popularity, 0)) / 5)
      + 0.1 * least(1.0, ln(1 + coalesce(vote_count, 0)) / 15), 10) as score from scored)
  select query_id, item_id, rank, round(score, 6) as score, round(boosted, 6) as boosted,
    case when len(g) + len(c) + len(d) > 0 then 'Recommended because it shares ' ||
      concat_ws(', and ', case when len(g) > 0 then 'genres (' || array_to_string(g, ', ') || ')'
        end, case when len(c) > 0 then 'cast (' || array_to_string(c, ', ') || ')' end,
        case when len(d) > 0 then 'directors (' || array_to_string(d, ', ') || ')' end)
      || ' with ' || source_title || '.'
    else 'Recommended due to strong thematic similarities to ' || source_title || '.' end as reason
  from (select *, row_number() over (partition by query_id order by score desc, item_id) as rank
    from blended) where rank <= 10
"""


@query("r8_similar_items_l5_f36", cte("items") + _SIM)
def r8(spark, sf):
    i, v = items(spark, sf), vectors(spark, sf)
    found = M.similar_items(i, v, v.withColumnRenamed("item_id", "query_id"))
    return found.select(
        "query_id", "item_id", "rank", F.round("score", 6).alias("score"),
        F.round("boosted", 6).alias("boosted"), "reason",
    )


# --- strict constraints and discovery --------------------------------------
_TITLE = "lower(coalesce(nullif(i.title, ''), nullif(i.original_title, ''), 'Unknown'))"
_G = "coalesce(i.genres, [])"
_STRICT = f"""
    case when i.release_year is null then 'release' end,
    case when length(trim(coalesce(i.overview, ''))) < 10 then 'overview' end,
    case when len({_G}) = 0 then 'genres' end,
    case when i.vote_count < 5 then 'votes' end,
    case when {_has(_G, 'q.avoid_genres')} then 'avoid_genre' end,
    case when len(list_filter(q.avoid_titles, lambda t: contains({_TITLE}, t))) > 0
      then 'avoid_title' end,
    case when len(q.genres) > 0 and len({_G}) > 0 and not {_has(_G, 'q.genres')}
      then 'explicit_genre' end,
    case when {_CODE} is not null and not list_contains(i.languages, {_CODE}) then 'language' end,
    case when i.release_year < q.year_from or i.release_year > q.year_to then 'years' end,
    case when abs(i.release_year - q.exact_year) > 3 then 'year' end,
    case when len(q.directors) > 0 and not {_has('i.directors', 'q.directors')}
      then 'director' end,
    case when len(q.actors) > 0 and len(i.people) > 0 and not {_has('i.people', 'q.actors')}
      then 'actor' end,
    case when i.runtime_minutes > q.runtime + 10 then 'runtime' end,
    case when q.family_safety = 'family_safe' and list_contains({_G}, 'Horror') then 'family' end,
    case when not list_contains(q.genres, 'Documentary') and list_contains({_G}, 'Documentary')
      then 'documentary' end
"""
_JUDGED = f"""
  , cand as (select q.query_id as qid, i.* from asks q join items i
      on i.runtime_minutes > 100 + q.query_id % 40),
  judged as (select q.query_id, i.item_id, list_filter([{_STRICT}], lambda r: r is not null)
      as reasons from cand i join asks q on q.query_id = i.qid)
"""


def _candidates(spark, sf):
    """Candidate pairs: items longer than a query's floor."""
    k = L.strict_facts(items(spark, sf).where(F.col("runtime_minutes") > 100))
    lengths = k.withColumn(
        "_floor", F.explode(F.sequence(F.lit(100), F.col("runtime_minutes") - 1))
    )
    floors = asks(spark, sf).withColumn("_floor", (F.col("query_id") % 40 + 100).cast("int"))
    floors = settle(L.strict_demands(floors), "demands")
    return lengths.join(floors, "_floor").drop("_floor")


@query(
    "p16_strict_constraints",
    cte("items", "asks") + _JUDGED
    + "select query_id, item_id, array_to_string(reasons, ',') as reasons from judged",
)
def p16(spark, sf):
    done = L.with_rejections(_candidates(spark, sf))
    return done.select(
        "query_id", "item_id", F.array_join("reject_reasons", ",").alias("reasons")
    )


@query(
    "p16_waived_when_none_pass",
    cte("items", "asks") + _JUDGED
    + """, state as (select query_id, max(cast(len(reasons) = 0 as int)) = 0 as waived
        from judged group by query_id)
      select j.query_id, j.item_id, s.waived from judged j join state s
        on s.query_id = j.query_id where s.waived or len(reasons) = 0""",
)
def p16_waived(spark, sf):
    done = L.strict_candidates(_candidates(spark, sf))
    return done.select("query_id", "item_id", "waived")


_DISCOVER = f"""
  , found as (select q.query_id, i.item_id, row_number() over (partition by q.query_id
      order by i.popularity desc nulls last, i.item_id) as position from asks q join items i on
    (len(q.genres) = 0 or {_has(_G, 'q.genres')})
    and not {_has(_G, 'q.avoid_genres')}
    and ({_CODE} is null or i.languages[1] = {_CODE})
    and case when q.exact_year is not null then i.release_year = q.exact_year
      else (q.year_from is null or i.release_year >= q.year_from)
        and (q.year_to is null or i.release_year <= q.year_to) end
    and (q.runtime is null or i.runtime_minutes <= q.runtime)
    and (len({_KW}) = 0 or list_has_any({_LOW.format('i.keywords')}, {_KW}))
    and (len(q.actors) = 0 or {_has('coalesce(i.people, [])', 'q.actors')})
    and (len(q.directors) = 0 or {_has('i.directors', 'q.directors')})
    and coalesce(i.vote_count, 0) >= case q.ranking_mode when 'best' then 100 when 'mood' then 0
      else 50 end
    and coalesce(i.rating_value, 0) >= case q.ranking_mode when 'best' then 6.5 else 0 end)
"""


@query(
    "p17_discover_pages",
    cte("items", "asks") + _DISCOVER
    + """select query_id, item_id, position, cast((position - 1) // 20 + 1 as int) as page
      from found where position <= 60""",
)
def p17(spark, sf):
    done = L.discover(items(spark, sf), asks(spark, sf))
    return done.select("query_id", "item_id", "position", "page")


@query(
    "w7_first_source_wins",
    """select user_id, kind, cast(min(source) as int) as source from (
       select user_id, event_type as kind, 2 as source from events
       union all select c_custkey, 'click', 1 from customer
       union all select o_custkey, 'purchase', 3 from orders) group by user_id, kind""",
)
def w7(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("kind"), F.lit(2).alias("source")
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("click").alias("kind"), F.lit(1).alias("source")
    )
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.lit("purchase").alias("kind"),
        F.lit(3).alias("source"),
    )
    rows = e.unionByName(c).unionByName(o)
    return first_wins(rows, ["user_id", "kind"], ["source"])


_FILMS = """(select q.query_id, i.item_id, row_number() over (partition by q.query_id
    order by i.popularity desc nulls last, i.item_id) as rank from asks q join items i
    on list_has_any(list_transform({0}, lambda x: lower(x)),
      list_transform(q.{1}, lambda x: lower(x))))"""


@query(
    "l4_cast_filmography_r14",
    cte("items", "asks")
    + f"select query_id, item_id, rank from {_FILMS.format('i.people', 'actors')} where rank <= 40",
)
def l4(spark, sf):
    names = asks(spark, sf).select(
        "query_id", F.explode("intent.preferred_actors").alias("name")
    )
    return K.filmography(items(spark, sf), names, "cast", A.CAST_FILMS).select(
        "query_id", "item_id", "rank"
    )


@query(
    "r14_director_filmography",
    cte("items", "asks")
    + f"select query_id, item_id, rank from {_FILMS.format('i.directors', 'directors')}",
)
def r14(spark, sf):
    names = asks(spark, sf).select(
        "query_id", F.explode("intent.preferred_directors").alias("name")
    )
    return K.filmography(items(spark, sf), names, "directors").select(
        "query_id", "item_id", "rank"
    )


@query(
    "r13_collection_members",
    cte("items")
    + """select s.item_id as query_id, count(*) as members, min(i.item_id) as first
      from items s join items i on i.collection_name = s.collection_name group by s.item_id""",
)
def r13(spark, sf):
    i = items(spark, sf)
    seeds = i.select(F.col("item_id").alias("query_id"), "item_id")
    found = A.collection_members(i, seeds)
    return found.groupBy("query_id").agg(
        F.count("*").alias("members"), F.min("item_id").alias("first")
    )


_REFERENCE = """
  , t as (select query_id, unnest(refs) as ref, generate_subscripts(refs, 1) as pos from asks),
  hits as (select t.query_id, t.pos, i.item_id, case when lower(i.title) = lower(ref) then 1
    else 2 end as how from t join items i on contains(lower(i.title), lower(ref))),
  best as (select * from (select *, row_number() over (partition by query_id, pos
    order by how, item_id) as rn from hits) where rn = 1),
  ref as (select query_id, item_id from (select *, row_number() over (partition by query_id
    order by pos) as rn2 from best where item_id in (select vec_id from embeddings))
    where rn2 = 1)
"""


@query(
    "q18_intent_from_reference",
    cte("items", "asks") + _REFERENCE
    + """select q.query_id,
      array_to_string(q.genres || list_filter(coalesce(i.genres, []),
        lambda g: not list_contains(q.genres, g)), '|') as genres,
      array_to_string(q.keywords || list_filter(coalesce(i.keywords[1:10], []),
        lambda g: not list_contains(q.keywords, g)), '|') as keywords,
      array_to_string(q.directors || list_filter(coalesce(i.directors, []),
        lambda g: not list_contains(q.directors, g)), '|') as directors,
      coalesce(i.collection_name, '') as collection
      from asks q left join ref r on r.query_id = q.query_id
      left join items i on i.item_id = r.item_id""",
)
def q18(spark, sf):
    done = A.enrich_from_reference(
        items(spark, sf), asks(spark, sf), vectors(spark, sf), keywords=10
    )
    i = F.col("intent")
    return done.select(
        "query_id",
        F.array_join(i["genres"], "|").alias("genres"),
        F.array_join(i["keywords"], "|").alias("keywords"),
        F.array_join(i["preferred_directors"], "|").alias("directors"),
        F.array_join(i["ref_collections"], "|").alias("collection"),
    )


def _pool_sql(strict_films: int = 40) -> str:
    """CTEs up to pool(query_id, item_id, source, rank)."""
    return f""", sources as (
      select query_id, item_id, 1 as source from found where position <= 60
      union all select query_id, item_id, 2 from (select q.query_id, i.item_id, row_number() over (
        partition by q.query_id order by i.popularity desc nulls last, i.item_id) as rank
        from asks q join items i on list_contains(i.production_companies, q.studio))
        where rank <= 20
      union all select query_id, item_id, 3 from {_FILMS.format('i.directors', 'directors')}
      union all select query_id, item_id, 4 from {_FILMS.format('i.people', 'actors')}
        where rank <= {strict_films}
      union all select query_id, item_id, 5 from ref
      union all select r.query_id, i.item_id, 6 from ref r join items s on s.item_id = r.item_id
        join items i on i.collection_name = s.collection_name),
      firsts as (select query_id, item_id, min(source) as source from sources
        group by query_id, item_id),
      pool as (select query_id, item_id, source, rank from (select f.*,
        row_number() over (partition by query_id order by
        coalesce(popularity, 0) * coalesce(rating_value, 0) desc, f.item_id) as rank
        from firsts f join items i on i.item_id = f.item_id) where rank <= 50)
    """


@query(
    "r12_candidate_assembly",
    cte("items", "asks") + _DISCOVER + _REFERENCE + _pool_sql()
    + "select query_id, item_id, cast(source as int) as source, rank from pool",
)
def r12(spark, sf):
    return A.candidate_pool(items(spark, sf), asks(spark, sf), vectors(spark, sf))


@query(
    "r12_recommend",
    cte("items", "asks") + _DISCOVER + _REFERENCE + _pool_sql() + "," + _UNIT
    + f""", judged as (select q.query_id, i.item_id, i.popularity, i.rating_value,
        list_filter([{_STRICT}], lambda r: r is not null) as reasons
        from pool p join asks q on q.query_id = p.query_id join items i on i.item_id = p.item_id),
      state as (select query_id, max(cast(len(reasons) = 0 as int)) = 0 as waived from judged
        group by query_id),
      kept as (select j.*, s.waived from judged j join state s on s.query_id = j.query_id
        where s.waived or len(j.reasons) = 0),
      cut as (select * from (select *, row_number() over (partition by query_id order by
        coalesce(popularity, 0) * coalesce(rating_value, 0) desc, item_id) as rank from kept)
        where rank <= 50),
      target as (select a.query_id, coalesce(r.item_id, a.query_id) as vec_id from asks a
        left join (select r.* from ref r join asks x on x.query_id = r.query_id
          where len(x.refs) > 0 and x.ranking_mode = 'similar') r on r.query_id = a.query_id),
      near as (select c.query_id, c.item_id, c.waived, round(case when u.v is null or w.v is null
          then 0.0 else greatest(-1.0, least(1.0, list_dot_product(u.v, w.v))) end, 10) as semantic
        from cut c join target t on t.query_id = c.query_id
        left join unit u on u.vec_id = c.item_id left join unit w on w.vec_id = t.vec_id)
      select query_id, item_id, waived, round(semantic, 6) as semantic, slot from (select *,
        row_number() over (partition by query_id order by semantic desc, item_id) as slot
        from near) where slot <= 15""",
)
def r12_recommend(spark, sf):
    """Through constraints, waiver, cut and narrowing; ranking has queries of
    its own."""
    i, q, v, encoded = _inputs(spark, sf)
    near = R.search_vectors(i, q, v, encoded)
    return R.shortlist(i, q, v, near).select(
        "query_id", "item_id", "waived", F.round("semantic", 6).alias("semantic"), "slot"
    )


@query("r2_answer_by_pathway")
def r2_answer(spark, sf):
    """The funnel with the vector each pathway asks for."""
    i, q, v, encoded = _inputs(spark, sf)
    return R.answer(i, q, v, encoded).select(
        "query_id", "position", "item_id", F.round("score", 6).alias("score")
    )


# --- judging ---------------------------------------------------------------
@query(
    "a27_confidence",
    _PLAIN.replace("select query_id, item_id, rank, fusion from (select *, row_number()",
                   ", ranked as (select * from (select *, row_number()")
    .replace("item_id, round(0.55", "item_id, semantic, round(0.55")
    .replace("where rank <= 10", "where rank <= 10)")
    + """ select b.item_id as query_id, round(coalesce(0.7 * max(case when rank = 1 then semantic
        end) + 0.15 * least(count(r.item_id) / 10.0, 1.0) + 0.15 * avg(case when rank <= 3 then
        (cast(i.title <> '' as int) + cast(coalesce(i.overview, '') <> '' as int)
          + cast(len(coalesce(i.genres, [])) > 0 as int)) / 3.0 end), 0), 4) as confidence
      from benchmark b left join ranked r on r.query_id = b.item_id
      left join items i on i.item_id = r.item_id group by b.item_id""",
)
def a27(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = H.semantic_search(
        items(spark, sf), b, vectors(spark, sf), ask_vectors(spark, sf), limit=10
    )
    found = found.withColumn("_f", F.round("fusion", 6)).drop("rank")
    again = top_k(found, ["query_id"], [F.desc("_f"), F.asc("item_id")], None, "position")
    return V.confidence(again, b, 10)


_JUDGE_LISTS = f"""
  , pool as (select q.query_id, i.*, row_number() over (partition by q.query_id
      order by i.popularity desc nulls last, i.item_id) as position from asks q join items i on
      len(q.keywords) > 0 and list_has_any(i.keywords, q.keywords)),
  top50 as (select * from pool where position <= 50),
  best10 as (select query_id, title, genres, row_number() over (partition by query_id
      order by rating_value desc nulls last, item_id) as position from top50)
"""


def _judge_inputs(spark, sf):
    q = asks(spark, sf)
    asked = settle(q.select("query_id", F.explode("intent.keywords").alias("word")).distinct(), "asked")
    i = catalogue(spark, sf)
    best_first = [F.col("popularity").desc_nulls_last(), F.asc("item_id")]
    slim = i.select("item_id", "popularity", F.col("keywords").alias("words"))
    hits = settle(K.first_by_word(slim, asked, best_first, 50), "hits")
    pool = settle(top_k(hits.join(i, "item_id"), ["query_id"], best_first, 50, "position"), "pool")
    best = top_k(
        pool.drop("position"), ["query_id"],
        [F.col("rating_value").desc_nulls_last(), F.asc("item_id")], 10, "position",
    )
    return q, pool, best


@query(
    "r10_expected_missing_irrelevant_j20",
    cte("items", "asks") + _JUDGE_LISTS
    + f""", shown as (select * from best10 where position <= 10),
      fit as (select p.query_id, p.position, p.title from top50 p join asks q
        on q.query_id = p.query_id where (len(q.genres) = 0 or {_has('coalesce(p.genres, [])', 'q.genres')})
        and (len(q.actors) = 0 or {_has('coalesce(p.people, [])', 'q.actors')})
        and (len(q.directors) = 0 or {_has('p.directors', 'q.directors')})),
      verdicts as (select f.query_id, case when exists (select 1 from shown s where
          s.query_id = f.query_id and s.title = f.title) then 'expected' else 'missing' end
          as verdict, f.position, f.title from fit f
        union all select s.query_id, 'irrelevant', s.position, s.title from shown s join asks q
          on q.query_id = s.query_id where {_has('coalesce(s.genres, [])', 'q.avoid_genres')}
          or list_contains(q.avoid_titles, lower(s.title))
          or (len(q.genres) > 0 and not {_has('coalesce(s.genres, [])', 'q.genres')}))
      select query_id, verdict, title, "order" from (select *, row_number() over (
        partition by query_id, verdict order by position, title) as "order" from verdicts)
      where "order" <= 10""",
)
def r10(spark, sf):
    return V.judge_results(*_judge_inputs(spark, sf)).select(
        "query_id", "verdict", "title", "order"
    )


# --- lookups ---------------------------------------------------------------
@query(
    "p18_autocomplete",
    cte("items")
    + """, typed as (select c_custkey as query_id, lower(substring(c_mktsegment, 1 +
        c_custkey % 3, 1 + c_custkey % 4)) as needle from customer)
      select query_id, item_id, title, rank from (select t.query_id, i.item_id, i.title,
        row_number() over (partition by t.query_id order by i.title, i.item_id) as rank
        from typed t join items i on contains(lower(i.title), t.needle) and t.needle <> '')
      where rank <= 10""",
)
def p18(spark, sf):
    c = F.col("c_custkey")
    typed = table(spark, sf, "customer").select(
        c.alias("query_id"),
        F.substr(F.col("c_mktsegment"), (c % 3 + 1).cast("int"), (c % 4 + 1).cast("int")).alias(
            "text"
        ),
    )
    return K.autocomplete(items(spark, sf), typed).select("query_id", "item_id", "title", "rank")


@query(
    "p19_id_cascade",
    cte("items")
    + """, wanted as (select o_orderkey as query_id, case o_orderkey % 3 when 0
        then cast(o_custkey as varchar) when 1 then 'tt' || lpad(cast(o_custkey as varchar), 7, '0')
        else 'Brand#' || (o_custkey % 25) || ' small ring' end as key from orders),
      hits as (select w.query_id, i.item_id, i.title, case when cast(i.tmdb_id as varchar) = w.key
        then 1 when i.imdb_id = w.key then 2 else 3 end as route from wanted w join items i
        on cast(i.tmdb_id as varchar) = w.key or i.imdb_id = w.key or i.original_title = w.key)
      select query_id, item_id, title, route from (select *, row_number() over (
        partition by query_id order by route, item_id) as rn from hits) where rn = 1""",
)
def p19(spark, sf):
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    key = (
        F.when(k == 0, c)
        .when(k == 1, F.concat(F.lit("tt"), F.lpad(c, 7, "0")))
        .otherwise(
            F.concat(
                F.lit("Brand#"), (F.col("o_custkey") % 25).cast("string"), F.lit(" small ring")
            )
        )
    )
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"),
                                               key.alias("key"))
    return K.by_any_id(items(spark, sf), wanted, custom="original_title")


@query(
    "j19_title_lookup",
    cte("items")
    + """, asked as (select s_suppkey as query_id, case s_suppkey % 2 when 0 then 'red widget'
        else 'SMALL RING' end as title from supplier
        union all select 1000000 + c_custkey, c_mktsegment from customer)
      select query_id, item_id, title, 'exact' as how from (select a.query_id, i.item_id, i.title,
        row_number() over (partition by a.query_id order by i.popularity desc nulls last,
        i.item_id) as rn from asked a join items i on lower(i.title) = lower(a.title))
      where rn = 1""",
)
def j19(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "red widget").otherwise("SMALL RING").alias("title"),
    )
    c = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1_000_000).alias("query_id"), F.col("c_mktsegment").alias("title")
    )
    return K.lookup_titles(items(spark, sf), s.unionByName(c))


@query(
    "j19_title_lookup_contained",
    cte("items")
    + """select p_partkey as query_id, case when max(cast(lower(i.title) = needle as int)) = 1
        then 'exact' else 'contains' end as how, true as holds
      from (select p_partkey, lower(split_part(p_name, ' ', 2)) as needle from part) p
      join items i on needle <> '' and contains(lower(i.title), needle) group by p_partkey""",
)
def j19_contained(spark, sf):
    """Titles asked for in part: how each is found, and that it holds the
    asked text; the choice among several goes by similarity."""
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.split("p_name", " ")[1].alias("title")
    )
    found = K.lookup_titles(full_items(spark, sf), asked)
    named = asked.withColumnRenamed("title", "asked")
    return found.join(named, "query_id").select(
        "query_id", "how", F.lower("title").contains(F.lower("asked")).alias("holds")
    )


@query(
    "j18_fuzzy_titles",
    cte("items") + """select p_partkey as query_id, true as near from part
      where p_name in (select title from items)""",
)
def j18(spark, sf):
    """Misspelt part names against all titles: whatever is named by a title
    finds one at least as similar as its own name, one letter shorter."""
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.concat(F.col("p_name"), F.substring("p_name", 1, 1)).alias("text"),
    )
    i = items(spark, sf)
    found = K.fuzzy_titles(i, asked)
    named = table(spark, sf, "part").join(
        i.select(F.col("title").alias("p_name")), "p_name", "left_semi"
    )
    own = 2.0 * F.length("p_name") / (2 * F.length("p_name") + 1)
    return named.select(F.col("p_partkey").alias("query_id"), own.alias("own")).join(
        found, "query_id"
    ).select("query_id", (F.col("ratio") >= F.col("own") - 1e-9).alias("near"))


