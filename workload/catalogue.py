"""Entity resolution, merging, documents, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curatrix.functions import documents as D, payload as P
from curatrix.functions.text import match_key
from curatrix.operators.grouping import first_by, merged_lists, sole_owner
from curatrix.operators.latest import last_write
from curatrix.plans import assembly as A, enrichment as E, merge as G
from curatrix.session import settle

from . import query
from .cleaning import (
    METADATA_ROWS,
    METADATA_TABLES,
    MOVIE_ROWS,
    MOVIE_TABLES,
    NAME_LISTS,
    PLOT_ROWS,
    TITLE_TABLES,
    TITLES_ROWS,
    clean_cte,
    joined,
    metadata_source,
    movies_source,
    plots_source,
    titles_source,
)
from .fixtures import asks, cte, full_items, items, table, vectors

_NORM = "nullif(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), '')"

SOURCES = (
    clean_cte(*TITLE_TABLES, *METADATA_TABLES, *MOVIE_TABLES, "plots")
    + NAME_LISTS + "," + TITLES_ROWS + "," + METADATA_ROWS + "," + MOVIE_ROWS + "," + PLOT_ROWS
    + f""",
  linked as (select distinct imdb_id from (select imdb_id from m_rows union all
    select imdb_id from l_rows) where imdb_id is not null),
  adm as (select * from t_rows where imdb_id in (select imdb_id from linked)
    or (rating_value is not null and vote_count >= 50)),
  links0 as (select imdb_id, min(tmdb_id) as tmdb_id, min(movielens_id) as movielens_id from (
    select imdb_id, tmdb_id, movielens_id from l_rows union all
    select imdb_id, tmdb_id, null from m_rows) where imdb_id is not null group by imdb_id),
  links as (select imdb_id,
    case when imdb_id = min(imdb_id) over (partition by tmdb_id) then tmdb_id end as tmdb_id,
    case when imdb_id = min(imdb_id) over (partition by movielens_id) then movielens_id end
      as movielens_id from links0),
  tkeys as (select {_NORM.format('title')} as k, release_year as y, min(imdb_id) as imdb_id
    from adm where {_NORM.format('title')} is not null and release_year is not null group by 1, 2),
  pkeys as (select {_NORM.format('title')} as k, release_year as y, wiki_page from w_rows),
  plinks as (select t.imdb_id, min(wiki_page) as wiki_page from pkeys p join tkeys t
    on t.k = p.k and t.y = p.y group by t.imdb_id),
  unmatched as (select distinct p.wiki_page from pkeys p anti join tkeys t
    on t.k = p.k and t.y = p.y),
  alone as (select a.imdb_id from adm a anti join links l on l.imdb_id = a.imdb_id),
  master as (
    select r.imdb_id, r.tmdb_id, r.movielens_id, p.wiki_page from (
      select * from links union all select imdb_id, null, null from alone) r
      left join plinks p on p.imdb_id = r.imdb_id
    union all select null, m.tmdb_id, null, null from (select distinct tmdb_id from m_rows
      where imdb_id is null and tmdb_id is not null) m anti join links l on l.tmdb_id = m.tmdb_id
    union all select null, null, null, wiki_page from unmatched)
"""
)


def sources(spark, sf) -> dict[str, DataFrame]:
    """The four conformed sources, written once."""
    return {
        "titles": settle(titles_source(spark, sf), "titles"),
        "metadata": settle(metadata_source(spark, sf), "metadata"),
        "movies": settle(movies_source(spark, sf), "movies"),
        "pages": settle(plots_source(spark, sf), "pages"),
    }


def admitted(s: dict[str, DataFrame]) -> DataFrame:
    return G.admitted_titles(s["titles"], G.linked_ids(s["metadata"], s["movies"]))


@query("p9_admission_filter", SOURCES + "select imdb_id, title from adm")
def p9(spark, sf):
    return admitted(sources(spark, sf)).select("imdb_id", "title")


@query("j6_title_year_resolution", SOURCES + "select imdb_id, wiki_page from plinks")
def j6(spark, sf):
    s = sources(spark, sf)
    return G.link_pages(s["pages"], admitted(s)).select("imdb_id", "wiki_page")


@query(
    "j7_semi_join",
    "select o_orderkey, o_custkey from orders where o_custkey in "
    "(select c_custkey from customer where c_mktsegment = 'MACHINERY')",
)
def j7(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    keys = c.select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        keys, "o_custkey", "left_semi"
    )


@query("j8_append_unmapped", SOURCES + "select wiki_page from unmatched")
def j8(spark, sf):
    s = sources(spark, sf)
    return G.unmatched_pages(s["pages"], admitted(s))


@query(
    "j9_master_map",
    SOURCES + "select imdb_id, tmdb_id, movielens_id, wiki_page from master",
)
def j9(spark, sf):
    s = sources(spark, sf)
    m = G.master_map(admitted(s), s["metadata"], s["movies"], s["pages"])
    return m.drop("item_key")


@query(
    "w1_sole_owner",
    """select o_orderkey, case when o_orderkey = min(o_orderkey) over (partition by o_custkey)
       then o_custkey end as o_custkey from orders""",
)
def w1(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sole_owner(rows, "o_orderkey", "o_custkey")


@query(
    "w2_surrogate_key",
    SOURCES + """select count(*) as items, count(distinct coalesce(imdb_id, '') || '/'
      || coalesce(cast(tmdb_id as varchar), '') || '/' || coalesce(wiki_page, '')) as keys
      from master""",
)
def w2(spark, sf):
    s = sources(spark, sf)
    m = G.master_map(admitted(s), s["metadata"], s["movies"], s["pages"])
    return m.groupBy("item_key").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("items"), F.count("*").alias("keys")
    )


def _first(c: str) -> str:
    return f"arg_min({c}, prio) filter (where {c} is not null) as {c}"


def _list(c: str) -> str:
    return (
        f"coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list({c}) "
        f"filter (where {c} is not null)), lambda x: x is not null))), '|'), '') as {c}"
    )


MERGED = (
    SOURCES
    + """, keyed as (
  select 1 as prio, 'tmdb' as source_dataset, m.imdb_id, m.tmdb_id, m.movielens_id, m.wiki_page,
    r.title, r.original_title, r.overview, null as plot_summary, r.genres, r.people, r.directors,
    null::varchar[] as writers, r.runtime_minutes, r.release_year,
    cast(r.rating_value as double) as rating_value, r.vote_count,
    cast(r.popularity as double) as popularity, r.production_companies, r.languages, r.keywords,
    r.tagline from master m join m_rows r on r.tmdb_id = m.tmdb_id
  union all
  select 2, 'imdb', m.imdb_id, m.tmdb_id, m.movielens_id, m.wiki_page, r.title, r.original_title,
    null, null, r.genres, r.people, r.directors, r.writers, r.runtime_minutes, r.release_year,
    cast(r.rating_value as double), r.vote_count, null, null, null, null, null
    from master m join adm r on r.imdb_id = m.imdb_id
  union all
  select 3, 'movielens', m.imdb_id, m.tmdb_id, m.movielens_id, m.wiki_page, r.title, null, null,
    null, r.genres, null, null, null, null, r.release_year, cast(r.rating_value as double),
    r.vote_count, null, null, null, null, null
    from master m join l_rows r on r.movielens_id = m.movielens_id
  union all
  select 4, 'wikipedia', m.imdb_id, m.tmdb_id, m.movielens_id, m.wiki_page, r.title, null, null,
    r.plot_summary, r.genres, r.people, r.directors, null, null, r.release_year, null, null, null,
    null, null, null, null from master m join w_rows r on r.wiki_page = m.wiki_page),
  merged as (select imdb_id, tmdb_id, movielens_id, wiki_page,
    """
    + ", ".join(
        _first(c)
        for c in ("title", "original_title", "overview", "plot_summary", "runtime_minutes",
                  "release_year", "source_dataset", "tagline", "popularity")
    )
    + ", "
    + ", ".join(
        _list(c)
        for c in ("genres", "people", "directors", "writers", "production_companies",
                  "languages", "keywords")
    )
    + """, case when coalesce(sum(vote_count), 0) > 0
      then coalesce(sum(rating_value * vote_count), 0) / sum(vote_count)
      else arg_min(rating_value, prio) filter (where rating_value is not null) end as rating_value,
    cast(coalesce(sum(vote_count), 0) as bigint) as vote_count
    from keyed group by imdb_id, tmdb_id, movielens_id, wiki_page)
"""
)


@query(
    "r0_merged_catalogue",
    MERGED
    + """select imdb_id, tmdb_id, movielens_id, wiki_page, title, original_title,
      md5(overview) as overview, md5(plot_summary) as plot_summary, runtime_minutes, release_year,
      source_dataset, tagline, vote_count, genres, people, directors, writers,
      production_companies, languages, keywords,
      floor(cast(cast(rating_value as float) as double) * 1000 + 0.51) / 1000 as rating_value
      from merged""",
)
def merged_catalogue(spark, sf):
    s = sources(spark, sf)
    m = G.merge_catalogue(s["titles"], s["metadata"], s["movies"], s["pages"])
    return m.select(
        "imdb_id", "tmdb_id", "movielens_id", "wiki_page", "title", "original_title",
        F.md5("overview").alias("overview"), F.md5("plot_summary").alias("plot_summary"),
        "runtime_minutes", "release_year", "source_dataset", "tagline", "vote_count",
        *joined("genres", "directors", "writers", "production_companies", "languages", "keywords"),
        F.array_join("cast", "|").alias("people"),
        # Means sit on the halves; the cut is moved off them, as sums differ by order.
        (F.floor(F.col("rating_value").cast("double") * 1000 + 0.51) / 1000).alias("rating_value"),
    )


@query(
    "j10_ids_on_merged_rows",
    SOURCES + """select 'imdb_id' as id, count(imdb_id) as n, count(distinct imdb_id) as uniq
      from master union all select 'tmdb_id', count(tmdb_id), count(distinct tmdb_id) from master
      union all select 'movielens_id', count(movielens_id), count(distinct movielens_id)
      from master union all select 'wiki_page', count(wiki_page), count(distinct wiki_page)
      from master""",
)
def j10(spark, sf):
    s = sources(spark, sf)
    m = G.merge_catalogue(s["titles"], s["metadata"], s["movies"], s["pages"])
    ids = m.select(*[F.col(c).cast("string") for c in G.ID_COLUMNS])
    long = ids.unpivot([], G.ID_COLUMNS, "id", "v").where(F.col("v").isNotNull())
    per = long.groupBy("id", "v").agg(F.count("*").alias("c"))
    return per.groupBy("id").agg(F.sum("c").alias("n"), F.count("*").alias("uniq"))


@query(
    "a21_overlap_statistics",
    MERGED
    + """select 'overlap_imdb_tmdb' as name, count(*) filter (where imdb_id is not null and
      tmdb_id is not null) as value from master
      union all select 'overlap_imdb_movielens', count(*) filter (where imdb_id is not null and
      movielens_id is not null) from master
      union all select 'overlap_imdb_wiki', count(*) filter (where imdb_id is not null and
      wiki_page is not null) from master
      union all select 'total_items', count(*) from merged
      union all select 'with_ratings', count(rating_value) from merged
      union all select 'with_plots', count(coalesce(plot_summary, overview)) from merged
      union all select 'imdb_source_rows', count(*) from adm
      union all select 'wikipedia_source_rows', count(*) from w_rows""",
)
def a21(spark, sf):
    s = sources(spark, sf)
    t = settle(admitted(s), "admitted")
    master = G.master_map(t, s["metadata"], s["movies"], s["pages"])
    merged = G.merge_catalogue(s["titles"], s["metadata"], s["movies"], s["pages"])
    return G.overlap_statistics(master, merged, {"imdb": t, "wikipedia": s["pages"]})


# --- aggregates of the merge on the given tables ---------------------------
@query(
    "a16_first_by_priority_l7",
    """select o_custkey, arg_min(o_orderpriority, (case o_orderstatus when 'F' then 1 when 'O'
       then 2 else 3 end, o_orderkey)) filter (where o_totalprice > 250000) as o_orderpriority
       from orders group by o_custkey""",
)
def a16(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority"))
    )
    rank = F.struct(
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
        .otherwise(3),
        "o_orderkey",
    )
    return o.groupBy("o_custkey").agg(first_by("o_orderpriority", rank))


@query(
    "a17_list_union",
    cte("items")
    + """select directors[1] as brand, array_to_string(list_sort(list_distinct(flatten(list(
      genres) filter (where genres is not null)))), '|') as genres,
      array_to_string(list_sort(list_distinct(flatten(list(people)
      filter (where people is not null)))), '|') as people from items group by directors[1]""",
)
def a17(spark, sf):
    rows = items(spark, sf).withColumn("brand", F.get("directors", 0))
    done = merged_lists(rows, "brand", ["genres", "cast"])
    return done.select("brand", *joined("genres"), F.array_join("cast", "|").alias("people"))


@query(
    "a18_weighted_mean_a19_sum",
    cte("items")
    + """select directors[1] as brand, round(case when sum(vote_count) > 0 then
      sum(rating_value * vote_count) / sum(vote_count) end, 8) as rating_value,
      cast(coalesce(sum(vote_count), 0) as bigint) as vote_count from items
      group by directors[1]""",
)
def a18(spark, sf):
    rows = items(spark, sf).withColumn("brand", F.get("directors", 0))
    done = rows.groupBy("brand").agg(
        F.round(G.weighted_rating(F.col("item_id")), 8).alias("rating_value"),
        F.coalesce(F.sum("vote_count"), F.lit(0)).alias("vote_count"),
    )
    return done


@query(
    "a20_first_link",
    SOURCES + "select imdb_id, tmdb_id, movielens_id from links",
)
def a20(spark, sf):
    s = sources(spark, sf)
    return G.id_links(s["metadata"], s["movies"])


@query(
    "f11_title_key_join",
    """select d.doc_id, p.p_partkey from documents d join part p on p.p_partkey = d.doc_id
       and regexp_replace(lower(p.p_name), '[^a-z0-9]', '', 'g') <> ''""",
)
def title_keys(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", F.col("p_partkey").alias("doc_id"), match_key(F.col("p_name")).alias("k")
    )
    docs = table(spark, sf, "documents").select("doc_id")
    return docs.join(parts.where(F.col("k").isNotNull()), "doc_id").select("doc_id", "p_partkey")


# --- documents -------------------------------------------------------------
_STRIP = (
    r"regexp_replace({0}, '^[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+|"
    r"[\s\x{{0b}}\x{{85}}\x{{a0}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"
)
_STORY = """case when length(coalesce(plot_summary, '')) > length(coalesce(overview, ''))
    then plot_summary else overview end"""


def _line(label: str, value: str) -> str:
    return f"coalesce(chr(10) || '{label}: ' || {value}, '')"


_DOC = " || ".join(
    [
        "'Title: ' || title || coalesce(' (' || release_year || ')', '')",
        _line("Genres", "array_to_string(genres, ', ')"),
        _line("Directed by", "array_to_string(directors, ', ')"),
        _line("Starring", "array_to_string(people[1:10], ', ')"),
        _line("Franchise / Collection", "collection_name"),
        _line("Production Companies", "array_to_string(production_companies, ', ')"),
        _line("Languages", "array_to_string(languages, ', ')"),
        _line("Rating", "cast(round(rating_value, 1) as varchar) || '/10'"),
        _line("Certification", "certification"),
        _line("Keywords / Themes", "array_to_string(keywords, ', ')"),
        _line("Tagline", "tagline"),
        _line("Description", f"nullif({_STRIP.format(_STORY)}, '')"),
    ]
)


@query(
    "f14_item_document",
    cte("items") + f"select item_id, md5({_DOC}) as digest, length({_DOC}) as size from items",
)
def f14(spark, sf):
    doc = D.item_document(first_cast=10)
    return full_items(spark, sf).select(
        "item_id", F.md5(doc).alias("digest"), F.length(doc).cast("bigint").alias("size")
    )


@query(
    "f15_embedding_document",
    cte("items")
    + """select item_id, md5(concat_ws('. ', 'Title: ' || title, 'Tagline: ' || tagline,
      'Overview: ' || overview, 'Genres: ' || array_to_string(genres, ', '),
      'Keywords: ' || array_to_string(keywords, ', '),
      'Cast: ' || array_to_string(people[1:10], ', '),
      'Directed by: ' || array_to_string(directors, ', '))) as digest from items""",
)
def f15(spark, sf):
    c = F.col
    doc = D.embedding_document(
        c("title"), c("tagline"), c("overview"), c("genres"), c("keywords"), c("cast"),
        c("directors"), first_cast=10,
    )
    return items(spark, sf).select("item_id", F.md5(doc).alias("digest"))


SEARCH_TEXT = """coalesce(title, '') || ' ' || coalesce(overview, '') || ' ' ||
    coalesce(tagline, '') || ' ' || coalesce(array_to_string(genres, ' '), '') || ' ' ||
    coalesce(array_to_string(keywords, ' '), '') || ' ' ||
    coalesce(array_to_string(directors, ' '), '') || ' ' ||
    coalesce(array_to_string(people[1:10], ' '), '') || ' ' || coalesce(plot_summary, '')"""


@query(
    "f16_search_text",
    cte("items") + f"select item_id, md5({SEARCH_TEXT}) as digest from items",
)
def f16(spark, sf):
    return items(spark, sf).select("item_id", F.md5(D.search_text(first_cast=10)).alias("digest"))


@query(
    "f17_query_document",
    cte("asks")
    + """select query_id, text || '. Genres: ' || array_to_string(genres, ', ') || '. Themes: ' ||
      array_to_string(themes, ', ') || '. Moods: ' || array_to_string(moods, ', ') ||
      '. Keywords: ' || array_to_string(keywords, ', ') || '.' as document,
      concat_ws(' ', text, array_to_string(genres, ' '), array_to_string(moods, ' '),
        array_to_string(themes, ' '), array_to_string(keywords, ' '),
        array_to_string(refs, ' '), array_to_string(actors, ' '),
        array_to_string(directors, ' ')) as words from asks""",
)
def f17(spark, sf):
    t, i = F.col("text"), F.col("intent")
    return asks(spark, sf).select(
        "query_id",
        D.query_document(t, i).alias("document"),
        D.query_search_text(t, i).alias("words"),
    )


@query(
    "f18_understanding_document",
    cte("asks")
    + """select query_id, concat_ws(' | ', 'Intent: recommendation',
      'Mood: ' || nullif(array_to_string(moods, ', '), ''),
      'Genres: ' || nullif(array_to_string(genres, ', '), ''),
      'Starring: ' || nullif(array_to_string(actors, ', '), ''),
      'Directed by: ' || nullif(array_to_string(directors, ', '), ''),
      'Like: ' || nullif(array_to_string(refs, ', '), '')) as document from asks""",
)
def f18(spark, sf):
    from curatrix.functions.understanding import understanding_record

    rows = asks(spark, sf).withColumn("u", understanding_record(F.col("intent")))
    return rows.select("query_id", D.understanding_document(F.col("u")).alias("document"))


# --- payloads --------------------------------------------------------------
_TEMPLATE = (
    '{"id": @N, "imdb_id": "tt@N", "title": "New @P", "original_title": "", '
    '"overview": "Plot of @P", "runtime": @R, "release_date": "19@Y-03-04", "vote_count": 0, '
    '"vote_average": 7.5, "popularity": 3.25, "poster_path": "@I", "backdrop_path": null, '
    '"status": "Released", "adult": false, "budget": 10, "revenue": 20, "original_language": "en", '
    '"belongs_to_collection": @C, "genres": [{"name": "War"}, {"name": ""}], '
    '"production_companies": [{"name": "Studio @B"}], "production_countries": [{"name": "Japan"}], '
    '"keywords": {"keywords": [], "results": [{"name": "kw @B"}]}, '
    '"credits": {"cast": [{"id": 1, "name": "Lead @B"}, {"id": 2, "name": null}], "crew": ['
    '{"id": 3, "name": "Dir @B", "job": "Director"}, {"id": 4, "name": "Wri", "job": "Screenplay"}, '
    '{"id": 5, "name": "Pro", "job": "Producer"}, {"id": 6, "name": "Com", "job": "Music"}, '
    '{"id": 7, "name": "Cin", "job": "Cinematography"}]}, "videos": {"results": @V}, '
    '"watch/providers": {"results": @W}, "release_dates": {"results": @D}, '
    '"images": {"logos": [{"file_path": "/l@N.png"}]}, "similar": {"results": [{"id": 9, '
    '"title": "S", "release_date": "2001-01-01", "vote_average": 5.5, "poster_path": "/s.jpg", '
    '"backdrop_path": "http://b"}]}, "recommendations": {"results": []}}'
)


def _video(kind: str, name: str, key: str) -> str:
    return f'{{"site": "YouTube", "type": "{kind}", "name": "{name}", "key": "{key}"}}'


def landed_payloads(spark, sf) -> DataFrame:
    """Payloads that have landed so far: those of parts of even size, so that
    enrichment meets items with and without one."""
    sizes = table(spark, sf, "part").where("p_size % 2 = 0")
    landed = sizes.select(F.col("p_partkey").cast("bigint").alias("tmdb_id"))
    return payloads(spark, sf).join(landed, "tmdb_id", "left_semi")


def payloads(spark, sf) -> DataFrame:
    """Detail payloads (tmdb_id, payload) of all parts."""
    c, k = F.col, F.col("p_partkey")
    teaser, plain = _video("Teaser", "T", "tea@N"), _video("Trailer", "One", "tra@N")
    official = _video("Trailer", "The OFFICIAL cut", "off@N")
    videos = (
        F.when(k % 4 == 0, f"[{teaser}, {plain}, {official}]")
        .when(k % 4 == 1, f"[{teaser}, {plain}]")
        .when(k % 4 == 2, f"[{teaser}]")
        .otherwise("[]")
    )
    one = '{"flatrate": [{"provider_name": "%s"}, {"provider_name": ""}]}'
    home, india, france = one % "Homeflix", one % "Indiaflix", one % "Franceflix"
    offers = (
        F.when(k % 3 == 0, f'{{"FR": {france}, "US": {home}}}')
        .when(k % 3 == 1, f'{{"FR": {france}, "IN": {india}}}')
        .otherwise(f'{{"GB": {{"flatrate": []}}, "FR": {france}}}')
    )
    date = '{"iso_3166_1": "%s", "release_dates": [{"certification": ""}, {"certification": "%s"}]}'
    dates = (
        F.when(k % 3 == 0, f"[{date % ('FR', '12')}, {date % ('US', 'R')}]")
        .when(k % 3 == 1, f"[{date % ('FR', '12')}]")
        .otherwise("[]")
    )
    coll = F.when(k % 2 == 0, '{"id": 1, "name": "Saga @B"}').otherwise("null")
    text = F.lit(_TEMPLATE)
    marks = [
        ("@V", videos), ("@W", offers), ("@D", dates), ("@C", coll),
        ("@I", F.when(k % 2 == 0, "/p@N.jpg").otherwise("http://img/@N.jpg")),
        ("@R", F.when(k % 6 == 0, "0").otherwise((k % 90 + 60).cast("string"))),
        ("@Y", (c("p_size") % 30 + 60).cast("string")),
        ("@N", k.cast("string")), ("@P", c("p_name")), ("@B", c("p_brand")),
    ]
    for mark, value in marks:
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf, "part").select(
        k.cast("bigint").alias("tmdb_id"), text.alias("payload")
    )


_POSTER = """case when p_partkey % 2 = 0
    then 'https://image.tmdb.org/t/p/w500/p' || p_partkey || '.jpg'
    else 'http://img/' || p_partkey || '.jpg' end"""
_PROVIDER = """case p_partkey % 3 when 0 then 'Homeflix' when 1 then 'Indiaflix'
    else 'Franceflix' end"""
_TRAILER = """case p_partkey % 4 when 0 then 'off' || p_partkey when 1 then 'tra' || p_partkey
    when 2 then 'tea' || p_partkey end"""


@query(
    "f37_image_address",
    f"select p_partkey as tmdb_id, {_POSTER} as poster_path from part",
)
def f37(spark, sf):
    p = P.parsed_payload(payloads(spark, sf), "payload")
    return p.select("tmdb_id", P.image_url(F.col("p.poster_path"), P.POSTER_BASE).alias(
        "poster_path"))


@query(
    "f38_parameter_hash",
    """select item_id, md5('{"page": 1, "query": ' || cast(to_json(text) as varchar) ||
       ', "year": ' || (1970 + item_id % 50) || '}') as hash from benchmark""",
)
def f38(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id",
        P.parameter_hash(
            {
                "query": P.json_text(F.col("text")),
                "year": F.lit(1970) + F.col("item_id") % 50,
                "page": F.lit(1),
            }
        ).alias("hash"),
    )


@query(
    "f40_payload_fields",
    """select p_partkey as tmdb_id, 'War' as genres, 'kw ' || p_brand as keywords,
      'Studio ' || p_brand as companies, 'Lead ' || p_brand as people, 'Dir ' || p_brand
      as directors, 'Wri' as writers, 'Pro' as producer, 'Com' as composer,
      'Cin' as cinematographer, case when p_partkey % 2 = 0 then 'Saga ' || p_brand end
      as collection, cast(1960 + p_size % 30 as int) as release_year
      from part""",
)
def f40(spark, sf):
    p = F.col("p")
    d = P.detail_fields(p, first_cast=10, first_stubs=5)
    return P.parsed_payload(payloads(spark, sf), "payload").select(
        "tmdb_id",
        F.array_join(P.names(p["genres"]), "|").alias("genres"),
        F.array_join(P.keyword_names(p), "|").alias("keywords"),
        F.array_join(d["production_companies"], "|").alias("companies"),
        F.array_join(d["cast"], "|").alias("people"),
        F.array_join(d["directors"], "|").alias("directors"),
        F.array_join(d["writers"], "|").alias("writers"),
        d["producer"].alias("producer"),
        d["composer"].alias("composer"),
        d["cinematographer"].alias("cinematographer"),
        d["collection"].alias("collection"),
        P.year_of(p["release_date"]).alias("release_year"),
    )


@query(
    "f41_trailer_choice",
    f"""select p_partkey as tmdb_id, {_TRAILER} as youtube_key,
      'https://www.youtube.com/watch?v=' || {_TRAILER} as trailer_url,
      case p_partkey % 4 when 0 then 'Trailer' when 1 then 'Trailer' when 2 then 'Teaser' end
        as trailer_type from part""",
)
def f41(spark, sf):
    rows = P.parsed_payload(payloads(spark, sf), "payload")
    v = P.best_video(F.col("p"))
    return rows.select(
        "tmdb_id",
        v["key"].alias("youtube_key"),
        P.video_url(v).alias("trailer_url"),
        v["type"].alias("trailer_type"),
    )


@query(
    "f42_provider_choice",
    f"select p_partkey as tmdb_id, {_PROVIDER} as providers from part",
)
def f42(spark, sf):
    rows = P.parsed_payload(payloads(spark, sf), "payload")
    return rows.select("tmdb_id", F.array_join(P.providers(F.col("p")), "|").alias("providers"))


@query(
    "f43_certification",
    """select p_partkey as tmdb_id, case p_partkey % 3 when 0 then 'R' end as home,
      case p_partkey % 3 when 0 then 'R' when 1 then '12' end as anywhere
      from part""",
)
def f43(spark, sf):
    p = F.col("p")
    return P.parsed_payload(payloads(spark, sf), "payload").select(
        "tmdb_id",
        P.certification(p, anywhere=False).alias("home"),
        P.certification(p).alias("anywhere"),
    )


@query(
    "f44_stub_mapping",
    """select p_partkey as tmdb_id, 'S/2001/5.5/https://image.tmdb.org/t/p/w500/s.jpg/http://b'
      as stub, 'https://image.tmdb.org/t/p/w500/l' || p_partkey || '.png' as logo_url
      from part""",
)
def f44(spark, sf):
    d = P.detail_fields(F.col("p"), first_cast=10, first_stubs=5)
    s = F.get(d["similar_movies"], 0)
    stub = F.concat_ws(
        "/", s["title"], s["release_year"].cast("string"), s["rating"].cast("string"),
        s["poster_path"], s["backdrop_path"],
    )
    return P.parsed_payload(payloads(spark, sf), "payload").select(
        "tmdb_id", stub.alias("stub"), d["logo_url"].alias("logo_url")
    )


# Items whose number id is missing for some, to be found through a mapping.
def _unlinked(spark, sf) -> DataFrame:
    k = F.col("item_id")
    return full_items(spark, sf).withColumn(
        "tmdb_id", F.when(k % 10 != 4, F.col("tmdb_id"))
    )


@query(
    "p11_enrichment_candidates",
    cte("items")
    + "select item_id from items where imdb_id is not null or tmdb_id is not null",
)
def p11(spark, sf):
    return _unlinked(spark, sf).where(E.has_gaps()).select("item_id")


_E4 = f"""
  , offers as (select cast(p_partkey as bigint) as k, {_POSTER} as poster,
      case p_partkey % 4 when 0 then 'tra' || p_partkey when 1 then 'tra' || p_partkey end as tra,
      case p_partkey % 3 when 0 then 'Homeflix' end as flix,
      case when p_partkey % 2 = 0 then 'Saga ' || p_brand end as saga,
      case p_partkey % 3 when 0 then 'R' when 1 then '12' end as cert,
      'Plot of ' || p_name as plot from part where p_size % 2 = 0)
"""


@query(
    "e4_enrichment",
    cte("items") + _E4
    + """select i.item_id, coalesce(i.poster_path, o.poster) as poster_path,
      'https://www.youtube.com/watch?v=' || o.tra as trailer_url, o.flix as providers,
      coalesce(i.collection_name, o.saga) as collection_name,
      coalesce(i.certification, o.cert) as certification,
      md5(coalesce(i.overview, o.plot)) as overview,
      array_to_string(coalesce(i.genres, case when o.k is not null then ['War'] end), '|')
        as genres
      from items i left join offers o on o.k = i.item_id
        and not (i.item_id % 10 = 4 and i.item_id % 20 = 14)""",
)
def e4(spark, sf):
    rows = _unlinked(spark, sf)
    # Looked up before: 0 marks those that are not there.
    mapping = rows.where(F.col("tmdb_id").isNull()).select(
        "imdb_id",
        F.when(F.col("item_id") % 20 != 14, F.col("item_id")).otherwise(0).alias("tmdb_id"),
    )
    done = E.enrich(rows, landed_payloads(spark, sf), mapping)
    return done.select(
        "item_id", "poster_path", "trailer_url",
        F.array_join("streaming_providers", "|").alias("providers"),
        "collection_name", "certification", F.md5("overview").alias("overview"),
        *joined("genres"),
    )


@query(
    "j11_fill_null_update",
    """select o.o_orderkey, coalesce(case when o.o_orderkey % 3 <> 0 then o_totalprice end,
       l.price) as o_totalprice from orders o left join (select l_orderkey,
       max(l_extendedprice) as price from lineitem group by l_orderkey) l
       on l.l_orderkey = o.o_orderkey""",
)
def j11(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("o_totalprice"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("o_totalprice")
    )
    best = last_write(lines, ["o_orderkey"], ["o_totalprice"])
    return E.fill_gaps(rows, best, "o_orderkey", ["o_totalprice"])


@query(
    "r16_item_detail",
    cte("items")
    + """select i.item_id, coalesce('New ' || p.p_name, i.title) as title, i.original_title,
      case when p.p_partkey % 6 <> 0 then cast(60 + p.p_partkey % 90 as int)
        else i.runtime_minutes end as runtime_minutes, i.vote_count,
      coalesce(case when p.p_partkey is not null then 7.5 end, i.rating_value) as rating_value,
      case when p.p_partkey is not null then 'Lead ' || p.p_brand
        else array_to_string(i.people, '|') end as people,
      case when p.p_partkey is not null then 'Released' end as status
      from items i left join part p on p.p_partkey = i.item_id and p.p_size % 2 = 0""",
)
def r16(spark, sf):
    rows = full_items(spark, sf)
    done = E.with_details(rows, landed_payloads(spark, sf))
    return done.select(
        "item_id", "title", "original_title", "runtime_minutes", "vote_count", "rating_value",
        F.array_join("cast", "|").alias("people"), "status",
    )


@query(
    "f46_standard_result",
    cte("items")
    + """select tmdb_id, coalesce(title, 'Unknown Movie') as title, release_year, vote_count,
      array_to_string(coalesce(genres, []), '|') as genres,
      cast(nullif(runtime_minutes, 0) as int) as runtime, nullif(rating_value, 0) as rating,
      coalesce(nullif(popularity, 0), 0) as retrieval_score from items""",
)
def f46(spark, sf):
    rows = full_items(spark, sf).withColumn("score", F.col("popularity"))
    done = A.standard_result(rows)
    return done.select(
        "tmdb_id", "title", "release_year", "vote_count", *joined("genres"), "runtime", "rating",
        "retrieval_score",
    )


@query(
    "r15_catalogue_statistics_a23",
    cte("items")
    + """select 'total_items' as name, count(*) as value from items
      union all select 'total_vectors', count(*) from embeddings
      union all select 'total_genres', count(distinct g) from (select unnest(genres) as g
        from items)
      union all select 'total_languages', count(distinct g) from (select unnest(languages) as g
        from items)""",
)
def r15(spark, sf):
    return A.catalogue_statistics(items(spark, sf), vectors(spark, sf))
