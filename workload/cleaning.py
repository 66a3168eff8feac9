"""Cleaning expressions, table cleaners, and conforming to the item schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from curatrix.functions import text as X
from curatrix.operators.grouping import keep_one
from curatrix.plans import cleaning as C, conform as M
from curatrix.schema import conform_items

from . import query
from .fixtures import cte, items, log, raw, table

_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def ct(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def as_int(x: str, kind: str = "int") -> str:
    return f"case when regexp_matches({x}, '^[+-]?[0-9]+$') then try_cast({x} as {kind}) end"


def joined(*names):
    """List columns as text, for comparison."""
    return [F.array_join(n, "|").alias(n) for n in names]


# --- expressions -----------------------------------------------------------
@query(
    "f1_clean_text",
    f"select doc_id, md5({ct('text')}) as digest, length({ct('text')}) as size from documents",
)
def f1(spark, sf):
    c = X.clean_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("size")
    )


_MIXED = """case o_orderkey % 5 when 0 then 'abc' when 1 then cast(o_orderkey as varchar) || '.6'
    when 2 then null else cast(o_orderkey as varchar) end"""


def _mixed():
    s = F.col("o_orderkey").cast("string")
    return (
        F.when(F.col("o_orderkey") % 5 == 0, "abc")
        .when(F.col("o_orderkey") % 5 == 1, F.concat(s, F.lit(".6")))
        .when(F.col("o_orderkey") % 5 == 2, None)
        .otherwise(s)
    )


@query(
    "f2_lenient_number",
    f"""select o_orderkey, {as_int(_MIXED)} as as_int, try_cast({_MIXED} as double) as as_double
        from orders""",
)
def f2(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        X.lenient(_mixed(), "int").alias("as_int"),
        X.lenient(_mixed(), "double").alias("as_double"),
    )


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    "f3_lenient_date_and_f13_year",
    f"""select o_orderkey, strftime(d, '%Y-%m-%d') as day, cast(year(d) as int) as year from (
        select o_orderkey, case when o_orderkey % 4 in (0, 2) then try_cast({_DAY} as date) end
        as d from orders)""",
)
def f3(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k.isin(0, 2), day).when(k == 1, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(
        "invalid-date"
    )
    d = X.iso_date(text)
    return table(spark, sf, "orders").select(
        "o_orderkey", d.cast("string").alias("day"), F.year(d).alias("year")
    )


@query("f4_rescale_rating", "select event_id, round(value * 2, 6) as scaled from events")
def f4(spark, sf):
    scaled = X.rescale(F.col("value").cast("string"), 5.0)
    return table(spark, sf, "events").select("event_id", F.round(scaled, 6).alias("scaled"))


@query(
    "f5_json_list",
    cte("raw_metadata")
    + r"""select id, array_to_string(regexp_extract_all(genres,
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1), '|') as genres,
        array_to_string(regexp_extract_all(production_companies,
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1), '|') as companies from raw_metadata""",
)
def f5(spark, sf):
    m = raw(spark, sf, "metadata")
    return m.select(
        "id",
        F.array_join(X.json_values(F.col("genres")), "|").alias("genres"),
        F.array_join(X.json_values(F.col("production_companies")), "|").alias("companies"),
    )


_DIRECTORS = r"""list_transform(regexp_extract_all(crew,
    '\{[^{}]*?[''"]job[''"]:\s*[''"]Director[''"][^{}]*?\}'), lambda o:
    regexp_extract(o, '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1))"""


@query(
    "f6_crew_directors",
    cte("raw_credits")
    + f"select id, array_to_string({_DIRECTORS}, '|') as directors from raw_credits",
)
def f6(spark, sf):
    return raw(spark, sf, "credits").select(
        "id", F.array_join(X.director_names(F.col("crew")), "|").alias("directors")
    )


@query(
    "f7_quoted_tokens",
    cte("raw_principals")
    + """select tconst, ordering, nconst,
      array_to_string(regexp_extract_all(characters, '"([^"]*?)"', 1), '|') as characters
      from raw_principals""",
)
def f7(spark, sf):
    return raw(spark, sf, "principals").select(
        "tconst",
        "ordering",
        "nconst",
        F.array_join(X.quoted_tokens(F.col("characters")), "|").alias("characters"),
    )


@query(
    "f8_split_lists",
    cte("raw_titles", "raw_movies")
    + """select ltrim(tconst) as id, len(string_split(genres, ',')) as parts,
         string_split(genres, ',')[1] as head from raw_titles union all
         select movieId, len(string_split(genres, '|')), string_split(genres, '|')[1]
         from raw_movies""",
)
def f8(spark, sf):
    def cut(df, key, sep):
        parts = X.split_list(F.col("genres"), sep)
        return df.select(
            F.trim(key).alias("id"),
            F.when(parts.isNotNull(), F.size(parts)).cast("bigint").alias("parts"),
            F.get(parts, 0).alias("head"),
        )

    return cut(raw(spark, sf, "titles"), "tconst", ",").unionByName(
        cut(raw(spark, sf, "movies"), "movieId", "|")
    )


_YEAR_RE = r"\s*\(([0-9]{4})\)\s*$"


@query(
    "f9_title_year_split",
    cte("raw_movies")
    + f"""select movieId, trim(regexp_replace(title, '{_YEAR_RE}', '')) as title,
      try_cast(nullif(regexp_extract(title, '{_YEAR_RE}', 1), '') as int) as release_year
      from raw_movies""",
)
def f9(spark, sf):
    t = F.col("title")
    return raw(spark, sf, "movies").select(
        "movieId", X.title_without_year(t).alias("title"), X.title_year(t).alias("release_year")
    )


@query(
    "f10_padded_id",
    """select o_orderkey, 'tt' || case when length(k) < 7 then lpad(k, 7, '0') else k end as id
       from (select o_orderkey, cast(o_orderkey * 997 as varchar) as k from orders)""",
)
def f10(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", X.title_id(F.col("o_orderkey") * 997).alias("id")
    )


@query(
    "f11_match_key",
    """select doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) as key_digest
       from documents where regexp_replace(lower(text), '[^a-z0-9]', '', 'g') <> ''""",
)
def f11(spark, sf):
    docs = table(spark, sf, "documents").withColumn("k", X.match_key(F.col("text")))
    return docs.where(F.col("k").isNotNull()).select("doc_id", F.md5("k").alias("key_digest"))


@query(
    "f12_pattern_test",
    r"""select page_id, regexp_matches(url, '^https?://[a-z.]+/[a-z]{2}/\d+$') as plain
        from pages""",
)
def f12(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.col("url").rlike(r"^https?://[a-z.]+/[a-z]{2}/\d+$").alias("plain")
    )


@query(
    "f32_canonical_genres",
    cte("log")
    + r"""select query_id, case lower(text) when 'best action movies' then 'Best Action Movies'
      else list_aggregate(list_transform(string_split(regexp_replace(lower(text),
        '(^|[^\p{L}])(\p{L})', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda p: upper(p[1:1]) || p[2:]), 'string_agg', '') end || '|Science Fiction|Horror'
      as genres from log""",
)
def f32(spark, sf):
    names = F.array(F.col("text"), F.lit(" Sci-Fi "), F.lit("HORROR"), F.lit("scifi"))
    return log(spark, sf).select(
        "query_id", F.array_join(X.canonical_genres(names), "|").alias("genres")
    )


@query(
    "f33_genre_alias",
    cte("items")
    + """select item_id, g as genre, case when lower(g) in ('sci-fi', 'science fiction')
      then 'science fiction' else lower(g) end as k from
      (select item_id, unnest(genres) as g from items)""",
)
def f33(spark, sf):
    return items(spark, sf).select("item_id", F.explode("genres").alias("genre")).select(
        "item_id", "genre", X.genre_key(F.col("genre")).alias("k")
    )


_LANG = """case lower(trim(x)) when 'english' then 'en' when 'mandarin' then 'zh'
    when 'fr' then 'fr' when 'en' then 'en' when 'de' then 'de' when 'es' then 'es' end"""


@query(
    "p14_language_code",
    "with t as (select doc_id, case doc_id % 4 when 0 then lang when 1 then ' English '"
    " when 2 then 'Klingon' else 'MANDARIN' end as x from documents) "
    f"select doc_id, {_LANG} as code from t",
)
def p14(spark, sf):
    k = F.col("doc_id") % 4
    x = (
        F.when(k == 0, F.col("lang"))
        .when(k == 1, " English ")
        .when(k == 2, "Klingon")
        .otherwise("MANDARIN")
    )
    return table(spark, sf, "documents").select("doc_id", X.language_code(x).alias("code"))


@query(
    "f47_finite_samples",
    "select event_id, case when event_id % 9 in (0, 1) then null else value end as value "
    "from events",
)
def f47(spark, sf):
    k = F.col("event_id") % 9
    v = (
        F.when(k == 0, F.lit(float("nan")))
        .when(k == 1, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return table(spark, sf, "events").select("event_id", X.finite(v).alias("value"))


@query(
    "p7_category_filter",
    cte("raw_titles")
    + "select tconst, titleType from raw_titles where titleType in ('movie','short','tvMovie')",
)
def p7(spark, sf):
    t = raw(spark, sf, "titles")
    return t.where(F.col("titleType").isin(C.TITLE_KINDS)).select("tconst", "titleType")


@query(
    "p8_numeric_id_filter",
    cte("raw_metadata")
    + "select cast(id as bigint) as id from raw_metadata where regexp_matches(id, '^[0-9]+$')",
)
def p8(spark, sf):
    return C.numeric_id_rows(raw(spark, sf, "metadata")).select("id")


@query(
    "w3_keep_one_per_key",
    """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (
       partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""",
)
def w3(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return keep_one(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# --- table cleaners --------------------------------------------------------
SQL = {
    "titles": f"""select distinct {ct('tconst')} as tconst, titleType as title_type,
        {ct('primaryTitle')} as title, {ct('originalTitle')} as original,
        {as_int('startYear')} as start_year, {as_int('runtimeMinutes')} as minutes,
        genres from raw_titles where titleType in ('movie', 'short', 'tvMovie')""",
    "title_ratings": f"""select tconst, try_cast(averageRating as float) as rating,
        {as_int('numVotes', 'bigint')} as votes from raw_title_ratings""",
    "names": f"select nconst, {ct('primaryName')} as name from raw_names",
    "crew": "select tconst, string_split(directors, ',') as directors, "
            "string_split(writers, ',') as writers from raw_crew",
    "principals": f"select tconst, {as_int('ordering')} as ordering, nconst, category "
                  "from raw_principals",
    "metadata": rf"""select cast(id as bigint) as id, imdb_id, {ct('title')} as title,
        original_title, {ct('overview')} as overview, regexp_extract_all(genres,
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1) as genres, try_cast(runtime as int) as minutes,
        case when release_date like '____-__-__' then year(try_cast(release_date as date)) end
        as release_year, cast(vote_average as float) as rating, cast(vote_count as bigint) as votes,
        popularity, regexp_extract_all(production_companies,
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1) as companies, original_language, tagline
        from raw_metadata where regexp_matches(id, '^[0-9]+$')""",
    "credits": rf"""select cast(id as bigint) as id, regexp_extract_all("cast",
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1) as people, {_DIRECTORS} as directors
        from raw_credits""",
    "keywords": r"""select cast(id as bigint) as id, regexp_extract_all(keywords,
        '[''"]name[''"]:\s*[''"]([^''"]*?)[''"]', 1) as keywords from raw_keywords""",
    "links": """select cast(movieId as bigint) as movie_id, 'tt' || lpad(imdbId, 7, '0') as imdb_id,
        cast(tmdbId as bigint) as tmdb_id from raw_links""",
    "movies": f"""select cast(movieId as bigint) as movie_id,
        trim(regexp_replace(title, '{_YEAR_RE}', '')) as title,
        try_cast(nullif(regexp_extract(title, '{_YEAR_RE}', 1), '') as int) as release_year,
        string_split(genres, '|') as genres from raw_movies""",
    "user_ratings": "select cast(movieId as bigint) as movie_id, "
                    "try_cast(rating as double) * 2 as rating from raw_user_ratings",
    "plots": f"""select {as_int('"Release Year"')} as release_year, {ct('"Title"')} as title,
        {ct('"Director"')} as director, {ct('"Cast"')} as people, {ct('"Genre"')} as genre,
        {ct('"Wiki Page"')} as wiki_page, {ct('"Plot"')} as plot from raw_plots""",
}


def clean_cte(*names: str) -> str:
    """CTEs of raw tables and of their cleaned forms (c_<name>)."""
    return (
        cte(*[f"raw_{n}" for n in names]).rstrip()
        + ",\n"
        + ",\n".join(f"c_{n} as ({SQL[n]})" for n in names)
        + "\n"
    )


def cleaned(spark, sf, name: str) -> DataFrame:
    fn = {
        "titles": C.clean_titles,
        "title_ratings": C.clean_title_ratings,
        "names": C.clean_names,
        "crew": C.clean_crew,
        "principals": C.clean_principals,
        "metadata": C.clean_metadata,
        "credits": C.clean_credits,
        "keywords": C.clean_keywords,
        "links": C.clean_links,
        "movies": C.clean_movies,
        "user_ratings": C.clean_ratings,
        "tags": C.clean_tags,
        "plots": C.clean_plots,
    }[name]
    return fn(raw(spark, sf, name))


@query(
    "v7_clean_titles",
    clean_cte("titles")
    + """select tconst, title_type, title, original, start_year, minutes,
         array_to_string(string_split(genres, ','), '|') as genres from c_titles""",
)
def v7_titles(spark, sf):
    t = cleaned(spark, sf, "titles")
    return t.select(
        "tconst",
        F.col("titleType").alias("title_type"),
        F.col("primaryTitle").alias("title"),
        F.col("originalTitle").alias("original"),
        F.col("startYear").alias("start_year"),
        F.col("runtimeMinutes").alias("minutes"),
        *joined("genres"),
    )


@query(
    "v7_clean_title_ratings",
    clean_cte("title_ratings")
    + "select tconst, round(cast(rating as double), 2) as rating, votes from c_title_ratings",
)
def v7_ratings(spark, sf):
    r = cleaned(spark, sf, "title_ratings")
    return r.select(
        "tconst",
        F.round(F.col("averageRating").cast("double"), 2).alias("rating"),
        F.col("numVotes").alias("votes"),
    )


@query(
    "v7_clean_people",
    clean_cte("names", "crew", "principals")
    + """select 'name' as kind, nconst as id, name as value, count(*) as n from c_names
         group by all union all select 'crew', tconst, array_to_string(directors, '|'), count(*)
         from c_crew group by all union all select 'principal', tconst,
         nconst || category || cast(ordering as varchar), count(*) from c_principals group by all""",
)
def v7_people(spark, sf):
    names = cleaned(spark, sf, "names").select(
        F.lit("name").alias("kind"), F.col("nconst").alias("id"), F.col("primaryName").alias("value")
    )
    crew = cleaned(spark, sf, "crew").select(
        F.lit("crew").alias("kind"),
        F.col("tconst").alias("id"),
        F.array_join("directors", "|").alias("value"),
    )
    principals = cleaned(spark, sf, "principals").select(
        F.lit("principal").alias("kind"),
        F.col("tconst").alias("id"),
        F.concat("nconst", "category", F.col("ordering").cast("string")).alias("value"),
    )
    rows = names.unionByName(crew).unionByName(principals)
    return rows.groupBy("kind", "id", "value").agg(F.count("*").alias("n"))


@query(
    "v7_clean_metadata",
    clean_cte("metadata")
    + """select id, imdb_id, title, md5(overview) as overview, array_to_string(genres, '|')
         as genres, cast(release_year as int) as release_year,
         round(cast(rating as double), 2) as rating, votes,
         array_to_string(companies, '|') as companies from c_metadata""",
)
def v7_metadata(spark, sf):
    m = cleaned(spark, sf, "metadata")
    return m.select(
        "id",
        "imdb_id",
        "title",
        F.md5("overview").alias("overview"),
        *joined("genres"),
        F.year("release_date").alias("release_year"),
        F.round(F.col("vote_average").cast("double"), 2).alias("rating"),
        F.col("vote_count").alias("votes"),
        F.array_join("production_companies", "|").alias("companies"),
    )


@query(
    "v7_clean_credits_keywords",
    clean_cte("credits", "keywords")
    + """select c.id, array_to_string(people, '|') as people, array_to_string(directors, '|')
         as directors, array_to_string(keywords, '|') as keywords
         from c_credits c full join c_keywords k on k.id = c.id where c.id is not null""",
)
def v7_credits(spark, sf):
    c = cleaned(spark, sf, "credits").select(
        "id",
        F.array_join("cast_names", "|").alias("people"),
        F.array_join("director_names", "|").alias("directors"),
    )
    k = cleaned(spark, sf, "keywords").select("id", *joined("keywords"))
    return c.join(k, "id", "left")


@query(
    "v7_clean_ratings_source",
    clean_cte("links", "movies")
    + """select m.movie_id, m.title, m.release_year, array_to_string(genres, '|') as genres,
         l.imdb_id, l.tmdb_id from c_movies m join c_links l on l.movie_id = m.movie_id""",
)
def v7_movies(spark, sf):
    m = cleaned(spark, sf, "movies")
    links = cleaned(spark, sf, "links")
    return m.select("movieId", "title", "release_year", *joined("genres")).join(
        links, "movieId"
    ).withColumnsRenamed({"movieId": "movie_id", "imdbId": "imdb_id", "tmdbId": "tmdb_id"})


@query(
    "v7_clean_tags",
    cte("raw_tags")
    + f"""select {ct('tag')} as tag, count(*) as n, max(cast("timestamp" as bigint)) as newest
          from raw_tags group by 1""",
)
def v7_tags(spark, sf):
    return cleaned(spark, sf, "tags").groupBy("tag").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("newest")
    )


@query(
    "v7_clean_plots",
    clean_cte("plots")
    + "select wiki_page, title, release_year, director, people, genre, md5(plot) as plot "
    "from c_plots",
)
def v7_plots(spark, sf):
    p = cleaned(spark, sf, "plots")
    return p.select(
        F.col("Wiki Page").alias("wiki_page"),
        F.col("Title").alias("title"),
        F.col("Release Year").alias("release_year"),
        F.col("Director").alias("director"),
        F.col("Cast").alias("people"),
        F.col("Genre").alias("genre"),
        F.md5("Plot").alias("plot"),
    )


# Source table -> the raw table that stands for it.
_STANDS_FOR = {
    ("imdb", "title.basics"): "titles", ("imdb", "title.ratings"): "title_ratings",
    ("imdb", "title.principals"): "principals", ("imdb", "title.crew"): "crew",
    ("imdb", "name.basics"): "names", ("tmdb", "movies_metadata"): "metadata",
    ("tmdb", "credits"): "credits", ("tmdb", "keywords"): "keywords", ("tmdb", "links"): "links",
    ("tmdb", "links_small"): "links", ("tmdb", "ratings_small"): "user_ratings",
    ("movielens", "movies"): "movies", ("movielens", "ratings"): "user_ratings",
    ("movielens", "tags"): "tags", ("movielens", "links"): "links",
    ("wikipedia", "wiki_movie_plots"): "plots",
}


def _null(*values: str) -> str:
    return " + ".join(f"(({v}) is null)::int" for v in values)


# Raw table -> (rows kept, nulls of a raw row, nulls of a kept row), over the
# columns that can be null or become it.
_VOLUMES = {
    "titles": (
        "(select distinct * from raw_titles where titleType in ('movie', 'short', 'tvMovie'))",
        _null("startYear", "endYear", "genres"),
        _null(as_int("startYear"), "endYear", as_int("runtimeMinutes"), "genres"),
    ),
    "title_ratings": ("raw_title_ratings", "0", _null(as_int("numVotes", "bigint"))),
    "principals": ("raw_principals", _null("characters"), _null("characters")),
    "crew": ("raw_crew", _null("writers"), _null("writers")),
    "names": (
        "raw_names", _null("knownForTitles"), _null("knownForTitles", as_int("deathYear")),
    ),
    "metadata": (
        "(select * from raw_metadata where regexp_matches(id, '^[0-9]+$'))",
        _null("imdb_id", "overview", "original_language"),
        _null("imdb_id", "overview", "original_language")
        + " + (release_date not like '____-__-__')::int",
    ),
    "credits": ("raw_credits", "0", "0"),
    "keywords": ("raw_keywords", "0", "0"),
    "links": ("raw_links", _null("tmdbId"), _null("tmdbId")),
    "user_ratings": ("raw_user_ratings", "0", _null("try_cast(rating as double)")),
    "movies": ("raw_movies", "0", "(not regexp_matches(title, '[(][0-9]{4}[)]'))::int"),
    "tags": ("raw_tags", _null("userId"), _null("userId")),
    "plots": (
        '(select distinct * from raw_plots)', _null('"Cast"', '"Plot"'), _null('"Cast"', '"Plot"'),
    ),
}


def _volume_sql(key: tuple[str, str], name: str) -> str:
    kept, before, after = _VOLUMES[name]
    return f"""select '{"/".join(key)}' as "table", a.n as initial_rows, b.n as final_rows,
        a.n - b.n as removed_rows, cast(greatest(0, b.k - a.k) as bigint) as null_corrections
      from (select count(*) as n, coalesce(sum({before}), 0) as k from raw_{name}) a,
        (select count(*) as n, coalesce(sum({after}), 0) as k from {kept}) b"""


@query(
    "a22_cleaning_report",
    cte(*[f"raw_{n}" for n in _VOLUMES])
    + "\nunion all ".join(_volume_sql(k, n) for k, n in _STANDS_FOR.items()),
)
def a22(spark, sf):
    """All sixteen source tables."""
    return C.cleaning_reports({k: raw(spark, sf, n) for k, n in _STANDS_FOR.items()})


# --- conform ---------------------------------------------------------------
@query(
    "p1_enforce_schema",
    """select cast(p_partkey as bigint) as tmdb_id, p_name as title, cast(p_size as int)
       as runtime_minutes, case when p_partkey % 3 = 0 then null
       else round(cast(cast(p_retailprice / 1000 as float) as double), 2) end as rating_value, 'shop' as source_dataset,
       cast(29 as bigint) as columns from part""",
)
def p1(spark, sf):
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("tmdb_id"),
        F.col("p_name").alias("title"),
        F.col("p_size").cast("string").alias("runtime_minutes"),
        F.when(F.col("p_partkey") % 3 == 0, "?")
        .otherwise((F.col("p_retailprice") / 1000).cast("string"))
        .alias("rating_value"),
    )
    done = conform_items(rows, "shop")
    return done.select(
        "tmdb_id",
        "title",
        "runtime_minutes",
        F.round(F.col("rating_value").cast("double"), 2).alias("rating_value"),
        "source_dataset",
        F.lit(len(done.columns)).cast("bigint").alias("columns"),
    )


@query(
    "p2_align_stored_table",
    cte("items") + "select imdb_id, title, cast(null as bigint) as movielens_id, "
    "array_to_string(genres, '|') as genres from items",
)
def p2(spark, sf):
    from curatrix.session import settle

    stored = settle(items(spark, sf).drop("item_id", "plot_summary"), "aligned")
    return conform_items(stored).select("imdb_id", "title", "movielens_id", *joined("genres"))


NAME_LISTS = """
  , d_names as (select tconst, list(n.name order by pos) as directors from (
      select tconst, unnest(directors) as nconst, generate_subscripts(directors, 1) as pos
      from c_crew) k join c_names n on n.nconst = k.nconst group by tconst)
  , w_names as (select tconst, list(n.name order by pos) as writers from (
      select tconst, unnest(writers) as nconst, generate_subscripts(writers, 1) as pos
      from c_crew) k join c_names n on n.nconst = k.nconst group by tconst)
  , p_names as (select tconst, list(n.name order by ordering, n.name) as people
      from c_principals p join c_names n on n.nconst = p.nconst
      where category in ('actor', 'actress', 'self') group by tconst)
"""
TITLE_TABLES = ("titles", "title_ratings", "names", "crew", "principals")
TITLES_ROWS = """
  t_rows as (select t.tconst as imdb_id, t.title, t.original as original_title,
    string_split(t.genres, ',') as genres, t.minutes as runtime_minutes,
    t.start_year as release_year, r.rating as rating_value, r.votes as vote_count,
    d.directors, w.writers, p.people
    from c_titles t left join c_title_ratings r on r.tconst = t.tconst
    left join d_names d on d.tconst = t.tconst left join w_names w on w.tconst = t.tconst
    left join p_names p on p.tconst = t.tconst)
"""


@query(
    "j1_names_of_id_lists",
    clean_cte("names", "crew")
    + """, d_names as (select tconst, list(n.name order by pos) as directors from (
      select tconst, unnest(directors) as nconst, generate_subscripts(directors, 1) as pos
      from c_crew) k join c_names n on n.nconst = k.nconst group by tconst)
      select tconst, array_to_string(directors, '|') as directors from d_names""",
)
def j1(spark, sf):
    done = M.resolve_names(
        cleaned(spark, sf, "crew"), "tconst", "directors", cleaned(spark, sf, "names"), "directors"
    )
    return done.select("tconst", *joined("directors"))


@query(
    "j2_ordered_cast",
    clean_cte("names", "principals")
    + """select tconst, string_agg(n.name, '|' order by ordering, n.name) as people
      from c_principals p join c_names n on n.nconst = p.nconst
      where category in ('actor', 'actress', 'self') group by tconst""",
)
def j2(spark, sf):
    from curatrix.operators.grouping import ordered_names
    from curatrix.session import lookup_join

    acting = cleaned(spark, sf, "principals").where(F.col("category").isin(M.CAST_CATEGORIES))
    named = lookup_join(
        acting.select("tconst", "ordering", "nconst"),
        cleaned(spark, sf, "names").select("nconst", "primaryName"),
        ["nconst"],
        spread_by="tconst",
    )
    done = ordered_names(named, "tconst", "ordering", "primaryName", "people")
    return done.select("tconst", *joined("people"))


@query(
    "j3_satellite_chain",
    """select c.c_custkey, c.c_name, n.n_name, r.r_name, o.orders from customer c
       left join nation n on n.n_nationkey = c.c_nationkey
       left join region r on r.r_regionkey = n.n_regionkey
       left join (select o_custkey, count(*) as orders from orders group by o_custkey) o
         on o.o_custkey = c.c_custkey""",
)
def j3(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(r, n.n_regionkey == r.r_regionkey, "left")
        .join(orders, c.c_custkey == orders.o_custkey, "left")
        .select("c_custkey", "c_name", "n_name", "r_name", "orders")
    )


def titles_source(spark, sf) -> DataFrame:
    return M.conform_titles(
        *[
            cleaned(spark, sf, n)
            for n in ("titles", "title_ratings", "crew", "principals", "names")
        ]
    )


def metadata_source(spark, sf) -> DataFrame:
    return M.conform_metadata(
        *[cleaned(spark, sf, n) for n in ("metadata", "credits", "keywords")]
    )


def movies_source(spark, sf) -> DataFrame:
    return M.conform_movies(
        cleaned(spark, sf, "movies"),
        cleaned(spark, sf, "user_ratings"),
        cleaned(spark, sf, "links"),
    )


def plots_source(spark, sf) -> DataFrame:
    return M.conform_plots(cleaned(spark, sf, "plots"))


def shown(df: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    people = [F.array_join("cast", "|").alias("people")] if "cast" in lists else []
    return df.select(
        *scalars,
        F.round(F.col("rating_value").cast("double"), 4).alias("rating_value"),
        *joined(*[n for n in lists if n != "cast"]),
        *people,
    )


@query(
    "p3_conform_titles",
    clean_cte(*TITLE_TABLES) + NAME_LISTS + "," + TITLES_ROWS
    + """select imdb_id, title, original_title, runtime_minutes, release_year, vote_count,
      'imdb' as source_dataset, round(cast(rating_value as double), 4) as rating_value,
      array_to_string(genres, '|') as genres, array_to_string(directors, '|') as directors,
      array_to_string(writers, '|') as writers, array_to_string(people, '|') as people
      from t_rows""",
)
def p3(spark, sf):
    return shown(
        titles_source(spark, sf),
        ["imdb_id", "title", "original_title", "runtime_minutes", "release_year", "vote_count",
         "source_dataset"],
        ["genres", "directors", "writers", "cast"],
    )


METADATA_TABLES = ("metadata", "credits", "keywords")
METADATA_ROWS = """
  m_rows as (select m.imdb_id, m.id as tmdb_id, m.title, m.original_title, m.overview, m.genres,
    c.people, c.directors, m.minutes as runtime_minutes,
    cast(m.release_year as int) as release_year, m.rating as rating_value, m.votes as vote_count,
    m.popularity, m.companies as production_companies,
    case when m.original_language is null then [] else [m.original_language] end as languages,
    k.keywords, m.tagline
    from c_metadata m left join c_credits c on c.id = m.id left join c_keywords k on k.id = m.id)
"""


@query(
    "p4_conform_metadata",
    clean_cte(*METADATA_TABLES) + "," + METADATA_ROWS
    + """select imdb_id, tmdb_id, title, original_title, md5(overview) as overview,
      runtime_minutes, release_year, vote_count, popularity, tagline, 'tmdb' as source_dataset,
      round(cast(rating_value as double), 4) as rating_value,
      array_to_string(genres, '|') as genres, array_to_string(directors, '|') as directors,
      array_to_string(production_companies, '|') as production_companies,
      array_to_string(languages, '|') as languages, array_to_string(keywords, '|') as keywords,
      array_to_string(people, '|') as people from m_rows""",
)
def p4(spark, sf):
    done = metadata_source(spark, sf).withColumn("overview", F.md5("overview")).withColumn(
        "popularity", F.col("popularity").cast("double")
    )
    return shown(
        done,
        ["imdb_id", "tmdb_id", "title", "original_title", "overview", "runtime_minutes",
         "release_year", "vote_count", "popularity", "tagline", "source_dataset"],
        ["genres", "directors", "production_companies", "languages", "keywords", "cast"],
    )


MOVIE_TABLES = ("movies", "user_ratings", "links")
MOVIE_ROWS = """
  l_rows as (select l.imdb_id, l.tmdb_id, m.movie_id as movielens_id, m.title, m.genres,
    m.release_year, cast(r.rating as float) as rating_value, r.votes as vote_count
    from c_movies m left join c_links l on l.movie_id = m.movie_id left join (
      select movie_id, avg(rating) as rating, count(rating) as votes from c_user_ratings
      group by movie_id) r on r.movie_id = m.movie_id)
"""


@query(
    "p5_conform_movies",
    clean_cte(*MOVIE_TABLES) + "," + MOVIE_ROWS
    + """select imdb_id, tmdb_id, movielens_id, title, release_year, vote_count,
      'movielens' as source_dataset, round(cast(rating_value as double), 4) as rating_value,
      array_to_string(genres, '|') as genres from l_rows""",
)
def p5(spark, sf):
    return shown(
        movies_source(spark, sf),
        ["imdb_id", "tmdb_id", "movielens_id", "title", "release_year", "vote_count",
         "source_dataset"],
        ["genres"],
    )


def _split_names(x: str, seps: str = ",") -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '[{seps}]'), "
        "lambda s: trim(s)), lambda s: s <> '')"
    )


PLOT_ROWS = f"""
  w_rows as (select wiki_page, title, plot as plot_summary, release_year,
    {_split_names('genre', ',/')} as genres, {_split_names('director')} as directors,
    {_split_names('people')} as people from c_plots)
"""


@query(
    "p6_conform_plots",
    clean_cte("plots") + "," + PLOT_ROWS
    + """select wiki_page, title, md5(plot_summary) as plot_summary, release_year,
      'wikipedia' as source_dataset, cast(null as double) as rating_value,
      array_to_string(genres, '|') as genres, array_to_string(directors, '|') as directors,
      array_to_string(people, '|') as people from w_rows""",
)
def p6(spark, sf):
    done = plots_source(spark, sf).withColumn("plot_summary", F.md5("plot_summary"))
    return shown(
        done,
        ["wiki_page", "title", "plot_summary", "release_year", "source_dataset"],
        ["genres", "directors", "cast"],
    )
