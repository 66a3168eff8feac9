"""Profiles, rule checks, reference checks, quality metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from curatrix.functions.text import title_id
from curatrix.operators import integrity as R, quality as Q
from curatrix.operators.grouping import duplicate_members
from curatrix.operators.quality import CRITICAL, HIGH, MEDIUM, Rule
from curatrix.session import settle

from . import query
from .fixtures import cte, full_items, items, raw, table

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _nulled(spark, sf):
    """orders with some values missing."""
    o = table(spark, sf, "orders").select(*ORDERS)
    return o.withColumn(
        "o_orderpriority", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority"))
    ).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))


_NULLED = """nulled as (select o_orderkey, o_custkey, o_orderstatus,
    case when o_orderkey % 3 <> 0 then o_totalprice end as o_totalprice,
    case when o_custkey % 5 <> 0 then o_orderpriority end as o_orderpriority from orders)"""


def _per_column(expr: str) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", {expr.format(c=c)} from nulled" for c in ORDERS
    )


@query(
    "a3_missing_values",
    f"with {_NULLED} "
    + _per_column(
        "count(*) - count({c}) as null_count, "
        "round((count(*) - count({c})) * 100.0 / count(*), 4) as null_pct"
    ),
)
def a3(spark, sf):
    return Q.missing_values(_nulled(spark, sf))


@query(
    "a4_distinct_values",
    f"with {_NULLED} "
    + _per_column(
        "count(distinct {c}) + cast(count(*) > count({c}) as int) as distinct_count"
    ),
)
def a4(spark, sf):
    return Q.distinct_values(_nulled(spark, sf))


@query(
    "a5_approximate_distinct",
    """select * from (values ('o_orderkey', true), ('o_custkey', true), ('o_orderstatus', true),
       ('o_totalprice', true), ('o_orderpriority', true)) t("column", near)""",
)
def a5(spark, sf):
    """Whether the sketches stay within a sixth of the exact counts."""
    rows = _nulled(spark, sf)
    sketch = Q.distinct_values(rows, approximate=True).withColumnRenamed("distinct_count", "n")
    both = sketch.join(Q.distinct_values(rows), "column")
    off = F.abs(F.col("n") - F.col("distinct_count"))
    return both.select("column", (off * 6 <= F.col("distinct_count") + 6).alias("near"))


_MEASURED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


@query(
    "v1_profile_of_batches",
    " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count(*) - count({c}) as missing,
          {f"cast(min({c}) as double)" if c != "o_orderstatus" else "cast(null as double)"} as least,
          {f"cast(max({c}) as double)" if c != "o_orderstatus" else "cast(null as double)"} as most,
          true as near from orders"""
        for c in _MEASURED
    ),
)
def v1_batches(spark, sf):
    """States of three batches of orders united: exact counts and ends, distinct
    values within a tenth and the median's rank within a twentieth of the whole."""
    from curatrix.operators import profile_state as P
    from curatrix.session import scratch_path

    rows = table(spark, sf, "orders").select(*_MEASURED)
    path = scratch_path(spark, "profile")
    for batch in range(3):
        P.put_profile(rows.where(F.pmod("o_orderkey", F.lit(3)) == batch), path, batch)
    found = P.read_profile(spark, path)
    exact = P.column_values(rows).groupBy("column").agg(F.countDistinct("text").alias("exact"))
    median = F.get("quantiles", 1)
    ranks = (
        P.column_values(rows).join(found.select("column", median.alias("median")), "column")
        .groupBy("column")
        .agg(
            F.try_divide(F.count_if(F.col("number") <= F.col("median")), F.count("number")).alias("rank")
        )
    )
    near = (F.abs(F.col("distinct") - F.col("exact")) * 10 <= F.col("exact") + 10) & (
        F.col("rank").isNull() | (F.abs(F.col("rank") - 0.5) <= 0.05)
    )
    return found.join(exact, "column").join(ranks, "column").select(
        "column", "n_rows", "missing", F.col("least_number").alias("least"),
        F.col("most_number").alias("most"), near.alias("near"),
    )


@query(
    "a6_duplicate_rows",
    """with d as (select user_id, event_type from events)
       select count(*) as row_count, count(*) - (select count(*) from (select distinct * from d))
       as duplicate_count, round((count(*) - (select count(*) from (select distinct * from d)))
       * 100.0 / count(*), 4) as duplicate_pct from d""",
)
def a6(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type"))


@query(
    "a9_duplicate_members",
    """select cast(sum(n) as bigint) as members from (select user_id, count(*) as n from events
       where user_id is not null group by user_id, event_type) where n > 1""",
)
def a9(spark, sf):
    e = table(spark, sf, "events").withColumn(
        "k", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    )
    return duplicate_members(e, ["k"])


@query(
    "a10_duplicate_members_composite",
    cte("items")
    + """select cast(coalesce(sum(n), 0) as bigint) as members from (
      select title, release_year, count(*) as n from items group by title, release_year)
      where n > 1""",
)
def a10(spark, sf):
    return duplicate_members(items(spark, sf), ["title", "release_year"], nulls_count=True)


@query(
    "a11_excess_keys",
    cte("raw_titles")
    + """select count(*) - count(distinct startYear) - cast(count(*) > count(startYear) as int)
      as excess from raw_titles""",
)
def a11(spark, sf):
    return Q.excess_keys(raw(spark, sf, "titles"), "startYear")


_BLANK = "({0} is null or trim({0}) = '')"
_FLAGS = {
    "missing_titles": _BLANK.format("title"),
    "empty_overviews": _BLANK.format("overview") + " and " + _BLANK.format("plot_summary"),
    "missing_genres": "genres is null or len(genres) = 0",
    "invalid_imdb_format": r"imdb_id is not null and not regexp_matches(imdb_id, '^tt\d{7,8}$')",
    "invalid_tmdb_ids": "tmdb_id <= 0",
    "invalid_movielens_ids": "false",
    "invalid_ratings": "rating_value < 1 or rating_value > 10",
    "orphan_records": "imdb_id is null and tmdb_id is null",
}
_METRICS = " union all ".join(
    f"select '{n}' as metric, count(*) filter (where {c}) as value from flawed"
    for n, c in _FLAGS.items()
) + "".join(
    f" union all select '{n}', cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) from "
    f"(select count(*) as n from flawed {where} group by {keys})"
    for n, keys, where in (
        ("duplicate_imdb_ids", "imdb_id", "where imdb_id is not null"),
        ("duplicate_tmdb_ids", "tmdb_id", "where tmdb_id is not null"),
        ("duplicate_title_year_combinations", "title, release_year", ""),
    )
)
# Items with flaws added, so that every metric has something to count.
_FLAWED = """, flawed as (select item_id, case when item_id % 9 = 0 then '  '
    when item_id % 17 = 0 then null else title end as title, overview, plot_summary, genres,
    case when item_id % 6 = 1 then 'tt' || item_id when item_id % 50 = 3 then null
      when item_id % 8 = 0 then 'tt0000008' else imdb_id end as imdb_id,
    case when item_id % 12 = 5 then -tmdb_id when item_id % 50 = 3 then null else tmdb_id end
      as tmdb_id, release_year, languages,
    case when item_id % 15 = 0 then 0.5 else rating_value end as rating_value from items)
"""


def flawed(spark, sf) -> DataFrame:
    c, k = F.col, F.col("item_id")
    return settle(full_items(spark, sf), "items").withColumns(
        {
            "title": F.when(k % 9 == 0, "  ").when(k % 17 == 0, None).otherwise(c("title")),
            "imdb_id": F.when(k % 6 == 1, F.concat(F.lit("tt"), k.cast("string")))
            .when(k % 50 == 3, None)
            .when(k % 8 == 0, "tt0000008")
            .otherwise(c("imdb_id")),
            "tmdb_id": F.when(k % 12 == 5, -c("tmdb_id"))
            .when(k % 50 == 3, None)
            .otherwise(c("tmdb_id")),
            "rating_value": F.when(k % 15 == 0, 0.5).otherwise(c("rating_value")),
        }
    )


@query("a12_quality_metrics", cte("items") + _FLAWED + _METRICS)
def a12(spark, sf):
    return Q.quality_metrics(flawed(spark, sf))


_KEEP = """not (title is null or trim(title) = '') and (imdb_id is not null or tmdb_id is not null)
    and (rating_value is null or (rating_value >= 1 and rating_value <= 10))"""


@query("p10_keep_valid", cte("items") + _FLAWED + f"select item_id from flawed where {_KEEP}")
def p10(spark, sf):
    return Q.keep_valid(flawed(spark, sf)).select("item_id")


@query(
    "a13_genre_frequency",
    cte("items")
    + """select g as value, count(*) as "count" from (select unnest(genres) as g from items)
      group by g""",
)
def a13(spark, sf):
    return Q.value_frequency(items(spark, sf), "genres")


@query(
    "a14_top_people",
    cte("items")
    + """select g as value, count(*) as "count" from (select unnest(people) as g from items)
      group by g order by 2 desc, 1 limit 30""",
)
def a14(spark, sf):
    return Q.value_frequency(items(spark, sf), "cast", 30)


_BIN = "greatest(1, least(9, cast(floor(rating_value) as int)))"


@query(
    "a15_rating_histogram",
    cte("items")
    + f"""select {_BIN} || '.0-' || ({_BIN} + 1) || '.0' as bin, count(*) as "count" from items
      where rating_value is not null group by 1""",
)
def a15(spark, sf):
    return Q.rating_histogram(items(spark, sf))


_V6 = (
    "select 'statistics' as section, 'initial_rows' as name, count(*)::double as value from flawed "
    f"union all select 'statistics', 'final_rows', count(*)::double from flawed where {_KEEP} "
    "union all select 'statistics', 'schema_consistent', 0.0 "
    f"union all select 'metrics', metric, value::double from ({_METRICS}) "
    "union all select 'genres', g, count(*)::double from (select unnest(genres) as g from flawed) "
    "group by g union all select * from (select 'languages', g, count(*)::double from "
    "(select unnest(languages) as g from flawed) group by g order by 3 desc, 2 limit 30) "
    f"union all select 'ratings', {_BIN} || '.0-' || ({_BIN} + 1) || '.0', count(*)::double "
    "from flawed where rating_value is not null group by 2 "
    + "".join(
        f"union all select 'missing', '{c}', (count(*) - count({c}))::double from flawed "
        for c in ("title", "imdb_id", "tmdb_id", "overview", "plot_summary", "genres",
                  "release_year", "rating_value", "languages")
    )
)


@query("v6_quality_report", cte("items") + _FLAWED + _V6)
def v6(spark, sf):
    rows = flawed(spark, sf).select(
        "title", "imdb_id", "tmdb_id", "overview", "plot_summary", "genres", "release_year",
        "rating_value", "languages", "movielens_id", "wiki_page",
    )
    report = Q.quality_report(rows)
    derived = F.col("name").isin("movielens_id", "wiki_page") & (F.col("section") == "missing")
    return report.where(~derived)


@query(
    "v1_profile",
    f"with {_NULLED} select * from ("
    + _per_column(
        "count(*) - count({c}) as null_count, "
        "round((count(*) - count({c})) * 100.0 / count(*), 4) as null_pct, "
        "count(distinct {c}) + cast(count(*) > count({c}) as int) as distinct_count"
    )
    + """) join (values ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'),
      ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderpriority', 'string'))
      t("column", type) using ("column") join (values ('orders')) c(component) on true""",
)
def v1(spark, sf):
    return Q.profile(_nulled(spark, sf), "orders")


# --- references ------------------------------------------------------------
@query(
    "j4_broken_references",
    """select 'orders' as child, count(*) as broken from orders o anti join
         (select * from customer where c_custkey % 10 <> 0) c on c.c_custkey = o.o_custkey
       union all select 'lineitem_part', count(*) from lineitem l anti join
         (select * from part where p_size <> 7) p on p.p_partkey = l.l_partkey
       union all select 'lineitem_supplier', count(*) from lineitem l anti join
         (select * from supplier where s_nationkey > 5) s on s.s_suppkey = l.l_suppkey
       union all select 'labels', count(*) from labels b anti join documents d
         on d.doc_id = b.doc_id""",
)
def j4(spark, sf):
    t = lambda n: table(spark, sf, n)
    checks = {
        "orders": (t("orders"), "o_custkey", t("customer").where("c_custkey % 10 <> 0"),
                   "c_custkey"),
        "lineitem_part": (t("lineitem"), "l_partkey", t("part").where("p_size <> 7"), "p_partkey"),
        "lineitem_supplier": (t("lineitem"), "l_suppkey", t("supplier").where("s_nationkey > 5"),
                              "s_suppkey"),
        "labels": (t("labels"), "doc_id", t("documents"), "doc_id"),
    }
    parts = [
        R.broken_references(*args).select(F.lit(n).alias("child"), "broken")
        for n, args in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "j5_cross_provider_links",
    cte("raw_links", "raw_titles", "raw_metadata")
    + r"""select 'imdb' as target, count(*) as total_links,
      count(*) filter (where imdbId is not null and t.tconst is null) as broken_links,
      round((count(*) - count(*) filter (where imdbId is not null and t.tconst is null)) * 100.0
        / count(*), 2) as match_pct
      from raw_links l left join (select distinct trim(tconst) as tconst from raw_titles
        where titleType <> 'tvEpisode') t on t.tconst = 'tt' || lpad(l.imdbId, 7, '0')
      union all
      select 'tmdb', count(*), count(*) filter (where tmdbId is not null and m.id is null),
      round((count(*) - count(*) filter (where tmdbId is not null and m.id is null)) * 100.0
        / count(*), 2)
      from raw_links l left join (select distinct id from raw_metadata
        where regexp_matches(id, '^\d+$')) m on m.id = l.tmdbId""",
)
def j5(spark, sf):
    links, titles = raw(spark, sf, "links"), raw(spark, sf, "titles")
    titles = titles.where(F.col("titleType") != "tvEpisode")
    meta = raw(spark, sf, "metadata").where(F.col("id").rlike(r"^\d+$"))
    a = R.link_report(links, title_id(F.col("imdbId")), titles, F.trim("tconst"))
    b = R.link_report(
        links, F.col("tmdbId").try_cast("bigint"), meta, F.col("id").try_cast("bigint")
    )
    return a.withColumn("target", F.lit("imdb")).unionByName(
        b.withColumn("target", F.lit("tmdb"))
    )


# --- provider rules --------------------------------------------------------
def _title_issues(spark, sf) -> DataFrame:
    t, r, p, n, c = (
        raw(spark, sf, x) for x in ("titles", "title_ratings", "principals", "names", "crew")
    )
    t = t.withColumn("tconst", F.trim("tconst"))
    name = "titles"
    year = F.col("startYear")
    parts = [
        Q.check_rules(
            t,
            name,
            [
                Rule("key is null", CRITICAL, F.col("tconst").isNull()),
                Rule("key format", HIGH, ~F.col("tconst").rlike(r"^tt\d+$")),
                Rule("start year format", MEDIUM, ~year.rlike(r"^\d{4}$")),
            ],
        ),
        Q.as_issue(Q.excess_keys(t, "tconst"), "excess", name, "key is duplicated", CRITICAL),
        Q.as_issue(Q.excess_keys(n, "nconst"), "excess", name, "name key is duplicated", CRITICAL),
        Q.check_rules(
            r,
            name,
            [
                Rule(
                    "rating bounds",
                    HIGH,
                    ~F.col("averageRating").try_cast("double").between(0.0, 10.0),
                )
            ],
        ),
    ]
    kept = t.where(F.col("titleType") != "tvEpisode")
    for rule, child, key, parent, parent_key in (
        ("ratings to titles", r, "tconst", kept, "tconst"),
        ("principals to titles", p, "tconst", kept, "tconst"),
        ("principals to names", p, "nconst", n, "nconst"),
        ("crew to titles", c, "tconst", kept, "tconst"),
    ):
        broken = R.broken_references(child, key, parent, parent_key)
        parts.append(Q.as_issue(broken, "broken", name, rule, HIGH))
    return reduce(DataFrame.unionByName, parts)


_V2 = r"""
  select 'titles' as dataset, 'key is null' as rule, 'CRITICAL' as severity,
    count(*) filter (where tconst is null) as affected_rows from raw_titles
  union all select 'titles', 'key format', 'HIGH',
    count(*) filter (where not regexp_matches(trim(tconst), '^tt\d+$')) from raw_titles
  union all select 'titles', 'start year format', 'MEDIUM',
    count(*) filter (where not regexp_matches(startYear, '^\d{4}$')) from raw_titles
  union all select 'titles', 'key is duplicated', 'CRITICAL',
    count(*) - count(distinct tconst) from raw_titles
  union all select 'titles', 'name key is duplicated', 'CRITICAL',
    count(*) - count(distinct nconst) from raw_names
  union all select 'titles', 'rating bounds', 'HIGH', count(*) filter (where
    not try_cast(averageRating as double) between 0 and 10) from raw_title_ratings
  union all select 'titles', 'ratings to titles', 'HIGH', count(*) from raw_title_ratings r
    anti join kept t on t.tconst = r.tconst
  union all select 'titles', 'principals to titles', 'HIGH', count(*) from raw_principals r
    anti join kept t on t.tconst = r.tconst
  union all select 'titles', 'principals to names', 'HIGH', count(*) from raw_principals r
    anti join raw_names n on n.nconst = r.nconst
  union all select 'titles', 'crew to titles', 'HIGH', count(*) from raw_crew r
    anti join kept t on t.tconst = r.tconst
"""
_KEPT = """, kept as (select distinct trim(tconst) as tconst from raw_titles
    where titleType <> 'tvEpisode')
"""
_TITLE_RAW = ("raw_titles", "raw_title_ratings", "raw_principals", "raw_names", "raw_crew")


@query("v2_title_rules", cte(*_TITLE_RAW) + _KEPT + _V2)
def v2(spark, sf):
    return _title_issues(spark, sf)


@query(
    "v3_rating_rules",
    cte("raw_movies", "raw_user_ratings", "raw_tags", "raw_links")
    + """select 'ratings' as dataset, 'key null or duplicated' as rule, 'CRITICAL' as severity,
      count(*) - count(distinct movieId) as affected_rows from raw_movies
    union all select 'ratings', 'rating bounds', 'HIGH', count(*) filter (where
      try_cast(rating as double) < 0.5 or try_cast(rating as double) > 5) from raw_user_ratings
    union all select 'ratings', 'ratings to movies', 'HIGH', count(*) from raw_user_ratings r
      anti join raw_movies m on m.movieId = r.movieId
    union all select 'ratings', 'tags to movies', 'HIGH', count(*) from raw_tags r
      anti join raw_movies m on m.movieId = r.movieId
    union all select 'ratings', 'links to movies', 'HIGH', count(*) from raw_links r
      anti join raw_movies m on m.movieId = r.movieId""",
)
def v3(spark, sf):
    m, r, t, k = (raw(spark, sf, x) for x in ("movies", "user_ratings", "tags", "links"))
    name, value = "ratings", F.col("rating").try_cast("double")
    parts = [
        Q.as_issue(
            Q.excess_keys(m, "movieId"), "excess", name, "key null or duplicated", CRITICAL
        ),
        Q.check_rules(r, name, [Rule("rating bounds", HIGH, (value < 0.5) | (value > 5.0))]),
    ]
    for rule, child in (("ratings", r), ("tags", t), ("links", k)):
        broken = R.broken_references(child, "movieId", m, "movieId")
        parts.append(Q.as_issue(broken, "broken", name, f"{rule} to movies", HIGH))
    return reduce(DataFrame.unionByName, parts)


@query(
    "v4_metadata_rules",
    cte("raw_metadata", "raw_credits", "raw_keywords")
    + r"""select 'metadata' as dataset, 'numeric id' as rule, 'HIGH' as severity,
      count(*) filter (where not regexp_matches(id, '^\d+$')) as affected_rows from raw_metadata
    union all select 'metadata', 'date format', 'MEDIUM', count(*) filter (where
      release_date <> '' and not regexp_matches(release_date, '^\d{4}-\d{2}-\d{2}$'))
      from raw_metadata
    union all select 'metadata', 'id is duplicated', 'HIGH', count(*) - count(distinct id)
      from raw_metadata where regexp_matches(id, '^\d+$')
    union all select 'metadata', 'credits to metadata', 'MEDIUM', count(*) from raw_credits c
      anti join raw_metadata m on m.id = c.id
    union all select 'metadata', 'keywords to metadata', 'MEDIUM', count(*) from raw_keywords c
      anti join raw_metadata m on m.id = c.id""",
)
def v4(spark, sf):
    from curatrix.plans.cleaning import numeric_id_rows

    m, c, k = (raw(spark, sf, x) for x in ("metadata", "credits", "keywords"))
    numeric, day = numeric_id_rows(m), F.col("release_date")
    name = "metadata"
    parts = [
        Q.check_rules(
            m,
            name,
            [
                Rule("numeric id", HIGH, ~F.col("id").rlike(r"^\d+$")),
                Rule(
                    "date format", MEDIUM, (day != "") & ~day.rlike(r"^\d{4}-\d{2}-\d{2}$")
                ),
            ],
        ),
        Q.as_issue(Q.excess_keys(numeric, "id"), "excess", name, "id is duplicated", HIGH),
    ]
    for rule, child in (("credits", c), ("keywords", k)):
        broken = R.broken_references(numeric_id_rows(child), "id", numeric, "id")
        parts.append(Q.as_issue(broken, "broken", name, f"{rule} to metadata", MEDIUM))
    return reduce(DataFrame.unionByName, parts)


@query(
    "v5_plot_rules",
    cte("raw_plots")
    + r"""select 'plots' as dataset, 'plot is empty' as rule, 'HIGH' as severity,
      count(*) filter (where "Plot" is null or length("Plot") < 200) as affected_rows
      from raw_plots
    union all select 'plots', 'year format', 'MEDIUM', count(*) filter (where
      not regexp_matches("Release Year", '^20\d{2}$')) from raw_plots""",
)
def v5(spark, sf):
    return Q.check_rules(
        raw(spark, sf, "plots"),
        "plots",
        [
            Rule("plot is empty", HIGH, F.col("Plot").isNull() | (F.length("Plot") < 200)),
            Rule("year format", MEDIUM, ~F.col("Release Year").rlike(r"^20\d{2}$")),
        ],
    )


@query(
    "a28_validation_status",
    cte(*_TITLE_RAW) + _KEPT
    + f""", issues as ({_V2})
    select dataset, case when count(*) filter (where severity = 'CRITICAL' and affected_rows > 0)
      > 0 then 'FAILED' else 'PASSED' end as status,
      count(*) filter (where affected_rows > 0) as issues from issues group by dataset""",
)
def a28(spark, sf):
    return Q.validation_status(_title_issues(spark, sf))

