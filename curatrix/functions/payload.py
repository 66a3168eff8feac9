"""Flattening landed detail payloads (JSON text) into item fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Payload shape, image hosts and crew jobs.
PAYLOAD_SCHEMA = """
id long, imdb_id string, title string, original_title string, overview string,
runtime int, release_date string, status string, original_language string,
budget long, revenue long, homepage string, adult boolean, video boolean,
vote_count long, vote_average double, popularity double, tagline string,
poster_path string, backdrop_path string,
belongs_to_collection struct<id: long, name: string>,
genres array<struct<name: string>>,
production_companies array<struct<name: string>>,
production_countries array<struct<name: string>>,
keywords struct<keywords: array<struct<name: string>>, results: array<struct<name: string>>>,
credits struct<
  cast: array<struct<id: long, name: string>>,
  crew: array<struct<id: long, name: string, job: string>>>,
videos struct<results: array<struct<site: string, type: string, name: string, key: string>>>,
`watch/providers` struct<
  results: map<string, struct<flatrate: array<struct<provider_name: string>>>>>,
release_dates struct<results: array<struct<
  iso_3166_1: string, release_dates: array<struct<certification: string>>>>>,
images struct<logos: array<struct<file_path: string>>>,
similar struct<results: array<struct<
  id: long, title: string, release_date: string, vote_average: double,
  poster_path: string, backdrop_path: string>>>,
recommendations struct<results: array<struct<
  id: long, title: string, release_date: string, vote_average: double,
  poster_path: string, backdrop_path: string>>>
"""
POSTER_BASE = "https://image.tmdb.org/t/p/w500"
BACKDROP_BASE = "https://image.tmdb.org/t/p/w1280"
TRAILER_BASE = "https://www.youtube.com/watch?v="
JOBS = {
    "directors": ["Director"],
    "writers": ["Writer", "Screenplay", "Author"],
    "producer": ["Producer"],
    "composer": ["Original Music Composer", "Music"],
    "cinematographer": ["Director of Photography", "Cinematography"],
}
PREFERRED_COUNTRIES = ["US", "IN"]


def parsed_payload(df: DataFrame, json_col: str, into: str = "p") -> DataFrame:
    return df.withColumn(into, F.from_json(json_col, PAYLOAD_SCHEMA))


def image_url(path: Column, base: str) -> Column:
    """Full address of an image; absolute ones and blanks stay as they are."""
    return F.when(
        path.isNull() | (path == "") | path.startswith("http"), path
    ).otherwise(F.concat(F.lit(base), path))


def names(values: Column) -> Column:
    return F.filter(
        F.transform(values, lambda e: e["name"]), lambda n: n.isNotNull() & (n != "")
    )


def none_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def crew_names(p: Column, role: str) -> Column:
    return names(F.filter(p["credits"]["crew"], lambda m: m["job"].isin(JOBS[role])))


def keyword_names(p: Column) -> Column:
    k = p["keywords"]
    return names(F.coalesce(none_if_empty(k["keywords"]), k["results"]))


def _youtube(p: Column, kind: str) -> Column:
    return F.filter(
        p["videos"]["results"], lambda v: (v["site"] == "YouTube") & (v["type"] == kind)
    )


def best_video(p: Column) -> Column:
    """An official trailer, else any trailer, else a teaser."""
    trailers = _youtube(p, "Trailer")
    official = F.filter(trailers, lambda v: F.lower(v["name"]).contains("official"))
    return F.coalesce(F.get(official, 0), F.get(trailers, 0), F.get(_youtube(p, "Teaser"), 0))


def video_url(video: Column) -> Column:
    return F.concat(F.lit(TRAILER_BASE), video["key"])


def providers(p: Column, countries: list[str] = PREFERRED_COUNTRIES, anywhere=True) -> Column:
    """Provider names of the first preferred country that has any, else of the
    first country that has."""
    by_country = p["watch/providers"]["results"]
    options = [
        none_if_empty(F.try_element_at(by_country, F.lit(c))["flatrate"]) for c in countries
    ]
    if anywhere:
        options.append(
            F.get(
                F.filter(
                    F.transform(F.map_values(by_country), lambda v: v["flatrate"]),
                    lambda v: F.size(v) > 0,
                ),
                0,
            )
        )
    chosen = F.coalesce(*options)
    return F.filter(
        F.transform(chosen, lambda e: e["provider_name"]), lambda n: n.isNotNull() & (n != "")
    )


def certification(p: Column, anywhere: bool = True) -> Column:
    """First certification of the US, else (batch form) of any country."""
    countries = p["release_dates"]["results"]

    def first(entries: Column) -> Column:
        dates = F.flatten(
            F.transform(
                F.filter(entries, lambda r: r["release_dates"].isNotNull()),
                lambda r: r["release_dates"],
            )
        )
        marks = F.filter(
            F.transform(dates, lambda d: d["certification"]),
            lambda c: c.isNotNull() & (c != ""),
        )
        return F.get(marks, 0)

    home = first(F.filter(countries, lambda r: r["iso_3166_1"] == "US"))
    return F.coalesce(home, first(countries)) if anywhere else home


def year_of(date_text: Column) -> Column:
    return F.substring(F.nullif(date_text, F.lit("")), 1, 4).try_cast("int")


def stubs(results: Column, first: int | None = None) -> Column:
    """Listed items in short form, all or the first few."""
    return F.transform(
        results if first is None else F.slice(results, 1, first),
        lambda m: F.struct(
            m["id"].alias("tmdb_id"),
            m["title"].alias("title"),
            year_of(m["release_date"]).alias("release_year"),
            m["vote_average"].alias("rating"),
            image_url(m["poster_path"], POSTER_BASE).alias("poster_path"),
            image_url(m["backdrop_path"], BACKDROP_BASE).alias("backdrop_path"),
        ),
    )


def fill_fields(p: Column) -> dict[str, Column]:
    """Values offered to fill gaps; empty lists count as no value."""
    trailer = F.get(_youtube(p, "Trailer"), 0)
    return {
        "poster_path": image_url(p["poster_path"], POSTER_BASE),
        "backdrop_path": image_url(p["backdrop_path"], BACKDROP_BASE),
        "trailer_url": video_url(trailer),
        "streaming_providers": none_if_empty(providers(p, ["US"], anywhere=False)),
        "collection_name": p["belongs_to_collection"]["name"],
        "certification": certification(p),
        "runtime_minutes": p["runtime"],
        "overview": p["overview"],
        "popularity": p["popularity"],
        "genres": none_if_empty(names(p["genres"])),
        "keywords": none_if_empty(keyword_names(p)),
        "production_companies": none_if_empty(names(p["production_companies"])),
    }


def detail_fields(
    p: Column, first_cast: int | None = None, first_stubs: int | None = None
) -> dict[str, Column]:
    """Full detail view of a payload; the cast and the lists of other items can
    be cut."""
    cast = p["credits"]["cast"]
    video = best_video(p)
    logo = F.get(p["images"]["logos"], 0)["file_path"]
    return {
        "status": p["status"],
        "original_language": p["original_language"],
        "production_countries": names(p["production_countries"]),
        "production_companies": names(p["production_companies"]),
        "budget": p["budget"],
        "revenue": p["revenue"],
        "homepage": p["homepage"],
        "adult": p["adult"],
        "video": p["video"],
        "release_date": p["release_date"],
        "collection": p["belongs_to_collection"]["name"],
        "cast": names(cast if first_cast is None else F.slice(cast, 1, first_cast)),
        "directors": crew_names(p, "directors"),
        "writers": crew_names(p, "writers"),
        "producer": F.get(crew_names(p, "producer"), 0),
        "composer": F.get(crew_names(p, "composer"), 0),
        "cinematographer": F.get(crew_names(p, "cinematographer"), 0),
        "trailer_url": video_url(video),
        "youtube_key": video["key"],
        "trailer_type": video["type"],
        "trailer_name": video["name"],
        "streaming_providers": providers(p),
        "similar_movies": stubs(p["similar"]["results"], first_stubs),
        "recommended_movies": stubs(p["recommendations"]["results"], first_stubs),
        "logo_url": F.concat(F.lit(POSTER_BASE), logo),
        "certification": certification(p, anywhere=False),
    }


def parameter_hash(parameters: dict[str, Column]) -> Column:
    """md5 of request parameters as JSON text, names in order. Text values are
    quoted, numbers are not."""
    parts = []
    for name in sorted(parameters):
        value = parameters[name]
        shown = F.coalesce(value.cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}": '), shown))
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def json_text(c: Column) -> Column:
    """A text value as it stands in JSON."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
