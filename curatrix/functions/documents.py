"""Text documents built from item and query columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _listed(label: str, values: Column, first: int | None = None) -> Column:
    shown = values if first is None else F.slice(values, 1, first)
    return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(shown, ", ")))


def _single(label: str, value: Column, keep: Column | None = None) -> Column:
    keep = value.isNotNull() if keep is None else keep
    return F.when(keep, F.concat(F.lit(label), value))


def item_document(c=F.col, first_cast: int | None = None) -> Column:
    """Multi-line description of an item. Lines without data are left out; a
    null title makes the whole document null. The longer of the two
    descriptions is used, the overview on a tie. first_cast cuts the cast."""
    longer_plot = F.length(F.coalesce(c("plot_summary"), F.lit(""))) > F.length(
        F.coalesce(c("overview"), F.lit(""))
    )
    story = F.when(longer_plot, c("plot_summary")).otherwise(c("overview"))
    rating = F.round(c("rating_value").cast("double"), 1).cast("string")
    head = F.concat(
        F.lit("Title: "),
        c("title"),
        F.coalesce(
            F.concat(F.lit(" ("), c("release_year").cast("string"), F.lit(")")), F.lit("")
        ),
    )
    lines = [
        _listed("Genres: ", c("genres")),
        _listed("Directed by: ", c("directors")),
        _listed("Written by: ", c("writers")),
        _listed("Starring: ", c("cast"), first=first_cast),
        _single("Franchise / Collection: ", c("collection_name")),
        _listed("Production Companies: ", c("production_companies")),
        _listed("Languages: ", c("languages")),
        F.concat(F.lit("Rating: "), rating, F.lit("/10")),
        _single("Certification: ", c("certification")),
        _listed("Streaming Providers: ", c("streaming_providers")),
        _listed("Keywords / Themes: ", c("keywords")),
        _single("Tagline: ", c("tagline"), keep=~blank(c("tagline"))),
        _single("Description: ", _strip(story), keep=~blank(story)),
    ]
    # concat_ws skips nulls, concat keeps the null of a missing title.
    tail = F.concat_ws("\n", *lines)
    return F.concat(head, F.when(tail == "", F.lit("")).otherwise(F.concat(F.lit("\n"), tail)))


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def embedding_document(
    title, tagline, overview, genres, keywords, cast, directors, first_cast: int | None = None
) -> Column:
    """One-line document for the encoder; absent parts are skipped. first_cast
    cuts the cast."""
    return F.concat_ws(
        ". ",
        _single("Title: ", title, _given(title)),
        _single("Tagline: ", tagline, _given(tagline)),
        _single("Overview: ", overview, _given(overview)),
        _listed("Genres: ", genres),
        _listed("Keywords: ", keywords),
        _listed("Cast: ", cast, first=first_cast),
        _listed("Directed by: ", directors),
    )


def search_text(c=F.col, first_cast: int | None = None) -> Column:
    """Eight fields joined by single blanks, absent ones as empty text.
    first_cast cuts the cast."""
    cast = c("cast") if first_cast is None else F.slice(c("cast"), 1, first_cast)
    text = [
        c("title"),
        c("overview"),
        c("tagline"),
        F.array_join(c("genres"), " "),
        F.array_join(c("keywords"), " "),
        F.array_join(c("directors"), " "),
        F.array_join(cast, " "),
        c("plot_summary"),
    ]
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in text])


def query_document(text: Column, intent: Column) -> Column:
    """Text handed to the encoder for a query."""
    def part(label, field):
        return F.concat(F.lit(f". {label}: "), F.array_join(intent[field], ", "))

    return F.concat(
        text,
        part("Genres", "genres"),
        part("Themes", "themes"),
        part("Moods", "moods"),
        part("Keywords", "keywords"),
        F.lit("."),
    )


def query_search_text(text: Column, intent: Column) -> Column:
    """Text whose words are matched against the item texts."""
    fields = [
        "genres",
        "moods",
        "themes",
        "keywords",
        "similar_movies",
        "preferred_actors",
        "preferred_directors",
    ]
    return F.concat_ws(" ", text, *[F.array_join(intent[f], " ") for f in fields])


def understanding_document(u) -> Column:
    """Seven labelled parts of an understanding record joined by ` | `."""
    return F.concat_ws(
        " | ",
        _single("Intent: ", u["search_intent"], _given(u["search_intent"])),
        _single("Mood: ", u["mood"], _given(u["mood"])),
        _listed("Genres: ", u["genres"]),
        _listed("Starring: ", u["actors"]),
        _listed("Directed by: ", u["directors"]),
        _listed("Like: ", u["reference_movies"]),
        _single("Preferences: ", u["user_preferences"], _given(u["user_preferences"])),
    )


