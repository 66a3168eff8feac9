"""Cleaning and conforming expressions for text, numbers, dates and lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Canonical genre names by lower-cased spelling.
GENRE_NAMES = {
    "action": "Action",
    "adventure": "Adventure",
    "animation": "Animation",
    "comedy": "Comedy",
    "crime": "Crime",
    "documentary": "Documentary",
    "drama": "Drama",
    "family": "Family",
    "fantasy": "Fantasy",
    "history": "History",
    "horror": "Horror",
    "music": "Music",
    "mystery": "Mystery",
    "romance": "Romance",
    "science fiction": "Science Fiction",
    "sci-fi": "Science Fiction",
    "scifi": "Science Fiction",
    "thriller": "Thriller",
    "war": "War",
    "western": "Western",
    "tv movie": "TV Movie",
}

# Language names and their ISO 639-1 codes.
LANGUAGE_CODES = {
    "english": "en",
    "french": "fr",
    "spanish": "es",
    "german": "de",
    "italian": "it",
    "japanese": "ja",
    "korean": "ko",
    "chinese": "zh",
    "russian": "ru",
    "portuguese": "pt",
    "hindi": "hi",
    "swedish": "sv",
    "cantonese": "cn",
    "mandarin": "zh",
}

# Text patterns the sources are read with.
JSON_NAME_PATTERN = r"""['"]{key}['"]:\s*['"]([^'"]*?)['"]"""
DIRECTOR_OBJECT_PATTERN = r"""\{[^{}]*?['"]job['"]:\s*['"]Director['"][^{}]*?\}"""
QUOTED_PATTERN = r'"([^"]*?)"'
TITLE_YEAR_PATTERN = r"\s*\((\d{4})\)\s*$"


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean_text(c: Column) -> Column:
    """Trim and collapse every run of Unicode whitespace to one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lenient(c: Column, dtype: str) -> Column:
    """Cast that yields null for anything unparsable."""
    return c.try_cast(dtype)


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd or null. The shape test keeps partial dates out."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def rescale(c: Column, source_max: float, target_max: float = 10.0) -> Column:
    return c.try_cast("double") * F.lit(target_max / source_max)


def json_values(c: Column, key: str = "name") -> Column:
    """Every string value of `key` in JSON-like text, either quote style."""
    return F.regexp_extract_all(c, F.lit(JSON_NAME_PATTERN.replace("{key}", key)), 1)


def director_names(c: Column) -> Column:
    """Names inside the objects whose job is Director."""
    objects = F.regexp_extract_all(c, F.lit(DIRECTOR_OBJECT_PATTERN), 0)
    return F.transform(
        objects,
        lambda o: F.nullif(
            F.regexp_extract(o, JSON_NAME_PATTERN.replace("{key}", "name"), 1), F.lit("")
        ),
    )


def quoted_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUOTED_PATTERN), 1)


def split_list(c: Column, sep: str) -> Column:
    return F.split(c, "\\" + sep if sep in "|.*+?" else sep)


def split_names(c: Column, separators: str = ",") -> Column:
    """Split on any of the separators, trim the parts, drop the empty ones."""
    parts = F.split(c, f"[{separators}]")
    return F.filter(F.transform(parts, lambda p: clean_text(p)), lambda p: p != "")


def title_without_year(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, TITLE_YEAR_PATTERN, ""))


def title_year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, TITLE_YEAR_PATTERN, 1), F.lit("")).try_cast("int")


def title_id(c: Column) -> Column:
    """`tt` plus the number padded to seven digits; longer ids keep all."""
    s = c.cast("string")
    return F.concat(
        F.lit("tt"), F.when(F.length(s) < 7, F.lpad(s, 7, "0")).otherwise(s)
    )


def match_key(c: Column) -> Column:
    """Lower-cased letters and digits of a title; null when none remain, so
    that titles in other scripts do not all meet on an empty key."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased Unicode words; null text gives an empty list."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+")
    return F.filter(words, lambda w: w != "")


def title_case(c: Column) -> Column:
    """Capital after every non-letter, as opposed to after blanks only."""
    marked = F.regexp_replace(F.lower(c), r"(^|[^\p{L}])(\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    return F.array_join(
        F.transform(
            parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
        ),
        "",
    )


def canonical_genres(names: Column) -> Column:
    """Canonical spelling per genre, order kept, repeats dropped."""
    table = literal_map(GENRE_NAMES)
    return F.array_distinct(
        F.transform(
            F.filter(names, lambda g: g.isNotNull()),
            lambda g: F.coalesce(
                F.try_element_at(table, F.lower(F.trim(g))), F.trim(title_case(g))
            ),
        )
    )


def genre_key(g: Column) -> Column:
    """Comparison key of one genre; the two spellings of a pair are equal."""
    k = F.lower(F.trim(g))
    return (
        F.when(k.isin("sci-fi", "science fiction"), "science fiction")
        .when(k.isin("tv movie", "tv show"), "tv movie")
        .otherwise(k)
    )


def language_code(c: Column) -> Column:
    """ISO code of a language name or code; null when unknown."""
    k = F.lower(F.trim(c))
    codes = sorted(set(LANGUAGE_CODES.values()))
    return F.coalesce(
        F.try_element_at(literal_map(LANGUAGE_CODES), k), F.when(k.isin(codes), k)
    )


def lowered(list_col: Column) -> Column:
    return F.transform(list_col, lambda x: F.lower(x))


def empty_if_null(list_col: Column) -> Column:
    return F.coalesce(list_col, F.array().cast("array<string>"))


def lowered_set(list_col: Column) -> Column:
    """Distinct lower-cased values; null counts as empty."""
    return F.array_distinct(
        F.filter(lowered(empty_if_null(list_col)), lambda x: x.isNotNull())
    )


def blank(c: Column) -> Column:
    """True for null and for whitespace only."""
    return c.isNull() | (F.length(clean_text(c)) == 0)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
