"""Numeric scoring expressions; everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Award terms looked for in item texts.
AWARD_TERMS = [
    "oscar",
    "academy award",
    "bafta",
    "cannes",
    "golden globe",
    "venice",
    "sundance",
]


def number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def shrunk_rating(rating: Column, votes: Column, prior_votes: float, prior: float) -> Column:
    """Rating pulled towards a prior by a pseudo vote count, on a 0-1 scale."""
    r, v = number(rating), number(votes)
    return (v * r + F.lit(prior_votes * prior)) / (v + F.lit(prior_votes)) / F.lit(10.0)


def bayesian_rating(rating: Column, votes: Column, prior_votes: float = 1000.0) -> Column:
    return shrunk_rating(rating, votes, prior_votes, 6.5)


def plain_rating(rating: Column, votes: Column) -> Column:
    return shrunk_rating(rating, votes, 500.0, 5.5)


def quality_rating(rating: Column, votes: Column) -> Column:
    reach = F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1.0), number(votes))) / 7.0)
    return 0.85 * shrunk_rating(rating, votes, 25000.0, 6.8) + 0.15 * reach


def log_scale(c: Column, full: float) -> Column:
    """ln(1+x)/full, capped at one."""
    return F.least(F.lit(1.0), F.log1p(number(c)) / F.lit(full))


def ramp(value: Column, start: float, width: float) -> Column:
    """Linear rise from start over width, clipped to [0, 1]; null gives 0."""
    return F.coalesce(clip01((value.cast("double") - start) / width), F.lit(0.0))


def recency(year: Column) -> Column:
    return ramp(year, 1980, 46)


def classic(year: Column) -> Column:
    return F.coalesce(clip01((1995 - year.cast("double")) / 50.0), F.lit(0.0))


def _text_of(parts: list[Column]) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def award_flag(title, tagline, overview, keywords) -> Column:
    """1 when any award term occurs."""
    text = _text_of([title, tagline, overview, F.array_join(keywords, " ")])
    return text.rlike("|".join(AWARD_TERMS)).cast("double")


def award_grade(title, tagline, overview, plot, keywords) -> Column:
    """0.33 per distinct award term found, at most 1."""
    text = _text_of([overview, plot, tagline, title, F.array_join(keywords, " ")])
    hits = sum((text.contains(t).cast("int") for t in AWARD_TERMS), F.lit(0))
    return F.least(F.lit(1.0), hits * F.lit(0.33))


def overlap_size(have: Column, want: Column) -> Column:
    """Number of distinct wanted values present; both sides lower-cased sets."""
    return F.size(F.array_intersect(have, want))


def overlap_share(have: Column, want: Column, if_none: float) -> Column:
    """overlap_size over the number wanted; if_none when nothing is wanted."""
    return F.when(F.size(want) == 0, F.lit(if_none)).otherwise(
        overlap_size(have, want) / F.size(want)
    )


def match_share(values: Column, wanted: Column) -> Column:
    """Matching list entries over the number of preferences; repeats count.
    A null list and an absent preference both give 0."""
    hits = F.size(F.filter(values, lambda x: F.array_contains(wanted, F.lower(x))))
    return F.when(
        (F.size(wanted) > 0) & values.isNotNull(), hits / F.size(wanted)
    ).otherwise(F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    """Unit-length double vector; a zero vector is divided by 1e-12."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of unit vectors clipped to [-1, 1]."""
    products = F.zip_with(
        a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y
    )
    s = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    # least and greatest skip nulls, so a missing vector is kept null here.
    return F.when(s.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))


def minmax(value: Column, low: Column, high: Column, n: Column) -> Column:
    """Min-max scale from given bounds: a single row is 1, a flat list 0."""
    return (
        F.when(n == 1, F.lit(1.0))
        .when(high > low, (value - low) / (high - low))
        .otherwise(F.lit(0.0))
    )
