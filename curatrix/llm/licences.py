"""Licence notices in item documents: Dice coefficient over word bigrams
against licence templates, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_texts, quoted

# Least Dice coefficient, as a fraction.
LEAST = (8, 10)

# Licence notices as they are published.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "bsd-2-clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "lgpl-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
}


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_rows(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of every template with two words."""
    out = []
    for name in sorted(templates):
        for text in templates[name]:
            words = _words(text)
            grams = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
            if grams:
                out.append((name, grams))
    return out


def anchor_words(rows: list[tuple[str, list[str]]], least: tuple[int, int] = LEAST) -> list[str]:
    """Words of which every text near enough to some template holds one.

    A Dice coefficient of s over sets of a and b bigrams needs at least
    s * b / (2 - s) shared ones. So per template words are picked, longest
    first, until too few bigrams are left without one of them."""
    top, bottom = least
    picked: list[str] = []
    for _, grams in sorted(rows, key=lambda r: len(r[1])):
        need = -(-top * len(grams) // (2 * bottom - top))
        free = [g for g in grams if not any(w in g for w in picked)]
        for word in sorted({w for g in free for w in g.split()}, key=lambda w: (-len(w), w)):
            if len(free) < need:
                break
            picked.append(word)
            free = [g for g in free if word not in g]
    return sorted(w for w in picked if not any(o != w and o in w for o in picked))


def normalised(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
    )
    return F.array_distinct(F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


def find_licences(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    templates: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """(key, unit, number, licence, shared, dice): licence notices in documents.

    Units are every line, every block of several lines between blank ones, and
    the whole text where it has several blocks; number counts units of a kind
    from zero. A unit is reported once, with the licence of the template of the
    highest Dice coefficient over distinct word bigrams, at least LEAST; ties go
    to the first name. shared is the number of common bigrams, dice the
    coefficient rounded to six places.

    Nothing is shuffled. Texts and units without an anchor word are passed over,
    which loses nothing (see anchor_words); of the rest only templates within
    the size bounds that the coefficient allows are compared. Templates are a
    constant of the plan. Null and empty texts have no units; null keys stay
    null; repeated rows give repeated results; an empty table gives an empty
    one; further columns are left out."""
    rows = template_rows(TEMPLATES if templates is None else templates)
    top, bottom = LEAST
    anchors = anchor_words(rows)

    def anchored(c: Column) -> Column:
        out = F.lit(False)
        for word in anchors:
            out = out | F.contains(c, F.lit(word))
        return out

    docs = keyed_texts(items, key, text).where(anchored(F.lower("_text")))

    def numbered(kind: str, parts: Column) -> Column:
        found = F.transform(
            parts,
            lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), x.alias("raw")),
        )
        if kind == "block":
            found = F.filter(found, lambda u: F.contains(F.trim(u["raw"]), F.lit("\n")))
        return F.filter(found, lambda u: anchored(F.lower(u["raw"])))

    blocks = F.split(F.col("_text"), "\n[ \t\r]*\n")
    whole = F.when(F.size(blocks) > 1, F.array(F.col("_text"))).otherwise(
        F.array().cast("array<string>")
    )
    units = F.concat(
        numbered("line", F.split(F.col("_text"), "\n")),
        numbered("block", blocks),
        numbered("text", whole),
    )
    least = min((len(g) for _, g in rows), default=0) * top / (2 * bottom - top)
    words = F.split(normalised(F.col("u.raw")), " ")
    # Exploding one-entry arrays keeps an expression from being copied into
    # every later one that reads it.
    one = docs.select("_key", F.explode(units).alias("u")).select(
        "_key", "u.unit", "u.number", F.explode(F.array(words)).alias("words")
    )
    grammed = one.where(F.size("words") - 1 >= least).select(
        "_key", "unit", "number", F.explode(F.array(_bigrams(F.col("words")))).alias("grams")
    )
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("licence"),
                F.lit(len(grams)).alias("size"),
                F.array(*[F.lit(g) for g in grams]).alias("grams"),
            )
            for name, grams in rows
        ]
    )
    n = F.size("grams")
    # 2 * min(a, b) / (a + b) bounds the coefficient of sets of a and b bigrams.
    fits = F.filter(
        known, lambda t: F.least(t["size"], n) * (2 * bottom) >= (t["size"] + n) * top
    )
    met = F.transform(
        fits,
        lambda t: F.struct(
            F.size(F.array_intersect(t["grams"], F.col("grams"))).alias("shared"),
            (t["size"] + n).alias("sizes"),
            t["licence"].alias("licence"),
        ),
    )
    near = F.filter(
        F.col("met"), lambda m: m["shared"] * (2 * bottom) >= m["sizes"] * top
    )
    ranked = F.array_sort(
        F.transform(
            near,
            lambda m: F.struct(
                (-F.round(2.0 * m["shared"] / m["sizes"], 6)).alias("order"),
                m["licence"].alias("licence"),
                m["shared"].alias("shared"),
            ),
        )
    )
    return (
        grammed.select("_key", "unit", "number", F.explode(F.array(met)).alias("met"))
        .select("_key", "unit", "number", F.explode(F.slice(ranked, 1, 1)).alias("best"))
        .select(
            F.col("_key").alias(key),
            "unit",
            "number",
            F.col("best.licence").alias("licence"),
            F.col("best.shared").alias("shared"),
            (-F.col("best.order")).alias("dice"),
        )
    )


def duckdb_sql(
    table: str, key: str, text: str, templates: dict[str, tuple[str, ...]] | None = None
) -> str:
    """The same result in DuckDB SQL, without anchors and size bounds."""
    rows = template_rows(TEMPLATES if templates is None else templates)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(
        f"({quote(n)}, [{', '.join(map(quote, g))}])" for n, g in rows
    )
    top, bottom = LEAST
    return f"""
with known(licence, known_grams) as (values {values}),
docs as (select {key} as k, coalesce({text}, '') as t from {table}),
lines as (
  select k, unnest(string_split(t, chr(10))) as raw,
    generate_subscripts(string_split(t, chr(10)), 1) - 1 as number from docs),
cut as (
  select k, t, regexp_split_to_array(t, '\\n[ \\t\\r]*\\n') as parts from docs),
parts as (
  select k, unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as number from cut),
units as (
  select k, 'line' as unit, number, raw from lines
  union all select k, 'block', number, raw from parts where contains(trim(raw, ' '), chr(10))
  union all select k, 'text', 0, t from cut where len(parts) > 1),
worded as (
  select k, unit, number,
    string_split(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') as w
  from units),
grammed as (
  select k, unit, number,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as grams
  from worded where len(w) > 1),
met as (
  select k, unit, number, licence, len(list_intersect(grams, known_grams)) as shared,
    len(grams) + len(known_grams) as sizes
  from grammed, known
  where least(len(grams), len(known_grams)) * {2 * bottom} >= (len(grams) + len(known_grams)) * {top}),
near as (
  select *, round(2.0 * shared / sizes, 6) as dice,
    row_number() over (partition by k, unit, number order by round(2.0 * shared / sizes, 6) desc, licence, shared) as place
  from met where shared * {2 * bottom} >= sizes * {top})
select k as {key}, unit, cast(number as int) as number, licence, cast(shared as int) as shared,
  cast(dice as double) as dice
from near where place = 1
"""
