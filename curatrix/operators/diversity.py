"""Greedy diversity re-rank of short lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Penalties, list sizes and the words ignored in titles.
SAME_COLLECTION, SIMILAR_TITLE, SHARED_CAST = 0.35, 0.25, 0.20
SHARED_DIRECTOR, SAME_PERIOD, PERIOD_YEARS = 0.15, 0.05, 3
SLOTS, LOOKAHEAD = 10, 15
DIGITS = 10
IGNORED_WORDS = {
    "the", "a", "of", "and", "in", "to", "for", "with", "part", "movie", "film",
}


def _words(title) -> set[str]:
    return set((title or "").lower().split())


def _names(values) -> set[str]:
    return set() if values is None else set(values)


def overlap_penalty(a: dict, b: dict) -> float:
    """What candidate `a` loses for the already chosen `b`."""
    lost = 0.0
    if a["collection"] and b["collection"] and a["collection"] == b["collection"]:
        lost += SAME_COLLECTION
    shared = (a["words"] & b["words"]) - IGNORED_WORDS
    if len(shared) >= 2 or (shared and any(w.isdigit() for w in a["words"])):
        lost += SIMILAR_TITLE
    if len(a["cast"] & b["cast"]) >= 2:
        lost += SHARED_CAST
    if a["directors"] & b["directors"]:
        lost += SHARED_DIRECTOR
    if a["year"] and b["year"] and abs(a["year"] - b["year"]) <= PERIOD_YEARS:
        lost += SAME_PERIOD
    return lost


def _reorder(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["score_rank"]).reset_index(drop=True)
    facts = [
        {
            "collection": (r.collection_name or "").lower(),
            "words": _words(r.title),
            "cast": _names(r.cast),
            "directors": _names(r.directors),
            "year": None if pd.isna(r.release_year) else int(r.release_year),
        }
        for r in pdf.itertuples()
    ]
    score, lost = pdf["score"].tolist(), [0.0] * len(pdf)
    left, order = list(range(len(pdf))), []
    while left and len(order) < SLOTS:
        window = left[:LOOKAHEAD] if order else left[:1]
        # Rounded, so that equal values stay equal; of these the first wins.
        pick = max(window, key=lambda i: round(score[i] - lost[i], DIGITS))
        order.append(pick)
        left.remove(pick)
        for i in left:
            lost[i] += overlap_penalty(facts[i], facts[pick])
    out = pdf.iloc[order + left]
    return pd.DataFrame(
        {
            "query_id": out["query_id"].to_numpy(),
            "item_id": out["item_id"].to_numpy(),
            "position": range(1, len(out) + 1),
        }
    )


def diversify(ranked: DataFrame) -> DataFrame:
    """(query_id, item_id, position) after the greedy pass. Input holds the
    short list of each query (`score`, `score_rank`), 15 rows in the funnel;
    queries run in parallel."""
    kept = ranked.select(
        "query_id", "item_id", "title", "collection_name", "cast", "directors",
        "release_year", "score", "score_rank",
    )
    return kept.groupBy("query_id").applyInPandas(
        _reorder, "query_id long, item_id long, position int"
    )
