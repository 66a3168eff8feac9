"""The index of query predicates and block scores against pair-by-pair forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.operators import block_scores, filters as L, predicate_index as P
from curatrix.operators.fusion import fuse
from curatrix.operators.grouping import top_k
from curatrix.plans import search as H
from curatrix.schema import INTENT_SCHEMA, conform_items, make_intent

GENRES = ["Drama", "comedy", "Horror", "Documentary", "Sci-Fi", None]
PEOPLE = ["Ann Lee", "bo Ray", "Cy Dent", None]
TITLES = ["The Road", "Night Bus", "A Season 2", "the road", None, ""]


def some(rng, values, most=3):
    if rng.random() < 0.1:
        return None
    return rng.choices(values, k=rng.randrange(0, most))


def random_items(spark, n, seed):
    rng = random.Random(seed)
    rows = [
        (
            i, rng.choice(TITLES), rng.choice(TITLES), some(rng, GENRES), some(rng, PEOPLE),
            some(rng, PEOPLE), some(rng, ["en", "fr", "ko"]), some(rng, ["heist", "Space", "gore"]),
            rng.choice([None, 1990, 2000, 2010]), rng.choice([None, 80, 100, 120]),
            rng.choice([None, 0, 40, 60, 200]), rng.choice([None, 5.0, 7.0]), rng.choice([None, 1.0, 2.0]),
            rng.choice(["a night on the road", "space heist with ann", None]),
        )
        for i in range(n)
    ]
    kind = (
        "item_id long, title string, original_title string, genres array<string>, cast array<string>, "
        "directors array<string>, languages array<string>, keywords array<string>, release_year int, "
        "runtime_minutes int, vote_count long, rating_value float, popularity float, overview string"
    )
    made = spark.createDataFrame(rows, kind)
    return conform_items(made.drop("item_id")).limit(0).select(
        F.lit(None).cast("long").alias("item_id"), "*"
    ).unionByName(made, allowMissingColumns=True)


def random_queries(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([None, 1985, 1995, 2005])
        rows.append((
            i, rng.choice(["road", "a space heist", "Ann Lee night", ""]), some(rng, GENRES[:5] + ["drama"]) or [],
            some(rng, GENRES) or [], rng.choice([[], [], ["the road"], ["x", None]]),
            rng.choice([[], [], [" ANN LEE "], ["horror", ""], [None, "night bus"]]),
            rng.choice([None, None, "french", "ko", "unheard of"]),
            None if rng.random() < 0.5 else (start, rng.choice([None, 2005])),
            rng.choice([None, None, None, 2000]), rng.choice([None, None, 100]),
            some(rng, ["Ann Lee", "cy dent"]) or [], some(rng, ["bo Ray"]) or [],
            some(rng, ["space", "heist", "heist"]) or [], rng.choice(["best", "mood", "default"]),
            rng.random() < 0.1,
        ))
    kind = (
        "query_id long, text string, genres array<string>, avoid_genres array<string>, "
        "avoid_movies array<string>, exclusions array<string>, language string, "
        "year_range struct<start:int,end:int>, release_year int, runtime int, "
        "preferred_actors array<string>, preferred_directors array<string>, keywords array<string>, "
        "ranking_mode string, legacy_soft_genre boolean"
    )
    df = spark.createDataFrame(rows, kind)
    names = [c for c in df.columns if c not in ("query_id", "text")]
    return df.select("query_id", "text", make_intent(**{n: F.col(n) for n in names}).alias("intent"))


def pairs_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "item_id").collect())


def met_by_expression(items, queries):
    """Every pair tested by the filter expression."""
    both = items.crossJoin(queries.select("query_id", "intent"))
    return both.where(L.passes_filters(F.col("intent")))


def test_index_equals_the_filter_expression(spark, monkeypatch):
    items, queries = random_items(spark, 150, 1), random_queries(spark, 60, 2)
    want = pairs_of(met_by_expression(items, queries))
    assert len(want) > 100
    assert pairs_of(L.matching_pairs(items, queries)) == want
    monkeypatch.setattr(P, "QUERY_BLOCK", 7)
    monkeypatch.setattr(P, "ITEM_PART", 11)
    assert pairs_of(L.survivors(items, queries)) == want


def test_no_key_is_shared_by_all(spark):
    items, queries = random_items(spark, 20, 1), random_queries(spark, 10, 2)
    plan = L.matching_pairs(items, queries)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    for word in ("CartesianProduct", "NestedLoop", "BroadcastHashJoin", "SortMergeJoin"):
        assert word not in plan


def test_clauses_on_bounds_and_sets():
    clause = lambda field, kind, values=None, low=None, high=None: {
        "field": field, "kind": kind, "values": values, "low": low, "high": high,
    }
    index = P.PredicateIndex([
        [clause("year", P.BOUND, low=1990.0, high=2000.0)],
        [clause("year", P.BOUND, low=1990.0), clause("genre", P.ANY, ["a", "b"])],
        [clause("genre", P.NONE, ["a"])],
        [],
        None,
        [clause("year", P.BOUND, high=1990.0)],
        [clause("genre", P.NONE, ["z", None])],
    ])
    met = lambda genre, year: [
        i for i in range(7) if index.satisfied({"genre": genre}, {"year": year}) >> i & 1
    ]
    assert met(["a"], 1990.0) == [0, 1, 3, 5]
    assert met(["b"], 1989.0) == [2, 3, 5]
    assert met(["b"], 2001.0) == [1, 2, 3]
    assert met(["c", None], 1995.0) == [0, 3]
    assert met(None, None) == [3]
    assert met([], float("nan")) == [2, 3, 6]


def test_mask_of_columns_equals_rows_one_by_one():
    rng = random.Random(11)
    values = ["a", "b", "c", "d", None]
    lists = lambda n: [rng.choice(values) for _ in range(rng.randint(0, n))]

    def clause():
        kind = rng.choice([P.ANY, P.NONE, P.BOUND])
        out = {"field": rng.choice("xy"), "kind": kind, "values": lists(2), "low": None, "high": None}
        if kind == P.BOUND:
            side = rng.choice(["low", "high"])
            out |= {"field": "year", "values": None, side: float(rng.randint(0, 9))}
        return out

    index = P.PredicateIndex(
        [None if rng.random() < 0.1 else [clause() for _ in range(rng.randint(0, 3))] for _ in range(75)]
    )
    rows = [
        {"x": rng.choice([None, lists(4)]), "y": lists(3), "year": rng.choice([None, rng.randint(0, 9)])}
        for _ in range(200)
    ]
    words, number = pa.list_(pa.string()), pa.int32()
    table = pa.Table.from_pylist(rows, pa.schema([("x", words), ("y", words), ("year", number)]))
    # Sliced and in two chunks, as columns may come.
    table = pa.concat_tables([table.slice(3, 90), table.slice(93)])
    mask = index.mask(table)
    for row, met in zip(rows[3:], mask, strict=True):
        want = index.satisfied({"x": row["x"], "y": row["y"]}, {"year": row["year"]})
        assert [want >> i & 1 for i in range(75)] == met.tolist()


def test_relaxation_in_one_pass(spark):
    items, queries = random_items(spark, 150, 3), random_queries(spark, 40, 4)
    got = {r.query_id: r for r in L.relax(items, queries, min_results=4).collect()}
    none = F.array().cast("array<string>")
    forms = {0: queries}
    forms[2] = queries.withColumn("intent", F.col("intent").withField("genres", none))
    free = F.col("intent").withField("year_range", F.lit(None).cast(INTENT_SCHEMA["year_range"].dataType))
    forms[3] = forms[2].withColumn("intent", free.withField("runtime", F.lit(None).cast("int")))
    counts = {
        n: {r.query_id: r["count"] for r in met_by_expression(items, f).groupBy("query_id").count().collect()}
        for n, f in forms.items()
    }
    levels = set()
    for q in queries.collect():
        i = q.intent
        can = bool(i.preferred_actors or i.preferred_directors or i.genres or i.year_range or i.runtime)
        want = 0 if counts[0].get(q.query_id, 0) >= 4 or not can else 2 if counts[2].get(q.query_id, 0) >= 4 else 3
        assert got[q.query_id].relax_level == want
        assert (got[q.query_id].intent.genres == []) == (want > 0 or i.genres == [])
        levels.add(want)
    assert levels == {0, 2, 3} and len(got) == 40


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_first_k_equal_those_of_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(P, "QUERY_BLOCK", 9)
    monkeypatch.setattr(P, "ITEM_PART", 40)
    items, queries = random_items(spark, 150, 5), random_queries(spark, 25, 6)
    rng = np.random.default_rng(7)
    # Few distinct vectors, so that many scores are equal.
    kinds = rng.normal(size=(4, 6))
    vectors = spark.createDataFrame(
        [(i, kinds[i % 4].tolist()) for i in range(140)], "item_id long, vector array<double>"
    )
    asked = spark.createDataFrame(
        [(i, kinds[i % 4].tolist()) for i in range(0, 25, 2)], "query_id long, vector array<double>"
    )
    scores = H.hybrid_scores(items, queries, vectors, asked)
    fused = fuse(scores.pairs())
    want = top_k(fused, ["query_id"], [F.desc("fusion"), F.asc("item_id")], k)
    columns = ["query_id", "rank", "item_id", "fusion", "semantic", "bm25", "metadata"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    got = rows(scores.top(k))
    assert got == rows(want) and len(got) > 10
    with_vector = items.join(vectors.select("item_id"), "item_id")
    assert pairs_of(scores.pairs()) == pairs_of(met_by_expression(with_vector, queries))


def test_rows_near_the_edge_are_bounded():
    ids = np.arange(1000)
    fused = np.full(1000, 0.5)
    fused[:3] = 0.9
    equal = np.zeros((3, 1000))
    assert sorted(block_scores._pick(fused, ids, equal, 10).tolist()) == list(range(13))
    # Different scores that fuse to nearly the same value all stay.
    assert len(block_scores._pick(fused, ids, np.stack([fused, ids, ids]), 10)) == 1000


def test_empty_sides(spark):
    items, queries = random_items(spark, 10, 1), random_queries(spark, 5, 2)
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "item_id long, vector array<double>")
    asked = vectors.withColumnRenamed("item_id", "query_id")
    assert L.matching_pairs(items.limit(0), queries).count() == 0
    assert L.matching_pairs(items, queries.limit(0)).count() == 0
    assert H.retrieve(items, queries.limit(0), vectors, asked).count() == 0
    assert H.retrieve(items, queries, vectors.limit(0), asked).count() == 0
    without = H.retrieve(items, queries, vectors, asked.limit(0), relaxing=False)
    assert {r.semantic for r in without.collect()} <= {0.0}
