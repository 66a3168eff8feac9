import difflib
import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import bm25 as B, filters as L, lookups as K, vectors as V
from curatrix.operators.diversity import diversify
from curatrix.operators.evaluation import confidence, judge_results
from curatrix.operators.grouping import keep_one, merged_lists, narrow_two_lists, sole_owner
from curatrix.operators.quality import quality_metrics, rating_histogram, value_frequency
from curatrix.operators.ranking import similar_rerank
from curatrix.plans.search import retrieve
from curatrix.schema import conform_items, make_intent
from curatrix.session import lookup_join, settle


def lits(*values):
    return F.array(*[F.lit(v) for v in values])


def test_keep_one_hot_key(spark):
    rows = [(1, i % 7, i) for i in range(5000)] + [(k, 0, k) for k in range(2, 50)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = {r.k: (r.a, r.b) for r in keep_one(df, ["k"], ["a", F.desc("b")][:1]).collect()}
    assert len(got) == 49 and got[1][0] == 0


def test_sole_owner_and_lists(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 2)], "o string, k int")
    got = {r.o: r.k for r in sole_owner(df, "o", "k").collect()}
    assert got == {"a": 1, "b": None, "c": None, "d": 2}
    lists = spark.createDataFrame(
        [(1, ["b", None, "a"]), (1, ["a"]), (1, None)], "id int, l array<string>"
    )
    assert merged_lists(lists, "id", ["l"]).first().l == ["a", "b"]


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.createDataFrame([(i, 0 if i % 3 else i % 11) for i in range(500)], "id int, k int")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(9)], "k int, n string")
    for how in ("inner", "left"):
        a = lookup_join(big, small, ["k"], "id", how, max_rows=100)
        b = lookup_join(big, small, ["k"], "id", how, max_rows=2)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def brute_bm25(docs, query):
    toks = {i: t.lower().split() for i, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, t in toks.items():
        s = sum(
            idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
            for w in query.lower().split() if w in idf
        )
        if any(w in t for w in query.lower().split()):
            out[i] = s
    return out


def test_bm25_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(["the", *rnd.choices(words, k=rnd.randint(0, 25))])) for i in range(60)]
    docs.append((60, ""))
    asked = [(1, "the w1 w1 w2"), (2, "w5 zzz w29")]
    d = spark.createDataFrame(docs, "id int, text string")
    q = spark.createDataFrame(asked, "query_id int, text string")
    for bound in (1000, 0):
        got = B.bm25_scores(d, q, "id", "text", "text", max_broadcast=bound).collect()
        found = {(r.query_id, r.id): r.bm25 for r in got}
        want = {(k, i): s for k, t in asked for i, s in brute_bm25(docs, t).items()}
        assert found.keys() == want.keys()
        assert all(abs(found[x] - want[x]) < 1e-9 for x in want)


def test_bm25_first_k_leaves_no_row_per_pair(spark, monkeypatch):
    monkeypatch.setattr(B, "CELL_WORDS", 150)
    monkeypatch.setattr(B, "TASKS", 6)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(["the", *rnd.choices(words, k=rnd.randint(0, 25))])) for i in range(60)]
    # Equal scores, a repeated id and one that is null.
    docs += [(60 + i, "the w3 w4") for i in range(30)] + [(7, "the w3"), (None, "w5 the w1")]
    asked = [(1, "the w1 w1 w2"), (2, "w5 zzz w3"), (None, "w4"), (3, "zzz"), (4, "the")]
    d = spark.createDataFrame(docs, "id int, text string")
    q = spark.createDataFrame(asked, "query_id int, text string")
    every = B.bm25_scores(d, q, "id", "text", "text").collect()
    first = B.bm25_scores(d, q, "id", "text", "text", max_broadcast=0, k=4).collect()
    assert len(first) < len(every) / 2

    def best(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (-round(r.bm25, 9), r.id is not None, r.id or 0)):
            out.setdefault(r.query_id, []).append((r.id, round(r.bm25, 8)))
        return {x: held[:4] for x, held in out.items()}

    assert best(first) == best(every) and set(best(first)) == {1, 2, None, 4}


def test_nearest_block_form_equals_broadcast_form(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)))]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>")
    q = v.withColumnRenamed("item_id", "query_id")
    a = V.nearest(q, v, 4, skip_self=True).collect()
    monkeypatch.setattr(V, "QUERY_BLOCK", 30)
    monkeypatch.setattr(V, "ITEM_BLOCK", 50)
    b = V.nearest(q, v, 4, skip_self=True).collect()
    key = lambda r: (r.query_id, r["rank"], r.item_id, round(r.cosine, 9))
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == 480
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    best = {(i, int(cos[i].argmax())) for i in range(120)}
    assert {(r.query_id, r.item_id) for r in a if r["rank"] == 1} == best


def test_fuzzy_titles_against_brute_force(spark):
    rnd = random.Random(11)
    base = ["The Godfather", "Blade Runner 2049", "Amelie", "Up", "It", "Toy Story", "Alien",
            "The Good, the Bad and the Ugly", "Se7en", "A Clockwork Orange", "Heat"]
    asked = []
    for t in base:
        for _ in range(6):
            s = list(t)
            for _ in range(rnd.randint(0, max(1, len(s) // 7))):
                at = rnd.randrange(len(s))
                if rnd.random() < 0.5:
                    s.insert(at, rnd.choice("abcdefgh"))
                elif len(s) > 2:
                    s.pop(at)
            asked.append("".join(s).strip())
    titles = spark.createDataFrame([(t,) for t in base], "title string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {r.query_id: r.title for r in K.fuzzy_titles(titles, q).collect()}
    want = {}
    for i, text in enumerate(asked):
        close = difflib.get_close_matches(text, base, n=1, cutoff=0.88)
        if close:
            want[i] = close[0]
    assert got == want and len(want) > 30


def test_contains_is_literal_and_complete(spark):
    titles = [(1, "Se7en"), (2, "What? (1999)"), (3, "a"), (4, "Up and Away"), (5, None)]
    items = spark.createDataFrame(titles, "item_id int, title string")
    needles = [(1, "e7e"), (2, "? ("), (3, "a"), (4, "up and away"), (5, "away!")]
    q = spark.createDataFrame(needles, "query_id int, needle string")
    got = {(r.query_id, r.item_id) for r in K.contains_matches(items, q, "title").collect()}
    want = {(n, i) for n, s in needles for i, t in titles if t and s in t.lower()}
    assert got == want


def hard_items(spark):
    rows = [
        (1, "The Matrix", 1999, ["Action", "Science Fiction"], 136),
        (2, "The Dark Knight Rises", 2012, ["Action", "Crime"], 164),
        (3, "Scream", 1996, ["Horror"], 111),
        (4, "Toy Story", 1995, ["Animation"], 81),
        (5, "Planet Earth: Season 1", 2006, ["Action"], 50),
        (6, "No Genre", 2001, None, 90),
        (7, "A Doc", 2001, ["Documentary"], 90),
    ]
    return spark.createDataFrame(
        rows, "item_id int, title string, release_year int, genres array<string>, "
        "runtime_minutes int"
    ).withColumns({"original_title": F.col("title"), "cast": lits("x"), "directors": lits("y"),
                   "languages": lits("en"), "keywords": lits("k")})


def test_hard_filter_and_ladder(spark):
    items = hard_items(spark)
    q = spark.range(1).select(
        F.lit(1).alias("query_id"), F.lit("t").alias("text"),
        make_intent(
            avoid_genres=lits("Horror"),
            year_range=F.struct(F.lit(1996).alias("start"), F.lit(None).cast("int").alias("end")),
        ).alias("intent"),
    )
    got = {r.title for r in L.survivors(items, q).collect()}
    assert got == {"The Matrix", "The Dark Knight Rises"}
    tight = q.withColumn("intent", make_intent(genres=lits("Western"), runtime=F.lit(10)))
    done = L.relax(items, tight, min_results=1).first()
    assert done.relax_level == 3 and done.intent.genres == [] and done.intent.runtime is None


def test_relaxed_queries_are_scored_as_asked(spark):
    """The filter drops a genre that nothing has; the scores still ask for it."""
    items = hard_items(spark).withColumns(
        {n: F.lit(None).cast("string") for n in ("overview", "tagline", "plot_summary")}
    )
    q = spark.range(1).select(
        F.lit(1).alias("query_id"), F.lit("matrix").alias("text"),
        make_intent(genres=lits("Western")).alias("intent"),
    )
    vectors = items.select("item_id", F.array(F.lit(1.0), F.col("item_id") * 1.0).alias("vector"))
    asked = q.select("query_id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    found = retrieve(items, q, vectors, asked).collect()
    assert {r.item_id for r in found} == {1, 2, 3, 4}
    # With the loosened intent nothing would be asked for and all would score 1.
    assert {r.metadata for r in found} == {0.0}
    strict = retrieve(items, q, vectors, asked, relaxing=False)
    assert strict.count() == 0


def test_nearest_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(90)]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>")
    asked = v.withColumnRenamed("item_id", "query_id")
    unit = np.array([r[1] for r in rows])
    unit = unit / np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-12)
    want = {}
    for i in range(90):
        order = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(90) if j != i)
        want[i] = [round(-s, 9) for s, _ in order[:7]]
    for blocks in ({}, {"query_block": 20, "item_block": 25}):
        got = {}
        for r in V.nearest(asked, v, 7, True, **blocks).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(round(r.cosine, 9))
        assert got == want


def test_nearest_in_blocks_sends_an_item_once_per_large_block(spark, monkeypatch):
    """Small blocks asked for do not multiply what is shuffled, and repeated
    or null ids are treated as without blocks."""
    rng = np.random.default_rng(5)
    rows = [(None if i == 7 else i // 2, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)]
    v = spark.createDataFrame(rows, "item_id long, vector array<double>")
    asked = v.withColumnRenamed("item_id", "query_id")
    blocked = V.nearest(asked, v, 5, True, query_block=4, item_block=3)
    text = spark._jvm.PythonSQLUtils.explainString(blocked._jdf.queryExecution(), "formatted")
    assert "FlatMapCoGroups" not in text

    def key(df):
        shown = df.select("query_id", "rank", "item_id", F.round("cosine", 9).alias("c"))
        return sorted(shown.collect(), key=str)

    # Tie order among equal ids is free, so the scores are compared by rank.
    plain = key(V.nearest(asked, v, 5, True))
    assert [(r.query_id, r["rank"], r.c) for r in key(blocked)] == [(r.query_id, r["rank"], r.c) for r in plain]
    monkeypatch.setattr(V, "LEAST_ROWS", 16)
    monkeypatch.setattr(V, "PRODUCT_QUERIES", 5)
    monkeypatch.setattr(V, "PRODUCT_ROWS", 11)
    many = key(V.nearest(asked, v, 5, True, query_block=16, item_block=30))
    assert [(r.query_id, r["rank"], r.c) for r in many] == [(r.query_id, r["rank"], r.c) for r in plain]


def test_narrowing_keeps_fifteen_different(spark):
    rows = [(1, i, float(i), float((i * 37) % 50)) for i in range(50)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, semantic double, bm25_norm double")
    got = narrow_two_lists(df).collect()
    head = sorted(rows, key=lambda r: -r[2])[:10]
    rest = sorted([r for r in rows if r not in head], key=lambda r: (-r[3], r[1]))[:5]
    assert {r.item_id for r in got} == {r[1] for r in head + rest} and len(got) == 15


def test_diversity_demotes_sequel(spark):
    rows = [
        (1, 1, "Space Saga 1", "Saga", ["a", "b"], ["d"], 2001, 0.95, 1),
        (1, 2, "Space Saga 2", "Saga", ["a", "b"], ["d"], 2003, 0.94, 2),
        (1, 3, "Other", None, ["z"], ["q"], 1980, 0.85, 3),
        (2, 9, "Alone", None, None, None, None, 0.5, 1),
    ]
    df = spark.createDataFrame(
        rows, "query_id long, item_id long, title string, collection_name string, "
        "cast array<string>, directors array<string>, release_year int, score double, "
        "score_rank int",
    )
    got = {(r.query_id, r.position): r.item_id for r in diversify(df).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 2, (2, 1): 9}


def test_similar_rerank(spark):
    df = spark.sql(
        """select 1L as query_id, 2L as item_id, 0.8D as semantic, array('Drama', 'War') as genres,
        array('P') as cast, array('D') as directors, cast(null as double) as rating_value,
        0.0D as popularity, 0L as vote_count, 'S' as source_title, array('drama') as source_genres,
        array('p') as source_cast, cast(null as array<string>) as source_directors"""
    )
    r = similar_rerank(df).first()
    assert abs(r.boosted - 0.88) < 1e-9 and abs(r.score - (0.6 * 0.88 + 0.2 * 0.5)) < 1e-9
    assert r.reason == "Recommended because it shares genres (Drama), and cast (P) with S."


def test_confidence_and_judging(spark):
    res = spark.createDataFrame(
        [(1, 1, 0.85, "A", "x", ["g"]), (1, 2, 0.82, "B", "y", ["g"])],
        "query_id int, position int, semantic double, title string, overview string, "
        "genres array<string>",
    )
    q = spark.createDataFrame([(1, "best crime movie"), (2, "x")], "query_id int, text string")
    got = {r.query_id: r.confidence for r in confidence(res, q, 2).collect()}
    assert got == {1: 0.895, 2: 0.0}
    lists = spark.createDataFrame(
        [(1, 1, "Goodfellas", ["Crime"]), (1, 2, "Cats", ["Music"]), (1, 3, "Scarface", ["Crime"])],
        "query_id int, position int, title string, genres array<string>",
    ).withColumns({"cast": lits("c"), "directors": lits("d")})
    asked = q.where("query_id = 1").withColumn("intent", make_intent(genres=lits("Crime")))
    rows = judge_results(asked, lists, lists.where("position < 3")).collect()
    got = {(r.verdict, r.title) for r in rows}
    assert got == {("expected", "Goodfellas"), ("missing", "Scarface"), ("irrelevant", "Cats")}


def test_quality_metrics(spark):
    rows = [
        ("tt0000001", 1, "A", 1990, 7.1, ["Drama"]),
        ("tt0000001", 2, "A", 1990, 7.9, ["Drama", "Action"]),
        ("x", -3, " ", 1991, 8.0, []),
        (None, None, "D", 1992, 8.5, None),
        ("tt12345678", 5, "E", 1993, 9.0, ["Drama", "Action", "Comedy", "Comedy"]),
    ]
    df = conform_items(spark.createDataFrame(
        rows, "imdb_id string, tmdb_id long, title string, release_year int, rating_value double, "
        "genres array<string>"))
    got = {r.metric: r.value for r in quality_metrics(df).collect()}
    assert got["duplicate_imdb_ids"] == 2 and got["duplicate_title_year_combinations"] == 2
    assert got["missing_titles"] == 1 and got["missing_genres"] == 2
    assert got["invalid_imdb_format"] == 1 and got["invalid_tmdb_ids"] == 1
    assert got["orphan_records"] == 1 and got["invalid_ratings"] == 0
    counts = {r.value: r["count"] for r in value_frequency(df, "genres").collect()}
    assert counts == {"Drama": 3, "Action": 2, "Comedy": 2}
    bins = {r.bin: r["count"] for r in rating_histogram(df).collect()}
    assert bins == {"7.0-8.0": 2, "8.0-9.0": 2, "9.0-10.0": 1}


def test_first_by_word_meets_no_query_with_every_item(spark):
    rnd = random.Random(8)
    rows = [
        (i, rnd.choice([None, 1.0, 2.0, 3.0]), ["all", *rnd.sample("abcdef", 2)]) for i in range(300)
    ]
    # An item that comes twice, and one whose words differ from row to row.
    rows += [rows[5], (6, 9.0, ["a"]), (6, 8.0, None)]
    asked = [(q, w) for q in range(20) for w in ["all", *rnd.sample("abcdefz", 2)]]
    d = spark.createDataFrame(rows, "item_id int, popularity double, words array<string>")
    a = spark.createDataFrame(asked, "query_id int, word string")
    order = [F.col("popularity").desc_nulls_last(), F.asc("item_id")]
    hits = K.first_by_word(d, a, order, 4).collect()
    assert len(hits) == len(set(hits)) <= 4 * len(asked)
    for q in range(20):
        words = {w for x, w in asked if x == q}
        ids = {i for i, _, held in rows if held and words & set(held)}
        own = sorted((-(p or 0), i) for i, p, _ in rows if i in ids)[:4]
        found = {h.item_id for h in hits if h.query_id == q}
        assert sorted((-(p or 0), i) for i, p, _ in rows if i in found)[:4] == own


def test_strict_constraints_are_the_same_made_per_item_or_per_pair(spark):
    """Facts of items and demands of queries, made before the two meet."""
    from curatrix.operators.filters import (
        strict_candidates, strict_demands, strict_facts, with_rejections,
    )
    from curatrix.schema import make_intent

    shape = (
        "item_id long, title string, original_title string, overview string, genres array<string>, "
        "vote_count long, release_year int, runtime_minutes int, languages array<string>, "
        "directors array<string>, cast array<string>, keywords array<string>"
    )
    items = spark.createDataFrame(
        [
            (1, "Red Season 2", None, "x" * 20, ["Drama"], 9, 1999, 90, ["en"], ["A"], ["B"], ["gore"]),
            (2, None, "Blue", None, ["Documentary", "Horror"], 3, None, 200, None, None, None, None),
            (3, "", None, "long enough text", ["Sci-Fi"], None, 2001, None, ["FR"], ["b"], [], []),
        ],
        shape,
    )
    some = lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.array().cast("array<string>")
    intents = [
        make_intent(),
        make_intent(
            genres=some("drama"), avoid_movies=some("", "RED"), language=F.lit("French"),
            preferred_directors=some("a"), preferred_actors=some("z"), runtime=F.lit(60),
            family_safety=F.lit("family_safe"), release_year=F.lit(2020), country=F.lit("Japan"),
        ),
        make_intent(genres=none, avoid_genres=some("Science Fiction", "Drama", "Documentary")),
    ]
    queries = reduce(
        lambda a, b: a.unionByName(b),
        [spark.range(n, n + 1).select(F.col("id").alias("query_id"), i.alias("intent"))
         for n, i in enumerate(intents)],
    )
    late = items.crossJoin(queries)
    early = strict_facts(items).crossJoin(strict_demands(queries))

    def rows(df):
        return sorted((r["query_id"], r["item_id"], r["reject_reasons"]) for r in df.collect())

    found = rows(with_rejections(early))
    assert found == rows(with_rejections(late))
    assert with_rejections(early).columns == [*late.columns, "reject_reasons"]
    reasons = {(q, i): r for q, i, r in found}
    assert reasons[0, 1] == ["series"]
    assert reasons[0, 2] == ["release", "overview", "votes", "documentary"]
    assert reasons[1, 1] == [
        "avoid_title", "language", "year", "actor", "runtime", "family", "series",
    ]
    assert reasons[2, 3] == ["avoid_genre"]
    assert rows(strict_candidates(early)) == rows(strict_candidates(late))


def test_ranking_reads_sets_made_before_pairs(spark):
    """Pairs of prepared items and queries rank as bare pairs do, nulls too, and no
    text of an item is searched per pair."""
    from curatrix.operators import ranking as R

    shape = (
        "item_id long, title string, original_title string, tagline string, overview string, "
        "plot_summary string, genres array<string>, keywords array<string>, cast array<string>, "
        "directors array<string>, production_companies array<string>, collection_name string, "
        "rating_value double, vote_count long, popularity double, release_year int, "
        "runtime_minutes int, semantic double"
    )
    items = spark.createDataFrame(
        [
            (1, "Heat", None, "An Oscar", "A dark heist in Venice", "", ["Drama", "Crime"], ["Heist", None],
             ["Al", None], ["Mann"], ["Studio A", None], "Heat Saga", 8.2, 2000, 30.0, 1995, 170, 0.4),
            (2, "", "Old", None, None, None, None, None, None, None, None, "", None, None, None, None, None, 0.1),
            (3, "Space", "Space", "x", "y", "bafta", ["sci-fi", ""], ["twist"], [], ["D", "d"], [], None, 3.0,
             5, 0.0, 0, 0, None),
        ],
        shape,
    )
    asked = [
        {"genres": ["DRAMA", None], "preferred_actors": ["al"], "studio": "studio a", "ranking_mode": "default"},
        {"genres": ["Science Fiction", ""], "preferred_directors": ["d"], "ranking_mode": "best"},
        {"moods": ["dark"], "themes": ["heist", "twist"], "similar_movies": ["hea"], "ranking_mode": "mood"},
        {"awards_preference": "oscar", "novelty_preference": "classic", "ranking_mode": "similar"},
        {"genres": ["Crime"], "keywords": ["heist"], "release_year": 1994, "ranking_mode": "discover"},
    ]

    def literal(v):
        return lits(*v).cast("array<string>") if isinstance(v, list) else F.lit(v)

    queries = reduce(
        lambda a, b: a.unionByName(b),
        [
            spark.range(1).select(
                F.lit(n).cast("long").alias("query_id"),
                make_intent(**{f: literal(v) for f, v in i.items()}).alias("intent"),
            )
            for n, i in enumerate(asked)
        ],
    )
    queries = R.with_weights(queries)
    bare = items.crossJoin(queries)
    made = R.item_sets(items).crossJoin(R.query_sets(queries))
    for rank, text in ((R.rank_candidates, "explanation"), (R.profile_scores, "reason")):
        columns = ["query_id", "item_id", "score", "score_rank", "match_pct", "score_components", text]
        plain, done = (sorted(map(str, rank(p).select(columns).collect())) for p in (bare, made))
        assert plain == done and len(done) == 15
        assert not {c for c in rank(made).columns if c.startswith("_")}
    # Pairs of items that were written with their sets hold no pattern to search for.
    held = settle(R.item_sets(items), "items").crossJoin(settle(R.query_sets(queries), "asks"))
    plan = R.rank_candidates(held).select("score")._jdf.queryExecution().optimizedPlan().toString()
    assert "golden globe" not in plan
