"""Lookups of titles: gram index with kept heads, two-of-many pieces."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import lookups as K, title_index as X
from curatrix.session import scratch_path

ITEMS = "item_id long, title string, release_year int"
TITLES = [
    "The Night Train", "Nightfall", "A", "ab", "", None, "Straße nach Süden", "the night train",
    "İstanbul", "Nights of Night", "Train, the long night", "%_literal.*", "Aa",
]


def frame(spark, titles):
    return spark.createDataFrame([(i, t, 2000 + i) for i, t in enumerate(titles)], ITEMS)


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


# --- contained text ----------------------------------------------------------
def test_completion_against_plain_search(spark):
    rng = random.Random(3)
    words = ["night", "train", "the", "of", "sea", "a", "ü"]
    titles = TITLES + [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(200)]
    items = frame(spark, titles)
    texts = ["a", "A", "ni", "NIGHT", "night t", "zzzz", "", None, "the", ".*", "ü ", "süden", "a"]
    want = {
        (q, r, i)
        for q, text in enumerate(texts)
        if text and text.strip(" ")
        for r, (_, i) in enumerate(
            sorted(
                (t.encode(), i)
                for i, t in enumerate(titles)
                if t is not None and text.strip(" ").lower() in t.lower()
            )[:4],
            1,
        )
    }
    got = K.autocomplete(items, ask(spark, texts), limit=4)
    assert got.columns == ["query_id", "item_id", "title", "release_year", "rank"]
    assert {(r.query_id, r["rank"], r.item_id) for r in got.collect()} == want


def test_a_stored_index_answers_and_short_texts_read_k_rows(spark):
    items = frame(spark, [f"alpha {i:04d}" for i in range(3000)])
    built = K.completion_index(items, 5)
    path = scratch_path(spark, "titles")
    built.write(path)
    index = X.read_index(spark, path, ["title", "item_id"], 5)
    assert index.heads.groupBy("gram").count().agg(F.max("count")).first()[0] == 5
    assert index.heads.where(F.col("gram") == "a").count() == 5
    got = K.autocomplete(items, ask(spark, ["a", "alpha 2"]), 5, index)
    rows = sorted((r.query_id, r["rank"], r.item_id) for r in got.collect())
    assert rows == [(0, i + 1, i) for i in range(5)] + [(1, i + 1, 2000 + i) for i in range(5)]
    with pytest.raises(ValueError):
        K.autocomplete(items, ask(spark, ["a"]), 6, index)


def test_longer_texts_use_their_rarest_gram(spark):
    items = frame(spark, ["night one", "night two", "night owl", "nightly zebra"])
    index = K.completion_index(items)
    needles = spark.createDataFrame([("night o",), ("night zz",), ("nig",)], "needle string")
    got = {r.needle: r.gram for r in X.rarest_grams(index, needles).collect()}
    assert got == {"night o": "t o"}


def test_empty_tables(spark):
    none, items = frame(spark, []), frame(spark, TITLES)
    assert K.autocomplete(none, ask(spark, ["a"])).count() == 0
    assert K.autocomplete(items, ask(spark, [])).count() == 0
    assert K.fuzzy_titles(none, ask(spark, ["abc"])).count() == 0
    assert K.fuzzy_titles(items, ask(spark, [])).count() == 0


def test_contained_title_is_the_most_similar(spark):
    titles = [t for t in TITLES if t]
    items = frame(spark, titles).withColumn("popularity", F.col("item_id").cast("double"))
    texts = ["night", "train", "a", "THE NIGHT TRAIN", "xyz", "süd"]
    asked = ask(spark, texts).withColumnRenamed("text", "title")
    got = {r.query_id: (r.item_id, r.how) for r in K.lookup_titles(items, asked).collect()}
    want = {}
    for q, text in enumerate(texts):
        same = [i for i, t in enumerate(titles) if t.lower() == text.lower()]
        if same:
            want[q] = (max(same), "exact")
            continue
        held = [
            (-difflib.SequenceMatcher(None, t.lower(), text.lower()).ratio(), i)
            for i, t in enumerate(titles) if text.lower() in t.lower()
        ]
        if held:
            want[q] = (min(held)[1], "contains")
    assert got == want


def test_ids_shared_by_many_items_and_asked_by_many(spark):
    items = spark.createDataFrame(
        [(i, 7, "tt7", "page", f"t{i}") for i in range(2000)],
        "item_id long, tmdb_id long, imdb_id string, wiki_page string, title string",
    )
    wanted = spark.createDataFrame(
        [(q, ("7", "tt7", "page", "none", None)[q % 5]) for q in range(2000)],
        "query_id long, key string",
    )
    got = K.by_any_id(items, wanted).collect()
    assert len(got) == 1200
    assert {(r.query_id % 5, r.item_id, r.route) for r in got} == {(0, 0, 1), (1, 0, 2), (2, 0, 3)}


# --- similar titles ----------------------------------------------------------
def best(titles, text):
    text = (text or "").strip(" ")
    ratios = [
        (difflib.SequenceMatcher(None, t, text).ratio(), t.encode(), t) for t in set(titles) if t
    ]
    held = [r for r in ratios if text and r[0] >= K.CUTOFF]
    return max(held)[2] if held else None


def edited(rng, title, edits):
    letters = list(title)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 and at < len(letters) and len(letters) > 1:
            del letters[at]
        else:
            letters.insert(at, rng.choice("aeintü "))
    return "".join(letters)


@pytest.mark.parametrize("hot", [1, 3, 512])
def test_pieces_lose_no_title(spark, hot):
    rng = random.Random(hot)
    endings = ["sea", "train", "of night", "long road", "süd", "x", "winter is near us"]
    titles = ["The " + rng.choice(["last ", "first ", ""]) + rng.choice(endings) for _ in range(40)]
    titles += ["a", "ab", "abc", "aaaa", "aaaaaaaaaa", "", None]
    named = sorted({t for t in titles if t})
    texts = [edited(rng, rng.choice(named), rng.randint(0, 3)) for _ in range(60)]
    texts += [*named, "", None, "   ", "aaaaaaaaa"]
    got = {
        r.query_id: r.title
        for r in K.fuzzy_titles(frame(spark, titles), ask(spark, texts), hot).collect()
    }
    want = {q: best(titles, t) for q, t in enumerate(texts)}
    assert got == {q: t for q, t in want.items() if t}


def test_ten_thousand_titles_beginning_alike(spark):
    """No key leads to many titles, though all begin with the same words."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = sorted({"The " + "".join(rng.choices(letters, k=16)) for _ in range(10_000)})
    titles = frame(spark, names)
    pieces = K.title_pieces(titles).cache()
    assert pieces.groupBy("n", "idx", "piece").count().agg(F.max("count")).first()[0] > 9_000
    keys = K._keys(pieces, K.hot_pieces(pieces), "title")
    by = ["n", "idx", "piece", "idx2", "piece2"]
    assert keys.groupBy(*by).count().agg(F.max("count")).first()[0] <= K.HOT_TITLES
    pieces.unpersist()
    texts = [edited(rng, n, 2) for n in names[::500]]
    got = {r.query_id: r.title for r in K.fuzzy_titles(titles, ask(spark, texts)).collect()}
    assert all(
        difflib.SequenceMatcher(None, got[q], t).ratio()
        >= difflib.SequenceMatcher(None, n, t).ratio() >= K.CUTOFF
        for q, (t, n) in enumerate(zip(texts, names[::500], strict=True))
    )


def test_fuzzy_titles_are_spread_and_rated_once(spark):
    """Texts stay on as many tasks as the session has, however small they are,
    and the ratio is not worked out again behind its filter."""
    titles = frame(spark, ["red widget", "blue bolt"])
    found = K.fuzzy_titles(titles, ask(spark, ["red widgets", "blue bolts"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "REPARTITION_BY_NUM" in plan
    assert {r.title for r in found.collect()} == {"red widget", "blue bolt"}
