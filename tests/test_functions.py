from datetime import date

from pyspark.sql import functions as F

from curatrix.functions import documents as D, scores as S, text as X, understanding as U


def one(spark, value, fn, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(fn(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    assert one(spark, "  hello   world  ", X.clean_text) == "hello world"
    got = [one(spark, v, lambda c: X.lenient(c, "int")) for v in ("123", "abc", "45.6", None)]
    assert got == [123, None, None, None]
    got = [one(spark, v, X.iso_date) for v in ("2026-07-13", "invalid-date", None, "2026/07/13")]
    assert got == [date(2026, 7, 13), None, None, None]
    got = [one(spark, v, lambda c: X.rescale(c, 5.0), "double") for v in (2.5, 5.0, 0.5, None)]
    assert got == [5.0, 10.0, 1.0, None]


def test_lists_from_text(spark):
    text = '[{"id": 18, "name": "Drama"}, {"id": 80, "name": "Crime"}]'
    assert one(spark, text, X.json_values) == ["Drama", "Crime"]
    crew = "[{'job': 'Director', 'name': 'John Lasseter'}, {'job': 'Writer', 'name': 'Joe'}]"
    assert one(spark, crew, X.director_names) == ["John Lasseter"]
    assert one(spark, "drama/romance, comedy", lambda c: X.split_names(c, ",/")) == [
        "drama", "romance", "comedy",
    ]
    assert one(spark, "Toy Story (1995)", X.title_without_year) == "Toy Story"
    assert one(spark, "Toy Story (1995)", X.title_year) == 1995
    assert one(spark, "114709", X.title_id) == "tt0114709"
    assert one(spark, "11470912", X.title_id) == "tt11470912"


def test_tokens_and_genres(spark):
    got = one(spark, "Action-packed thriller, starring Se7en!", X.tokens)
    assert got == ["action", "packed", "thriller", "starring", "se7en"]
    got = one(spark, ["sci-fi", "x-men tale", "Scifi", "tv movie"], X.canonical_genres,
              "array<string>")
    assert got == ["Science Fiction", "X-Men Tale", "TV Movie"]
    assert one(spark, "电影", X.match_key) is None


def test_scores(spark):
    df = spark.createDataFrame(
        [("A", None, "It won the Academy Award", None, None), ("B", None, "Award-winning", None,
                                                              None)],
        "title string, tagline string, overview string, plot string, keywords array<string>",
    )
    got = df.select(S.award_grade(*[F.col(c) for c in df.columns]).alias("g")).collect()
    assert [r.g for r in got] == [0.33, 0.0]
    v = spark.createDataFrame([([0.0, 0.0], None)], "a array<double>, b array<double>")
    row = v.select(S.l2_normalise(F.col("a")).alias("u"), S.dot(F.col("a"), F.col("b")).alias("d"))
    assert row.first().u == [0.0, 0.0] and row.first().d is None


def test_item_document(spark):
    df = spark.sql(
        """select 'Heat' as title, 1995 as release_year, array('Crime') as genres,
        array('M') as directors, cast(null as array<string>) as writers,
        transform(sequence(1, 11), i -> 'A' || i) as cast, cast(null as string) as collection_name,
        array() as production_companies, array('en') as languages, 7.96 as rating_value,
        cast(null as string) as certification, cast(null as array<string>) as streaming_providers,
        array('la') as keywords, ' ' as tagline, 'short' as overview, ' a longer plot ' as
        plot_summary"""
    )
    doc = df.select(D.item_document(first_cast=10).alias("d")).first().d
    assert doc.startswith("Title: Heat (1995)\nGenres: Crime\nDirected by: M\nStarring: A1, ")
    assert "A10" in doc and "A11" not in doc and "Tagline" not in doc
    assert doc.endswith("Rating: 8.0/10\nKeywords / Themes: la\nDescription: a longer plot")
    nameless = df.withColumn("title", F.lit(None).cast("string"))
    assert nameless.select(D.item_document().alias("d")).first().d is None


def test_understanding(spark):
    rows = [
        (1, "movies by Christopher Nolan"),
        (2, "best sci-fi movies like The Matrix without horror and romance between 1990 and 2005"),
        (3, "Tell me about Inception"),
        (4, "best movies"),
    ]
    df = spark.createDataFrame(rows, "query_id int, text string")
    df = df.withColumn("intent", U.heuristic_intent(F.col("text")))
    got = {r.query_id: r for r in U.with_person_route(df).collect()}
    assert got[1].route.name == "Christopher Nolan" and got[1].route.is_director
    assert got[1].route.confidence == 0.98
    assert got[2].route.name is None and got[4].route.name is None
    i = got[2].intent
    assert (i.ranking_mode, i.similar_movies, i.avoid_genres) == ("best", ["The Matrix"], ["Horror"])
    assert (i.year_range.start, i.year_range.end, i.release_year) == (1990, 2005, None)
    assert got[3].intent.intent == "movie_lookup" and got[3].intent.similar_movies == ["Inception"]


def test_completions(spark):
    raws = [
        '```json\n{"genres": ["sci-fi"], "movie_name": "A", "similar_movies": "B",\n```',
        "no json",
        '{"ranking_mode": "Most Similar", "strict_person_filter": true}',
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    got = [r.intent for r in U.completion_intents(df).orderBy("id").collect()]
    assert got[0].genres == ["Science Fiction"] and got[0].similar_movies == ["A", "B"]
    assert got[1] is None
    assert got[2].ranking_mode == "similar" and got[2].strict_person_filter
