"""Finding items by id, exact title, contained text, similar title, person."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import empty_if_null
from ..schema import with_intent
from ..session import lookup_join
from .grouping import keep_one, top_k
from .title_index import GRAM, TitleIndex, build_index, first_containing, grams

# Fixed value: least similarity ratio of a fuzzy title match.
CUTOFF = 0.88
# A piece of more titles than this is looked up together with a second one.
HOT_TITLES = 512


def contains_matches(items: DataFrame, needles: DataFrame, text: str) -> DataFrame:
    """Item rows x needle rows where lower(text) contains the needle.

    needles(query_id, needle) are lower-cased. Both sides meet on the needle's
    first characters (up to three), which any containing text must hold among
    its own grams, so nothing is lost and no cross product is formed."""
    needles = needles.where(F.length("needle") > 0).withColumn(
        "_gram", F.substring("needle", 1, GRAM)
    )
    low = F.lower(F.col(text))
    # A short needle is its own key, so shorter grams are kept as well.
    keys = F.array_distinct(F.concat(*[grams(low, n) for n in range(1, GRAM + 1)]))
    spread = items.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(keys))
    met = lookup_join(spread, needles, ["_gram"], spread_by="item_id")
    return met.where(F.lower(F.col(text)).contains(F.col("needle"))).drop("_gram")


def completion_index(
    items: DataFrame, limit: int = 10, needles: DataFrame | None = None
) -> TitleIndex:
    """Index that completes typed text to titles, in the order of titles."""
    slim = items.select("item_id", "title", "release_year")
    return build_index(slim, "title", ["title", "item_id"], limit, needles)


def autocomplete(
    items: DataFrame, needles: DataFrame, limit: int = 10, index: TitleIndex | None = None
) -> DataFrame:
    """First items per query whose title contains the typed text, literally.
    With an index that was built before, items are not read."""
    typed = needles.select("query_id", F.lower(F.trim("text")).alias("needle"))
    index = index or completion_index(items, limit, typed)
    if limit > index.keep:
        raise ValueError(f"the index keeps {index.keep} titles per gram")
    found = first_containing(index, typed).where(F.col("place") <= limit)
    met = lookup_join(typed, found, ["needle"], spread_by="query_id")
    return met.withColumnRenamed("place", "rank").drop("needle")


def by_any_id(items: DataFrame, wanted: DataFrame, custom: str = "wiki_page") -> DataFrame:
    """Row per wanted(query_id, key): number id, else text id, else custom id."""
    slim = items.select("item_id", "tmdb_id", "imdb_id", F.col(custom).alias("_custom"), "title")
    forms = F.array(
        F.struct(F.lit(1).alias("route"), F.col("tmdb_id").cast("string").alias("key")),
        F.struct(F.lit(2).alias("route"), F.col("imdb_id").alias("key")),
        F.struct(F.lit(3).alias("route"), F.col("_custom").alias("key")),
    )
    keyed = slim.select("item_id", "title", F.explode(forms).alias("f")).select(
        "item_id", "title", "f.route", "f.key"
    ).where(F.col("key").isNotNull())
    number = F.col("key").try_cast("bigint")
    asked = wanted.select(
        "query_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("route"), number.cast("string").alias("key")),
                F.struct(F.lit(2).alias("route"), F.col("key").alias("key")),
                F.struct(F.lit(3).alias("route"), F.col("key").alias("key")),
            )
        ).alias("f"),
    ).select("query_id", "f.route", "f.key").where(F.col("key").isNotNull())
    # One winner per key, for keys that are asked only: a key shared by many
    # items and asked by many queries is no product.
    wanted_keys = asked.select("route", "key").distinct()
    winners = keep_one(keyed, ["route", "key"], ["item_id"]).join(wanted_keys, ["route", "key"])
    met = lookup_join(asked, winners, ["route", "key"], spread_by="query_id")
    return keep_one(met.drop("key"), ["query_id"], ["route", "item_id"])


def exact_titles(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, title): the catalogue title equal to the query text, letter
    case aside."""
    titles = items.where(F.col("title").isNotNull()).groupBy(
        F.lower("title").alias("_t")
    ).agg(F.min("title").alias("title"))
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("_t"))
    # Titles are looked up once per distinct text; what is found is small, and
    # a text asked by millions meets one row, which a skewed join can split.
    found = asked.select("_t").distinct().join(titles, "_t")
    return asked.join(found, "_t").select("query_id", "title")


def lookup_titles(items: DataFrame, queries: DataFrame) -> DataFrame:
    """One item per queries(query_id, title): the most popular exact match,
    else the containing title with the highest similarity ratio."""
    asked = queries.select("query_id", F.lower("title").alias("needle"))
    slim = items.select("item_id", "title", "popularity")
    # One winner per title before any query is met: no product per title.
    winners = keep_one(
        slim.where(F.col("title").isNotNull())
        .withColumn("needle", F.lower("title"))
        .withColumn("_p", -F.coalesce(F.col("popularity").cast("double"), F.lit(-1.0))),
        ["needle"],
        ["_p", "item_id"],
    )
    exact = winners.join(asked, "needle").select(
        "query_id", "item_id", "title", F.lit("exact").alias("how")
    )
    rest = asked.join(exact.select("query_id"), "query_id", "left_anti")
    # A title that holds the text has the text as its matching part, so the
    # ratio 2 * text / (text + title) falls with the length of the title.
    index = build_index(slim.select("item_id", "title"), "title", ["_n", "item_id"], 1, rest)
    held = first_containing(index, rest).drop("place")
    near = lookup_join(rest, held, ["needle"], spread_by="query_id")
    return exact.unionByName(
        near.select("query_id", "item_id", "title", F.lit("contains").alias("how"))
    )


def reference_items(items: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, item_id, how): the item each query refers to. Its titles are
    tried in order, exact before contained, and the first hit counts if it has
    a vector. queries carry intent.similar_movies."""
    asked = queries.select(
        "query_id", F.posexplode("intent.similar_movies").alias("pos", "title")
    ).select("query_id", "pos", F.lower("title").alias("needle"))
    slim = items.select("item_id", "title")
    titled = slim.where(F.col("title").isNotNull()).withColumn("needle", F.lower("title"))
    needles = asked.select("needle").distinct()
    exact = keep_one(titled, ["needle"], ["item_id"]).join(needles, "needle", "left_semi")
    inner = first_containing(build_index(slim, "title", ["item_id"], 1, needles), needles)
    found = keep_one(
        exact.withColumn("how", F.lit(1))
        .unionByName(inner.drop("place").withColumn("how", F.lit(2)))
        .drop("title"),
        ["needle"],
        ["how", "item_id"],
    )
    per_title = lookup_join(asked, found, ["needle"], spread_by="query_id").drop("needle")
    with_vector = per_title.join(vectors.select("item_id"), "item_id", "left_semi")
    return keep_one(with_vector, ["query_id"], ["pos"])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sequence-matcher ratio of two texts."""
    return pd.Series(
        [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    )


def _allowed_edits(length: Column) -> Column:
    """Insertions plus deletions a title of this length can differ by and
    still reach CUTOFF with any admissible query length."""
    longest = F.floor(length * F.lit((2 - CUTOFF) / CUTOFF) + 1e-9)
    return F.floor((length + longest) * F.lit(1 - CUTOFF) + 1e-9).cast("int")


def _segments(length: Column) -> Column:
    """Even cut of a title into two pieces more than the edits allowed:
    structs (idx, start, len). At least two pieces must survive unedited. A
    title of one letter is one piece, which no edit may touch."""
    pieces = F.least(_allowed_edits(length) + 2, length)
    bound = lambda i: F.floor(length * i / pieces).cast("int")
    return F.transform(
        F.sequence(F.lit(0), pieces - 1),
        lambda i: F.struct(
            i.alias("idx"),
            (bound(i) + 1).alias("start"),
            (bound(i + 1) - bound(i)).alias("len"),
        ),
    )


def _keys(pieces: DataFrame, hot: DataFrame, owner: str) -> DataFrame:
    """Keys under which the owner of pieces(owner, n, idx, piece) is found:
    each cold piece by itself, and each two hot ones together."""
    key = ["n", "idx", "piece"]
    marked = lookup_join(pieces, hot, key, spread_by=owner, how="left")
    alone = marked.where(F.col("_hot").isNull()).select(
        owner, *key, F.lit(-1).alias("idx2"), F.lit("").alias("piece2")
    )
    # At most as many as a title has pieces, times their places in a query.
    held = marked.where(F.col("_hot")).groupBy(owner, "n").agg(
        F.collect_list(F.struct("idx", "piece")).alias("_all")
    )
    first = held.withColumn("_a", F.explode("_all"))
    both = first.withColumn(
        "_b", F.explode(F.filter("_all", lambda x: x["idx"] > F.col("_a.idx")))
    ).select(
        owner, "n", F.col("_a.idx").alias("idx"), F.col("_a.piece").alias("piece"),
        F.col("_b.idx").alias("idx2"), F.col("_b.piece").alias("piece2"),
    )
    return alone.unionByName(both)


def title_pieces(titles: DataFrame) -> DataFrame:
    """(title, n, idx, piece) of every different title of length n."""
    names = titles.select("title").where(F.length("title") > 0).distinct()
    cut = names.withColumn("n", F.length("title")).withColumn(
        "_s", F.explode(_segments(F.length("title")))
    )
    return cut.select(
        "title",
        "n",
        F.col("_s.idx").alias("idx"),
        F.substr(F.col("title"), F.col("_s.start"), F.col("_s.len")).alias("piece"),
    )


def hot_pieces(pieces: DataFrame, most: int = HOT_TITLES) -> DataFrame:
    """(n, idx, piece, _hot) of the pieces that more than `most` titles have."""
    counted = pieces.groupBy("n", "idx", "piece").agg(F.count("*").alias("_c"))
    return counted.where(F.col("_c") > most).select("n", "idx", "piece", F.lit(True).alias("_hot"))


def _probes(texts: DataFrame) -> DataFrame:
    """(text, n, idx, piece): for every admissible title length, what stands
    in a text where a piece of such a title may lie."""
    m = F.length("text")
    lengths = F.sequence(
        F.greatest(F.lit(1), F.ceil(m * F.lit(CUTOFF / (2 - CUTOFF)) - 1e-9).cast("int")),
        F.greatest(F.lit(1), F.floor(m * F.lit((2 - CUTOFF) / CUTOFF) + 1e-9).cast("int")),
    )
    probes = texts.withColumn("n", F.explode(lengths)).withColumn(
        "_s", F.explode(_segments(F.col("n")))
    ).withColumn("_e", _allowed_edits(F.col("n")))
    # Where the piece may start in the query; empty when it cannot fit.
    first = F.greatest(F.lit(1), F.col("_s.start") - F.col("_e"))
    last = F.least(F.length("text") - F.col("_s.len") + 1, F.col("_s.start") + F.col("_e"))
    return (
        probes.withColumn("_a", first)
        .withColumn("_b", last)
        .where(F.col("_a") <= F.col("_b"))
        .withColumn("at", F.explode(F.sequence("_a", "_b")))
        .select(
            "text",
            "n",
            F.col("_s.idx").alias("idx"),
            F.substr(F.col("text"), F.col("at"), F.col("_s.len")).alias("piece"),
        )
        .distinct()
    )


def _most_similar(a: Column, b: Column) -> Column:
    """Upper bound of the ratio of two texts, from the letters they share."""
    letters = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substr(a, i, F.lit(1)))
    )
    times = lambda text, x: F.length(text) - F.length(F.replace(text, x, F.lit("")))
    shared = F.aggregate(
        letters, F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x))
    )
    return 2.0 * shared / (F.length(a) + F.length(b))


def fuzzy_titles(titles: DataFrame, queries: DataFrame, hot: int = HOT_TITLES) -> DataFrame:
    """(query_id, title, ratio): the most similar title of ratio >= CUTOFF.

    ratio = 2M/(a+b) bounds the edits by (1-CUTOFF)(a+b), so of the edits+2
    pieces a title is cut into two occur unchanged in the query, each shifted
    by no more than the edits. Either one of the two is a piece of at most
    `hot` titles, or both are hot and the two meet as a pair: no title is
    lost, and a beginning that many titles share is never a key by itself.
    Only titles that share two hot pieces can make a larger key.
    The ratio is computed for those that meet and share enough letters. Null
    and empty texts find nothing."""
    if hot < 1:
        raise ValueError("a piece of one title cannot be hot")
    pieces = title_pieces(titles)
    often = hot_pieces(pieces, hot)
    asked = (
        queries.select(F.trim("text").alias("text"))
        .where(F.length("text") > 0)
        .distinct()
    )
    # Few bytes, much work: joined by size, all texts would come to one task. A
    # number other than distinct's, as Spark drops an exchange that is the same.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    asked = asked.repartition(parts, "text")
    met = (
        _keys(pieces, often, "title")
        .join(_keys(_probes(asked), often, "text"), ["n", "idx", "piece", "idx2", "piece2"])
        .select("text", "title")
        .distinct()
        .where(_most_similar(F.col("title"), F.col("text")) >= CUTOFF - 1e-9)
    )
    # So called, as a deterministic one is run once for the filter and once behind it.
    ratio = similarity.asNondeterministic()(F.col("title"), F.col("text"))
    best = met.withColumn("ratio", ratio).where(F.col("ratio") >= CUTOFF)
    best = best.groupBy("text").agg(F.max(F.struct("ratio", "title")).alias("b"))
    return queries.withColumn("_text", F.trim("text")).join(
        best.withColumnRenamed("text", "_text"), "_text"
    ).select("query_id", F.col("b.title").alias("title"), F.col("b.ratio").alias("ratio"))


def filmography(
    items: DataFrame, people: DataFrame, column: str, limit: int | None = None
) -> DataFrame:
    """Items of people(query_id, name) over a list column, by popularity."""
    asked = people.select("query_id", F.lower("name").alias("_name")).distinct()
    spread = items.select(
        "item_id", "title", "popularity", F.explode(column).alias("_n")
    ).withColumn("_name", F.lower("_n"))
    met = lookup_join(spread, asked, ["_name"], spread_by="item_id")
    met = met.select("query_id", "item_id", "title", "popularity").distinct()
    return top_k(
        met, ["query_id"], [F.col("popularity").desc_nulls_last(), F.asc("item_id")], limit
    )


def first_by_word(items: DataFrame, asked: DataFrame, order: list[Column], k: int) -> DataFrame:
    """(query_id, item_id), each pair once, among which are every query's first
    k items that hold one of its words. items(item_id, words, and what `order`
    reads), asked(query_id, word), each pair once.

    The first k of a query are among the first k of each of its words, so items
    are cut per word before any query meets them: no row per query and item."""
    held = items.select("item_id", F.explode("words").alias("word")).distinct()
    keyed = held.join(asked, "word", "left_semi").join(items.drop("words"), "item_id")
    firsts = top_k(keyed, ["word"], order, k).select("word", "item_id")
    return firsts.join(asked, "word").select("query_id", "item_id").distinct()


def validated_people(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with the preferred people unknown to the catalogue dropped from
    strict intents; with none left the strict flag is cleared."""
    i = F.col("intent")
    names = F.array_distinct(F.concat(i["preferred_directors"], i["preferred_actors"]))
    asked = queries.where(i["strict_person_filter"]).select(
        "query_id", F.explode(names).alias("name")
    ).withColumn("_name", F.lower("name"))
    catalogue = items.select(
        F.explode(
            F.array_distinct(
                F.concat(empty_if_null(F.col("cast")), empty_if_null(F.col("directors")))
            )
        ).alias("_n")
    ).select(F.lower("_n").alias("_name"))
    known_names = catalogue.distinct().join(asked.select("_name"), "_name", "left_semi")
    known = (
        asked.join(known_names, "_name", "left_semi")
        .groupBy("query_id")
        .agg(F.collect_set("name").alias("_known"))
    )
    df = queries.join(known, "query_id", "left").withColumn(
        "_known", empty_if_null(F.col("_known"))
    )
    strict = i["strict_person_filter"]

    def kept(field: str) -> Column:
        return F.when(
            strict, F.filter(i[field], lambda n: F.array_contains("_known", n))
        ).otherwise(i[field])

    return df.withColumn(
        "intent",
        with_intent(
            i,
            preferred_directors=kept("preferred_directors"),
            preferred_actors=kept("preferred_actors"),
            strict_person_filter=strict & (F.size("_known") > 0),
        ),
    ).drop("_known")
