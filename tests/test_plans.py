import json
import math

import numpy as np
from pyspark.sql import functions as F

from curatrix.plans import embedding as E, enrichment as N, merge as G
from curatrix.schema import conform_items
from curatrix.session import scratch, scratch_path, settle
from curatrix.sources import delimited, manifest, sinks
from curatrix.streaming import incremental as S

SCHEMA = """imdb_id string, tmdb_id long, movielens_id long, wiki_page string, title string,
overview string, plot_summary string, genres array<string>, cast array<string>, release_year int,
rating_value double, vote_count long"""


def source(spark, name, rows):
    return conform_items(spark.createDataFrame(rows, SCHEMA), name)


def four_sources(spark):
    titles = source(spark, "imdb", [
        ("tt0000001", None, None, None, "Toy Story", None, None, ["Animation", "Comedy"],
         ["Tom Hanks"], 1995, 8.3, 10000),
        ("tt0000002", None, None, None, "Jumanji", None, None, ["Adventure"], ["R"], 1995, 7.0,
         5000),
        ("tt0000003", None, None, None, "Only Here", None, None, ["Drama"], ["C"], 2026, 5.0, 100),
        ("tt0000004", None, None, None, "Too Few", None, None, ["Drama"], ["C"], 2026, 5.0, 49),
    ])
    metadata = source(spark, "tmdb", [
        ("tt0000001", 862, None, None, "Toy Story", "An overview.", None, ["Family", "Animation"],
         ["Tom Hanks", "Tim Allen"], 1995, 7.9, 8000),
        (None, 888, None, None, "Meta Only", "Synopsis.", None, ["Action"], ["X"], 2026, 6.5, 200),
    ])
    movies = source(spark, "movielens", [
        ("tt0000001", 862, 1, None, "Toy Story", None, None, ["Adventure", "Animation"], None,
         1995, 9.0, 15000),
        ("tt0000002", None, 2, None, "Jumanji", None, None, ["Children"], None, 1995, 7.5, 7000),
    ])
    pages = source(spark, "wikipedia", [
        (None, None, None, "w/Toy", "Toy Story", None, "Plot.", ["Animation"], ["Tom Hanks"],
         1995, None, None),
        (None, None, None, "w/Here", "ONLY here!", None, "P2.", ["Sci"], None, 2026, None, None),
        (None, None, None, "w/Un", "Unlinked", None, "P3.", ["Sci-Fi"], ["Z"], 2026, None, None),
    ])
    return titles, metadata, movies, pages


def test_golden_merge(spark):
    merged = G.merge_catalogue(*four_sources(spark)).collect()
    assert len(merged) == 5
    toy = next(r for r in merged if r.imdb_id == "tt0000001")
    assert (toy.tmdb_id, toy.movielens_id, toy.wiki_page) == (862, 1, "w/Toy")
    assert (toy.overview, toy.plot_summary) == ("An overview.", "Plot.")
    assert toy.genres == ["Adventure", "Animation", "Comedy", "Family"]
    assert toy["cast"] == ["Tim Allen", "Tom Hanks"] and toy.vote_count == 33000
    want = (7.9 * 8000 + 9.0 * 15000 + 8.3 * 10000) / 33000
    assert abs(toy.rating_value - want) < 1e-4
    assert toy.source_dataset == "tmdb" and toy.document.startswith("Title: Toy Story (1995)")
    here = next(r for r in merged if r.imdb_id == "tt0000003")
    assert here.wiki_page == "w/Here"
    assert len({r.item_key for r in merged}) == 5


def test_merge_broadcasts_no_growing_side(spark):
    """Sources read from files look small by a few of their columns."""
    stored = [settle(df, "source") for df in four_sources(spark)]
    merged = G.merge_catalogue(*stored)
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.count() == 5


def test_compat_merge_loses_unlinked_match(spark):
    merged = G.merge_catalogue(*four_sources(spark), compat=True).collect()
    assert len(merged) == 5
    assert next(r for r in merged if r.imdb_id == "tt0000003").wiki_page is None


def test_enrichment_never_overwrites(spark):
    items = source(spark, "x", [
        ("tt1", 1, None, None, "A", "kept", None, ["Drama"], None, 2000, 5.0, 1),
        ("tt2", None, None, None, "B", None, None, None, None, 2000, 5.0, 1),
    ])
    body = {"overview": "new", "poster_path": "/p.jpg", "genres": [{"name": "War"}],
            "belongs_to_collection": {"id": 1, "name": "Saga"}, "runtime": 99}
    payloads = spark.createDataFrame(
        [(1, json.dumps(body)), (2, json.dumps(body)), (2, json.dumps(body))],
        "tmdb_id long, payload string",
    )
    mapping = spark.createDataFrame([("tt2", 2), ("tt1", 0)], "imdb_id string, tmdb_id long")
    got = {r.imdb_id: r for r in N.enrich(items, payloads, mapping).collect()}
    assert len(got) == 2
    assert got["tt1"].overview == "kept" and got["tt1"].genres == ["Drama"]
    assert got["tt1"].collection_name == "Saga" and got["tt1"].poster_path.endswith("w500/p.jpg")
    assert got["tt2"].overview == "new" and got["tt2"].genres == ["War"]
    assert "Franchise / Collection: Saga" in got["tt2"].document


def test_resumed_encoding(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i} words", float(i)) for i in range(20)] + [(99, "  ", 1.0)],
        "item_id long, document string, popularity double",
    )
    store = scratch_path(spark, "v")
    E.encode_new(docs, None, limit=8).write.parquet(store)
    first = {r.item_id for r in spark.read.parquet(store).collect()}
    assert first == set(range(12, 20))
    E.encode_new(docs, spark.read.parquet(store)).write.mode("append").parquet(store)
    assert spark.read.parquet(store).count() == 20
    assert E.encode_new(docs, spark.read.parquet(store)).count() == 0
    row = E.run_summary(spark.read.parquet(store)).first()
    assert (row.total_vectors, row.dimension, row.norm_error) == (20, 384, 0.0)


def test_stream_resumes_and_matches_batch(spark):
    src, table, ckpt = (scratch_path(spark, n) for n in ("src", "table", "ckpt"))
    schema = "user string, item string, ts long, kind string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        log = S.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        S.compact_log(log, table, ckpt, ["user", "item"], ["ts"])
        return {(r.user, r.item): r.kind for r in sinks.read_buckets(spark, table).collect()}

    arrive([("u", "a", 1, "add"), ("u", "b", 2, "add")])
    assert run() == {("u", "a"): "add", ("u", "b"): "add"}
    arrive([("u", "a", 5, "del"), ("u", "b", 1, "late")])
    assert run() == {("u", "a"): "del", ("u", "b"): "add"}
    assert run() == {("u", "a"): "del", ("u", "b"): "add"}


def test_stores_keep_what_other_streams_wrote(spark):
    src_a, src_b, store = (scratch_path(spark, n) for n in ("a", "b", "store"))
    schema = "item_id long, vector array<double>"
    rows = lambda ids: spark.createDataFrame([(i, [1.0, float(i)]) for i in ids], schema)
    rows([1, 2, 3]).write.parquet(src_a)
    rows([3, 10, 11]).write.parquet(src_b)

    def run(src, ckpt):
        vectors = S.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        S.upsert_vectors(spark, vectors, store, ckpt)
        return sorted(r.item_id for r in S.read_store(spark, store).collect())

    first, second = scratch_path(spark, "ckpt"), scratch_path(spark, "ckpt")
    assert run(src_a, first) == [1, 2, 3]
    assert run(src_b, second) == [1, 2, 3, 10, 11]
    # A lost checkpoint replays everything and adds nothing.
    assert run(src_b, scratch_path(spark, "ckpt")) == [1, 2, 3, 10, 11]
    rows([4]).write.mode("append").parquet(src_a)
    assert run(src_a, first) == [1, 2, 3, 4, 10, 11]


def test_merge_rewrites_touched_buckets_only(spark):
    table = scratch_path(spark, "buckets")
    schema = "user string, ts long"
    merge = lambda rows: rows.groupBy("user", "_bucket").agg(F.max("ts").alias("ts"))
    for rows in ([("a", 1), ("b", 1), ("c", 1), ("d", 1)], [("a", 2)], [("a", 3)], [("a", 4)]):
        sinks.merge_buckets(spark.createDataFrame(rows, schema), table, ["user"], 8, merge)
    got = {r.user: r.ts for r in sinks.read_buckets(spark, table).collect()}
    assert got == {"a": 4, "b": 1, "c": 1, "d": 1}
    last = sinks.complete_versions(spark, table)[-1]
    assert spark.read.parquet(f"{table}/{last}").count() == 1
    # The second version holds nothing but what was written twice since.
    assert len(sinks.complete_versions(spark, table)) == 3


def test_a_job_removes_what_it_wrote(spark):
    with scratch(spark):
        kept = settle(spark.range(3), "job")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert spark.read.parquet(path).count() == 3
    try:
        spark.read.parquet(path).count()
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e)
    else:
        raise AssertionError("still there")


def test_manifest_and_delimited(spark):
    root = scratch_path(spark, "raw")
    df = spark.createDataFrame([("1", 'say "hi", you', "\\N"), ("2", "NA", "x")], "a string, b string, c string")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{root}/movielens")
    got = delimited.read_delimited(spark, f"{root}/movielens", "a int, b string, c string")
    assert sorted(map(tuple, got.collect())) == [(1, 'say "hi", you', None), (2, None, "x")]
    found = manifest.found_files(spark, root).where(F.col("file").endswith(".csv"))
    state = manifest.check_manifest(found, {"movielens": ["movies.csv"], "absent": ["y"]})
    assert {r.state for r in state.collect()} == {"missing", "unexpected"}
    assert manifest.complete_providers(state).count() == 0


def test_encoding_keeps_ids_and_holds_one_batch(spark):
    """Ids beyond 2^53 beside a null one stay as they are, and the encoder gets no
    more than a batch of texts."""
    ids = [2**53 + 1, None, *range(200)]
    docs = spark.createDataFrame([(i, f"a b {i}") for i in ids], "item_id long, document string").coalesce(1)

    def factory():
        def encode(texts):
            assert type(texts) is list and len(texts) <= 64
            return np.array([[1.0, len(t)] for t in texts])

        return encode

    done = E.encode_texts(docs, "item_id", "document", factory).collect()
    assert [r.item_id for r in done] == ids
    for r in done:
        assert math.isclose(sum(x * x for x in r.vector), 1.0, rel_tol=1e-6)
