"""Streams that remember their keys."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.session import scratch_path
from curatrix.streaming import incremental as S, keyed

VECTORS = "item_id long, vector array<double>"
ASKED = "imdb_id string, fetched_at timestamp"


def land(spark, rows, schema, folder):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode("append").parquet(folder)


def source(spark, folder, schema):
    return S.file_stream(spark, folder, spark.createDataFrame([], schema).schema)


def stored(spark, store):
    return sorted((r.item_id, tuple(r.vector)) for r in S.read_store(spark, store).collect())


def test_second_batch_opens_no_stored_file(spark, monkeypatch):
    folder, store, ckpt = (scratch_path(spark, n) for n in ("in", "store", "ckpt"))
    opened = []
    plain = S.stored_by_others

    def watched(*args):
        rows = plain(*args)
        opened.append(
            spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
        )
        opened.append(rows.select(F.input_file_name()).distinct().count())
        return rows

    monkeypatch.setattr(S, "stored_by_others", watched)
    for rows in ([(1, [3.0, 4.0]), (2, [0.0, 2.0])], [(2, [5.0, 0.0]), (3, [1.0, 0.0])]):
        land(spark, rows, VECTORS, folder)
        S.upsert_vectors(spark, source(spark, folder, VECTORS), store, ckpt)
    assert stored(spark, store) == [(1, (0.6, 0.8)), (2, (0.0, 1.0)), (3, (1.0, 0.0))]
    assert opened[1::2] == [0, 0]
    assert "stream" in opened[2] and "PartitionFilters" in opened[2]


def test_ids_of_another_stream_and_repeats(spark):
    store = scratch_path(spark, "store")
    rng = random.Random(2)
    first = [(rng.randrange(300), [float(i), 1.0]) for i in range(900)]
    other = [(rng.randrange(600), [float(i), 2.0]) for i in range(900)] + [(None, [1.0, 1.0])]
    for n, rows in enumerate((first, other)):
        folder = scratch_path(spark, "in")
        land(spark, rows, VECTORS, folder)
        S.upsert_vectors(
            spark, source(spark, folder, VECTORS), store, scratch_path(spark, f"ckpt{n}")
        )
    got = [i for i, _ in stored(spark, store)]
    assert got == sorted({i for i, _ in first + other if i is not None})


def test_choice_within_a_batch_does_not_depend_on_order(spark):
    rows = [(i % 7, [float(i), 1.0]) for i in range(700)]
    seen = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        folder, store = scratch_path(spark, "in"), scratch_path(spark, "store")
        land(spark, rows, VECTORS, folder)
        S.upsert_vectors(
            spark, source(spark, folder, VECTORS), store, scratch_path(spark, "ckpt")
        )
        seen.append(stored(spark, store))
    assert seen[0] == seen[1] and len(seen[0]) == 7


def plain_due(batches, ttl):
    """Greedy by time within each batch, the latest fetch remembered."""
    last, due = {}, []
    for rows in batches:
        for name, at in sorted((r for r in rows if None not in r), key=lambda r: r[1]):
            if name not in last or at - last[name] > ttl:
                last[name] = at
                due.append((name, at))
    return sorted(due)


@pytest.mark.parametrize("ttl", [0, 60, 3600])
def test_fetches_that_are_due(spark, ttl):
    rng = random.Random(ttl)
    start = 1_700_000_000
    batches = [
        [
            (rng.choice(["hot"] * 5 + ["tt1", "tt2", ""]), start + 5000 * b + rng.randrange(5000))
            for _ in range(150)
        ]
        for b in range(3)
    ]
    batches[0] += [batches[0][0], (None, start), ("tt1", None)]
    folder, ckpt = scratch_path(spark, "in"), scratch_path(spark, "ckpt")
    got = []
    for rows in batches:
        typed = spark.createDataFrame(rows, "imdb_id string, s long").select(
            "imdb_id", F.timestamp_seconds("s").alias("fetched_at")
        )
        typed.coalesce(1).write.mode("append").parquet(folder)
        requests = source(spark, folder, ASKED)
        due = keyed.due_fetches(requests, "imdb_id", "fetched_at", ttl, "2 hours")
        S.drain(
            due, ckpt,
            lambda df, _: got.extend(
                df.select("imdb_id", F.unix_timestamp("fetched_at").alias("s")).collect()
            ),
        )
    assert sorted(map(tuple, got)) == plain_due(batches, ttl)


def test_queries_read_tables_that_are_files_or_folders(spark):
    from workload import increments

    rows = [(i, [1.0, float(i)], f"text {i}") for i in range(12)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, text string")
    docs = made.selectExpr("vec_id as doc_id", "text", "length(text) as n_chars")
    for files in (1, 3):
        sf = scratch_path(spark, "tables")
        for name, df in (("embeddings", made), ("documents", docs)):
            df.repartition(files).write.parquet(f"{sf}/{name}.parquet")
        if files == 1:
            one = scratch_path(spark, "tables")
            hadoop = spark._jvm.org.apache.hadoop.fs
            fs = hadoop.Path(one).getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(hadoop.Path(one))
            for name in ("embeddings", "documents"):
                part = fs.globStatus(hadoop.Path(f"{sf}/{name}.parquet/part-*"))[0].getPath()
                fs.rename(part, hadoop.Path(f"{one}/{name}.parquet"))
            sf = one
        got = increments.t2(spark, sf).collect()
        assert sorted((r.item_id, r.dims, r.copies) for r in got) == [(i, 2, 1) for i in range(12)]
        got = increments.t1(spark, sf).collect()
        assert sorted((r.item_id, r.vectors) for r in got) == [(i, 1) for i in range(12)]
