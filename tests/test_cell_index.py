"""The cell index of item vectors against all products."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import cell_index as C
from curatrix.session import scratch_path

ROWS = "item_id long, vector array<double>"


def frame(spark, vectors, ids=None):
    rows = [(i, v if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def exact(vectors, queries, k, own=False):
    """{query: [(id, cosine)]} of {id: vector}."""
    out = {}
    for q, x in queries.items():
        x = np.asarray(x) / np.linalg.norm(x)
        scored = [
            (round(float(np.clip(x @ (np.asarray(v) / np.linalg.norm(v)), -1, 1)), 9), -i)
            for i, v in vectors.items() if own or i != q
        ]
        out[q] = [(-i, c) for c, i in sorted(scored, reverse=True)[:k]]
    return out


def same(got, want):
    ids = lambda d: {q: [i for i, _ in near] for q, near in d.items()}
    assert ids(got) == ids(want)
    for q, near in want.items():
        assert np.allclose([c for _, c in got[q]], [c for _, c in near], atol=1e-8)


def clustered(rng, n, d=16, centres=30):
    middle = rng.normal(size=(centres, d)) * 2
    return middle[rng.integers(0, centres, n)] + rng.normal(size=(n, d))


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.item_id, round(r.cosine, 9)))
    return out


def test_recall_and_work(spark):
    v = clustered(np.random.default_rng(1), 3000)
    df, path = frame(spark, v), scratch_path(spark, "cells")
    C.build(df, path)
    held = dict(enumerate(v))
    queries = {i: held[i] for i in range(0, 3000, 20)}
    asked = df.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    want = exact(held, queries, 10)
    got = found(C.search(asked, path, 10, skip_self=True, probes=0.2))
    share = np.mean([len(set(want[q]) & set(got[q])) / 10 for q in queries])
    assert share >= 0.9
    assert all(len(got[q]) == 10 for q in queries)
    # A fifth of the 54 cells is probed.
    assert len(C.centroids_of(spark, path)) == 54


def test_all_cells_probed_is_exact(spark):
    rng = np.random.default_rng(2)
    v = clustered(rng, 120, 5, 6).round(1)
    v[60:80] = v[60]
    df, path = frame(spark, v), scratch_path(spark, "cells")
    C.build(df.where("item_id < 100"), path, cells=7)
    for _ in range(2):
        C.add(df.where("item_id >= 100"), path, 1)
    held = dict(enumerate(v))
    asked = df.withColumnRenamed("item_id", "query_id")
    got = found(C.search(asked, path, 8, skip_self=True, probes=1.0, part=9, query_block=4))
    same(got, exact(held, held, 8))
    own = found(C.search(asked, path, 3, probes=1.0))
    same(own, exact(held, held, 3, own=True))


def test_odd_vectors_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, ROWS)
    path = scratch_path(spark, "cells")
    C.build(df, path)
    asked = spark.createDataFrame([(9, [0.0, 2.0]), (10, None)], "query_id long, vector array<double>")
    got = found(C.search(asked, path, 5, probes=1.0))
    assert got == {9: [(1, 1.0), (2, round(2**-0.5, 9)), (6, 0.0)]}
    assert C.search(asked.limit(0), path, 5).count() == 0


def test_queries_are_sent_once_per_group(spark, monkeypatch):
    v = clustered(np.random.default_rng(4), 600)
    df, path = frame(spark, v), scratch_path(spark, "cells")
    C.build(df, path, cells=20)
    sent = {}

    def kept(rows, label, plain=C.settle):
        sent[label] = plain(rows, label)
        return sent[label]

    monkeypatch.setattr(C, "settle", kept)
    got = found(C.search(df.withColumnRenamed("item_id", "query_id"), path, 5, skip_self=True, probes=1.0))
    held = dict(enumerate(v))
    same(got, exact(held, held, 5))
    assert sent["probes"].count() == 600


def test_cells_form_bounded_groups():
    groups, parts = C._groups({0: 4, 1: 5, 3: 30, 4: 2, 5: 9}, 7, 10)
    assert groups.tolist() == [0, 0, -1, 1, 2, 3, -1] and parts == [1, 3, 1, 1]


def test_repeats_do_not_take_the_place_of_others(spark):
    v = np.array([[1.0, 0.0]] * 15 + [[1.0, 0.1 * i] for i in range(1, 8)])
    ids = [0] * 15 + list(range(1, 8))
    df, path = frame(spark, v, ids), scratch_path(spark, "cells")
    C.build(df, path, cells=1)
    asked = spark.createDataFrame([(50, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [i for i, _ in found(C.search(asked, path, 5))[50]] == [0, 1, 2, 3, 4]


def test_recall_measure(spark):
    kind = "query_id long, rank int, item_id long, cosine double"
    exact_ = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 6, 0.8), (2, 1, 7, 0.5)], kind)
    # One as near as the last of the exact two, one not.
    got = spark.createDataFrame([(1, 1, 50, 0.8), (1, 2, 9, 0.7)], kind)
    assert tuple(C.recall(got, exact_).first()) == (2, 3, 1, 1 / 3)
    assert C.recall(got, exact_.limit(0)).select(F.col("recall").isNull()).first()[0]
