"""Neighbours where ids and rows repeat."""

import numpy as np

from curatrix.llm import collision_hashing


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    # One id with as many vectors as all others together.
    rows += [(7, [float(x) for x in rng.standard_normal(8)]) for _ in range(60)]
    once = spark.createDataFrame(rows, "item_id long, vector array<double>")
    df = once.union(once)
    asked = df.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    best = {}
    for q, u in rows:
        for i, v in rows:
            if q % 20 == 0 and i != q:
                score = float(np.dot(u, v))
                best.setdefault(q, {})[i] = max(score, best.get(q, {}).get(i, -1e9))
    got = {}
    for r in collision_hashing.nearest_by_collisions(asked, df, k=20, segment=30).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {q: sorted(b, key=lambda i: -b[i])[:20] for q, b in best.items()}


def test_places_beyond_16_bits():
    vectors = np.random.default_rng(1).standard_normal((70_000, 2))
    held = collision_hashing.Segment(vectors, np.zeros(len(vectors)), 2, 1)
    low, size = np.zeros(2, np.int64), np.full(2, len(vectors))
    assert (held.collisions(low, size) == 2).all()
