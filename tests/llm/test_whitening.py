"""Whitening of catalogue vectors against plain linear algebra and whole numbers."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import queries, whitening

SF = "/root/testdata/sf0.01"
ROWS = "item_id long, vector array<double>, n string, `_x` string"


def stored(spark, vectors):
    return spark.createDataFrame([(i, v, "n", "x") for i, v in enumerate(vectors)], ROWS)


def grid(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def plain(usable):
    """(n, sums, values, vectors) of the distinct grid rows."""
    fit = np.array(sorted({grid(v) for v in usable}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    y = (fit - np.array([s // n for s in sums])) - np.array([(s % n) / n for s in sums])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1], vectors[:, ::-1]


def check(rows, usable, components=16):
    n, sums, values, vectors = plain(usable)
    held = min(components, len(values))
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    signs = np.zeros(held)
    for i, v in enumerate(usable):
        x = grid(v)
        own = sorted(by_id[i], key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(1, held + 1))
        assert {r[2] for r in own} == {n}
        assert {int(r[3]) for r in own} == {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))}
        centred = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        want = centred @ vectors[:, :held] / np.sqrt(values[:held])
        got = np.array([r[4] for r in own])
        signs = np.where((signs == 0) & (np.abs(want) > 1e-6), np.sign(want * got), signs)
        assert np.allclose(got, want * np.where(signs == 0, 1, signs), atol=1e-7)
        assert np.allclose([r[5] for r in own], values[:held] / values.sum(), rtol=1e-9)
        assert max(r[6] for r in own) < 1e-9


def test_query_equals_plain_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    place = {r.vec_id: i for i, r in enumerate(table)}
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF)
    assert got.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    assert dict(got.dtypes)["deviation"] == "bigint"
    check([(place[r[0]], *r[1:]) for r in got.collect()], [r.embedding for r in table])


@pytest.mark.parametrize("size", [1, 2, 7, 30])
def test_components_of_random_scatters(size):
    rng = np.random.default_rng(size)
    y = rng.normal(size=(4 * size, size)) * np.exp(rng.normal(size=size))
    values, units = whitening.components_of(y.T @ y, len(y))
    want = np.linalg.eigvalsh(y.T @ y / len(y))[::-1]
    assert np.allclose(values, want, rtol=1e-9)
    assert np.allclose(units.T @ units, np.eye(len(values)), atol=1e-12)
    assert np.allclose((units * values) @ units.T, y.T @ y / len(y), rtol=1e-10, atol=1e-12 * values[0])


def test_factor_is_triangular_and_whole():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(40, 9))
    a = y.T @ y
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(np.triu(factor, 1), 0)
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)])
    assert all(x >= y for x, y in zip(np.diag(factor), np.diag(factor)[1:], strict=False))


def test_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(30, 3)).tolist()
    # The fourth entry repeats the first: three directions have variance.
    good = [[*v, v[0]] for v in good]
    bad = [None, [], [1.0, None, 2.0, 1.0], [math.nan, 1.0, 1.0, 1.0], [math.inf, 0.0, 0.0, 0.0],
           [1e300, 0.0, 0.0, 0.0], [1.0, 2.0], [0.5] * 9]
    df = stored(spark, good + bad).unionByName(stored(spark, good[:7]))
    rows = whitening.whiten_vectors(df).collect()
    n, _, values, _ = plain(good)
    assert {r.component for r in rows} == {1, 2, 3} and {r.n for r in rows} == {n} == {30}
    assert len(rows) == 3 * 37
    assert {r.item_id for r in rows} == set(range(30))
    assert max(r.identity_error for r in rows) < 1e-9
    shares = sorted({r.explained for r in rows}, reverse=True)
    assert np.allclose(shares, values[:3] / values.sum())
    # Projections of blocks of other sizes may differ in the last place.
    assert len({(r.item_id, r.component, r.deviation, round(r.whitened, 9)) for r in rows}) == 3 * 30


def test_tables_without_components(spark):
    assert whitening.whiten_vectors(stored(spark, [])).count() == 0
    assert whitening.whiten_vectors(stored(spark, [None, []])).count() == 0
    same = stored(spark, [[0.25, 0.5]] * 4)
    assert whitening.whiten_vectors(same).columns == [
        "item_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    assert whitening.whiten_vectors(same).count() == 0


def test_two_distinct_vectors_among_many_copies(spark):
    df = stored(spark, [[0.0, 1.0]] * 50 + [[0.5, 1.0]])
    rows = whitening.whiten_vectors(df).collect()
    assert len(rows) == 51 and {r.n for r in rows} == {2}
    assert {round(abs(r.whitened), 9) for r in rows} == {1.0}
    # n x - S is 32 in amount either way.
    assert {int(r.deviation) for r in rows} == {1024}


def test_deviation_of_wide_values_is_exact(spark):
    wide = [[1e15, 3.0], [-1e15, 5.0], [7e12, 1.0]]
    rows = whitening.whiten_vectors(stored(spark, wide)).collect()
    n, sums, *_ = plain(wide)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(grid(v), sums, strict=True)) for i, v in enumerate(wide)}
    got = {r.item_id: r.deviation for r in rows}
    assert got == {i: Decimal(w) for i, w in want.items()}


def test_vector_column_of_floats_and_other_names(spark):
    df = stored(spark, np.random.default_rng(1).normal(size=(20, 5)).tolist()).select(
        F.col("vector").cast("array<float>").alias("item vector"), F.col("item_id").alias("vec`id")
    )
    rows = whitening.whiten_vectors(df, key="vec`id", vector="item vector", components=2).collect()
    assert len(rows) == 40 and set(rows[0].asDict()) >= {"vec`id", "whitened"}
