"""Profiles of batches against the profile of the whole."""

import random

import pytest

from curatrix.operators import profile_state as P
from curatrix.session import scratch_path

ROWS = "id long, name string, score double, tags array<string>, `odd ``name` int"


def rows_of(n, seed):
    rng = random.Random(seed)
    return [
        (
            i, rng.choice([None, "", "ä", f"n{rng.randrange(500)}"]),
            rng.choice([None, float("nan"), rng.gauss(10, 3)]), rng.choice([None, [], ["x", None]]), i % 7,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("cuts", [1, 4])
def test_union_of_batches_equals_the_whole(spark, cuts):
    rows, path = rows_of(4000, 1), scratch_path(spark, "profile")
    for b in range(cuts):
        part = spark.createDataFrame(rows[b::cuts], ROWS)
        for _ in range(2):
            # A batch put again replaces itself.
            P.put_profile(part, path, b)
    got = {r.column: r for r in P.read_profile(spark, path).collect()}
    assert set(got) == {"id", "name", "score", "tags", "odd `name"}
    assert all(r.n_rows == 4000 for r in got.values())
    scores = sorted(r[2] for r in rows if r[2] is not None and r[2] == r[2])
    s = got["score"]
    assert s.missing == sum(r[2] is None for r in rows)
    assert (s.least_number, s.most_number) == (scores[0], scores[-1])
    assert abs(s.mean - sum(scores) / len(scores)) < 1e-9
    for q, v in zip(P.QUANTILES, s.quantiles, strict=True):
        assert abs(sum(x <= v for x in scores) / len(scores) - q) < 0.03
    names = {r[1] for r in rows if r[1] is not None}
    n = got["name"]
    assert n.missing == sum(r[1] is None for r in rows) and n.quantiles is None and n.mean is None
    assert (n.least_text, n.most_text) == (min(names), max(names))
    assert abs(n.distinct - len(names)) < 0.08 * len(names)
    assert got["tags"].distinct == 2 and got["odd `name"].distinct == 7
    assert abs(got["id"].distinct - 4000) < 0.08 * 4000


def test_profile_of_nothing(spark):
    path = scratch_path(spark, "profile")
    assert P.read_profile(spark, path).count() == 0
    P.put_profile(spark.createDataFrame([], ROWS), path, 0)
    assert P.read_profile(spark, path).count() == 0
    P.put_profile(spark.createDataFrame([(1, None, None, None, None)], ROWS), path, 1)
    got = {r.column: r for r in P.read_profile(spark, path).collect()}
    assert got["score"].missing == 1 and got["score"].distinct == 0 and got["score"].quantiles is None
