"""The commit log of stores, and the stored text index."""

import random
import time

import pytest
from pyspark.sql import functions as F

from curatrix.operators import bm25 as B, postings as P
from curatrix.operators.grouping import top_k
from curatrix.session import scratch_path
from curatrix.sources import sinks
from curatrix.sources.commits import WHOLE, CommitLog, Conflict

ROWS = "user string, ts long"


def newest(rows):
    return rows.groupBy("user", "_bucket").agg(F.max("ts").alias("ts"))


def state(spark, table):
    return {r.user: r.ts for r in sinks.read_buckets(spark, table).collect()}


# --- commit log --------------------------------------------------------------
def test_clocks_running_backwards(spark, monkeypatch):
    table = scratch_path(spark, "table")
    now = iter(range(10**6, 0, -1))
    monkeypatch.setattr(time, "time", lambda: float(next(now)))
    for ts in (1, 2, 3):
        sinks.merge_buckets(spark.createDataFrame([("a", ts)], ROWS), table, ["user"], 4, newest)
    assert state(spark, table) == {"a": 3}
    whole = scratch_path(spark, "whole")
    for ts in (1, 2, 3):
        sinks.new_version(spark.createDataFrame([("a", ts)], ROWS), whole)
    assert sinks.read_current(spark, whole).first().ts == 3


def test_two_writers_of_one_bucket(spark):
    """A second writer commits while the first one merges: the first one's
    merge is done again, and both are in the table."""
    table = scratch_path(spark, "table")
    sinks.merge_buckets(spark.createDataFrame([("a", 1)], ROWS), table, ["user"], 1, newest)
    merges = []

    def slow(rows):
        merges.append(1)
        if len(merges) == 1:
            other = spark.createDataFrame([("b", 5)], ROWS)
            sinks.merge_buckets(other, table, ["user"], 1, newest)
        return newest(rows)

    sinks.merge_buckets(spark.createDataFrame([("c", 7)], ROWS), table, ["user"], 1, slow)
    assert len(merges) == 2
    assert state(spark, table) == {"a": 1, "b": 5, "c": 7}
    assert CommitLog(spark, table).numbers() == [1, 2, 3]


def test_two_writers_of_different_buckets_do_not_wait(spark):
    log = CommitLog(spark, scratch_path(spark, "table"))
    assert log.commit(0, "version=x", ["1"]) == 1
    assert log.commit(0, "version=y", ["2"]) == 2
    with pytest.raises(Conflict):
        log.commit(0, "version=z", ["2", "3"])
    assert log.state() == (2, {"1": "version=x", "2": "version=y"})
    assert log.commit(2, "version=z", ["2", "3"]) == 3
    assert log.state() == (3, {"1": "version=x", "2": "version=z", "3": "version=z"})


def test_version_derived_from_an_old_state_is_refused(spark):
    table = scratch_path(spark, "table")
    rows = lambda ts: spark.createDataFrame([("a", ts)], ROWS)
    sinks.new_version(rows(1), table)
    base, parts = CommitLog(spark, table).state()
    assert list(parts) == [WHOLE]
    sinks.new_version(rows(2), table)
    with pytest.raises(Conflict):
        sinks.new_version(rows(3), table, base)
    assert sinks.read_current(spark, table).first().ts == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, scratch_path(spark, "none"))


def test_a_bucket_may_become_empty(spark):
    table = scratch_path(spark, "table")
    sinks.merge_buckets(spark.createDataFrame([("a", 1)], ROWS), table, ["user"], 1, newest)
    none = lambda rows: newest(rows).where("ts < 0")
    sinks.merge_buckets(spark.createDataFrame([("a", 2)], ROWS), table, ["user"], 1, none)
    assert sinks.read_buckets(spark, table) is None
    sinks.merge_buckets(spark.createDataFrame([("a", 3)], ROWS), table, ["user"], 1, newest)
    assert state(spark, table) == {"a": 3}
    assert sinks.read_buckets(spark, scratch_path(spark, "none")) is None


def test_merge_lists_only_touched_folders(spark):
    table = scratch_path(spark, "table")
    first = spark.createDataFrame([(f"u{i}", i) for i in range(40)], ROWS)
    sinks.merge_buckets(first, table, ["user"], 16, newest)
    read = []

    def watch(rows):
        read.append(set(rows.inputFiles()))
        return newest(rows)

    sinks.merge_buckets(spark.createDataFrame([("u3", 99)], ROWS), table, ["user"], 16, watch)
    assert len({f.rsplit("/", 2)[1] for f in read[0]}) == 1
    assert state(spark, table)["u3"] == 99 and len(state(spark, table)) == 40


# --- stored text index -------------------------------------------------------
WORDS = [f"w{i}" for i in range(60)]


def random_text(rng):
    if rng.random() < 0.1:
        return rng.choice([None, "", " ,. "])
    # Low numbers are frequent, high ones rare.
    return " ".join(WORDS[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(1, 30)))


def changes_of(spark, rows):
    return spark.createDataFrame(rows, "id long, before string, after string")


def best_of(spark, texts, queries, k):
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    scores = B.bm25_scores(docs, queries, "id", "text", "text")
    top = top_k(scores, ["query_id"], [F.round("bm25", 9).desc(), F.asc("id")], k)
    return sorted((r.query_id, r.rank, r.id, round(r.bm25, 9)) for r in top.collect())


def found(frame):
    return sorted((r.query_id, r.rank, r.id, round(r.bm25, 9)) for r in frame.collect())


@pytest.mark.parametrize("k,probe", [(1, 1), (5, 2), (1000, 3)])
def test_ranks_after_changes_equal_those_of_all_documents(spark, k, probe):
    rng = random.Random(k)
    path = scratch_path(spark, "index")
    texts, rows = {}, []
    for i in range(300):
        texts[i] = random_text(rng) or ""
        rows.append((i, None, texts[i]))
    P.put_batch(changes_of(spark, rows), path, 0, block_docs=10, buckets=3)
    rows = []
    for i in range(0, 300, 3):
        after = None if i % 2 else random_text(rng) or ""
        rows.append((i, texts.pop(i), after))
        if after is not None:
            texts[i] = after
    rows += [(1000 + i, None, "w1 w50 new") for i in range(5)]
    texts |= {1000 + i: "w1 w50 new" for i in range(5)}
    for _ in range(2):
        # Put again, a batch replaces itself.
        P.put_batch(changes_of(spark, rows), path, 1, block_docs=10, buckets=3)
    queries = spark.createDataFrame(
        [(1, "w0 w1"), (2, "w50 w58 w3"), (3, "w20 w20 w21"), (4, "none of these"), (5, None), (6, "new w0")],
        "query_id long, text string",
    )
    ranking = P.BlockRanking(queries, path, k=k, probe=probe)
    assert found(ranking.top()) == best_of(spark, texts, queries, k)
    plain = spark.createDataFrame(list(texts.items()), "id long, text string")
    words = B.tokenised(plain, "id", "text")
    want = {r.term: r.df for r in B.document_frequency(B.term_counts(words, "id")).collect()}
    assert {r.term: r.df for r in P.document_frequency(spark, path).collect()} == want
    size, again = P.corpus_size(spark, path).first(), B.corpus_size(words).first()
    assert size.n_docs == again.n_docs and abs(size.avg_len - again.avg_len) < 1e-12


def test_blocks_that_cannot_win_are_not_opened(spark):
    rng = random.Random(1)
    path = scratch_path(spark, "index")
    rows = [(i, None, " ".join(rng.choices(WORDS[:20], k=20))) for i in range(600)]
    rows += [(1000 + i, None, "rare rare rare w1") for i in range(3)]
    P.put_batch(changes_of(spark, rows), path, 0, block_docs=10)
    queries = spark.createDataFrame([(1, "rare w1"), (2, "w1 w2")], "query_id long, text string")
    ranking = P.BlockRanking(queries, path, k=3, probe=2)
    read = {r.query_id: (r.blocks, r.read) for r in ranking.report().collect()}
    assert read[1][0] > 40 and read[1][1] <= 6
    assert read[2][1] <= read[2][0]
    texts = {i: t for i, _, t in rows}
    assert found(ranking.top()) == best_of(spark, texts, queries, 3)


def test_index_of_nothing(spark):
    path = scratch_path(spark, "index")
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert P.rank_documents(queries, path).count() == 0
    P.put_batch(changes_of(spark, []), path, 0)
    assert P.rank_documents(queries, path).count() == 0
    P.put_batch(changes_of(spark, [(1, None, "a b")]), path, 1)
    assert found(P.rank_documents(queries.limit(0), path)) == []
    assert [r[2] for r in found(P.rank_documents(queries, path))] == [1]
    P.put_batch(changes_of(spark, [(1, "a b", None)]), path, 2)
    assert P.rank_documents(queries, path).count() == 0
    assert P.document_frequency(spark, path).count() == 0


def test_postings_of_a_block_lie_together(spark):
    """Texts are dealt once, by block, and postings are not moved again: neither
    when they are stored nor when they are scored."""
    path = scratch_path(spark, "index")
    rows = [(i, None, " ".join(WORDS[(i * j) % 60] for j in range(1, 12))) for i in range(200)]
    P.put_batch(changes_of(spark, rows), path, 0, block_docs=10)
    held = P.read_part(spark, path, "postings").select("block", F.input_file_name().alias("f"))
    assert held.distinct().count() == held.select("block").distinct().count() > 10
    queries = spark.createDataFrame([(1, "w1 w2"), (2, "w50 w8")], "query_id long, text string")
    ranking = P.BlockRanking(queries, path, k=3, probe=2)
    for limit in (P.SENT_PAIRS, 0):
        P.SENT_PAIRS, kept = limit, P.SENT_PAIRS
        try:
            scores = ranking._scores(ranking.bounds.select("query_id", "batch", "block"))
            plan = scores._jdf.queryExecution().optimizedPlan().toString()
            assert ("array_contains" in plan) == (limit > 0)
            if limit:
                sent = sorted(scores.collect())
            else:
                assert [r[:2] for r in sorted(scores.collect())] == [r[:2] for r in sent]
        finally:
            P.SENT_PAIRS = kept
