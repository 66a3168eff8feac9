"""Batches of the stored text index: statistics, blocks and what is opened."""

from curatrix.operators import postings as P
from curatrix.session import scratch_path


def test_blocks_of_dropped_documents_are_not_opened(spark):
    """A second batch replaces every document: the first one's blocks are void."""
    path, none = scratch_path(spark, "index"), None
    old = [(i, none, f"common word draft{i} draft") for i in range(40)]
    new = [(i, f"common word draft{i} draft", f"common word text{i}" if i % 4 else none) for i in range(40)]
    shape = "id long, before string, after string"
    P.put_batch(spark.createDataFrame(old, shape), path, 0, block_docs=4)
    P.put_batch(spark.createDataFrame(new, shape), path, 1, block_docs=4)
    asked = spark.createDataFrame([(7, "draft common")], "query_id long, text string")
    ranking = P.BlockRanking(asked, path, k=40)
    assert {r.batch for r in ranking.bounds.select("batch").distinct().collect()} == {1}
    assert sorted(r.id for r in ranking.top().collect()) == [i for i in range(40) if i % 4]
    # What stands before and after a change is not counted twice.
    terms = {r.term: r.df for r in P.document_frequency(spark, path).collect()}
    assert terms == {"common": 30, "word": 30} | {f"text{i}": 1 for i in range(40) if i % 4}
    stored = spark.read.parquet(f"{path}/terms/batch=1").collect()
    assert {r.term: r.df for r in stored if r.df > 0} == {f"text{i}": 1 for i in range(40) if i % 4}


def test_repeated_rows_of_a_batch_count_together(spark):
    path = scratch_path(spark, "index")
    rows = [(1, None, "b a b"), (1, None, "b a b"), (1, None, "a"), (None, None, "a"), (2, None, "")]
    P.put_batch(spark.createDataFrame(rows, "id long, before string, after string"), path, 0, block_docs=100)
    held = {r.term: (r.max_tf, r.min_len, [tuple(h) for h in r.held]) for r in P.read_part(spark, path, "postings").collect()}
    assert held == {"a": (2, 1, [(None, 1, 1), (1, 1, 1), (1, 2, 3)]), "b": (4, 3, [(1, 4, 3)])}
