"""BM25 over whole corpora for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import tokens
from ..session import BROADCAST_ROWS, fits, lookup_join, salt_of, salts, settle

# Okapi constants; floor is the share of the mean idf given to
# terms whose own idf is negative.
K1, B, FLOOR = 1.5, 0.75, 0.25
# Words of documents and of queries that meet in one task on average at most, and
# the number of tasks that keeps a cluster busy.
CELL_WORDS, BLOCK_WORDS, TASKS = 4_000_000, 4_000_000, 48


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words), cut into words once and spread by id once: the statistics
    and the counts read the same exchange, and every later grouping that
    contains the id reuses its partitioning."""
    words = docs.select(id_col, tokens(F.col(text_col)).alias("words"))
    return words.repartition(F.col(id_col))


def term_counts(words: DataFrame, id_col: str) -> DataFrame:
    """(id, doc_len, term, tf)."""
    return (
        words.select(id_col, F.size("words").alias("doc_len"), F.explode("words").alias("term"))
        .groupBy(id_col, "doc_len", "term")
        .agg(F.count("*").alias("tf"))
    )


def corpus_size(words: DataFrame) -> DataFrame:
    """One row: number of documents and mean length, empty ones included."""
    return words.agg(
        F.count("*").alias("n_docs"),
        F.avg(F.size("words").cast("double")).alias("avg_len"),
    )


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def raw_idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def term_weights(frequency: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) with negative values lifted to FLOOR x the mean."""
    scored = frequency.withColumn("_raw", raw_idf(n_docs, F.col("df")))
    mean = scored.agg(F.avg("_raw")).scalar()
    return scored.select(
        "term",
        "df",
        F.when(F.col("_raw") < 0, mean * F.lit(FLOOR)).otherwise(F.col("_raw")).alias("idf"),
    )


def query_terms(queries: DataFrame, text_col: str) -> DataFrame:
    """(query_id, term, qtf); a repeated query word counts repeatedly."""
    return (
        queries.select("query_id", F.explode(tokens(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str,
    text_col: str,
    query_text: str,
    max_broadcast: int = BROADCAST_ROWS,
    candidates: DataFrame | None = None,
    k: int | None = None,
    digits: int = 9,
) -> DataFrame:
    """(query_id, id, bm25) for every pair sharing a term. Pairs without one
    score 0 and are left to the caller's outer join. With candidates(id) only
    their scores are computed; the statistics still cover all documents.
    With k a query's pairs may be left out that are not among its first k by
    (score of `digits` places, falling, then id).

    The (query, term) table is broadcast while it is small, so postings meet
    it where they lie and the per-document sums need no further shuffle.
    Larger query tables are joined by (term, salt): each query term is copied
    to all salts and postings are spread over them by document. With k no row
    per pair is written there: see first_in_cells."""
    words = tokenised(docs, id_col, text_col)
    size = corpus_size(words)
    n_docs = size.select("n_docs").scalar()
    avg_len = size.select("avg_len").scalar()
    counts = term_counts(words, id_col)
    wanted = query_terms(queries, query_text)
    small = fits(wanted, max_broadcast)
    vocabulary = term_weights(document_frequency(counts), n_docs)
    hint = F.broadcast if small else (lambda x: x)
    weights = vocabulary.join(hint(wanted), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )
    gain = (
        F.col("tf")
        * (K1 + 1)
        / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / avg_len))
    )
    if candidates is not None:
        counts = counts.join(candidates.select(id_col).distinct(), id_col, "left_semi")
    if k is not None and not small:
        return first_in_cells(
            counts.select(id_col, "term", gain.alias("gain")), weights, id_col, k, digits, max_broadcast
        )
    if small:
        hits = counts.join(F.broadcast(weights), "term")
    else:
        spread = counts.withColumn("_salt", salt_of(id_col))
        copies = weights.withColumn(
            "_salt", F.explode(salts())
        )
        hits = spread.join(copies, ["term", "_salt"])
    return hits.groupBy(id_col, "query_id").agg(F.sum(F.col("weight") * gain).alias("bm25"))


def first_in_cells(
    postings: DataFrame, weights: DataFrame, id_col: str, k: int, digits: int, max_broadcast: int
) -> DataFrame:
    """(query_id, id, bm25) of the first k documents of every query in every cell
    of documents, from postings(id, term, gain) and weights(query_id, term,
    weight).

    Words that queries ask for are numbered and the numbers joined to postings
    by (term, salt). Documents are then dealt into cells and queries into blocks,
    and every cell meets every block in one task, which adds up a query's scores
    over its cell and lets its first k out. What is moved is a cell once per block
    and a block once per cell, and no row per pair."""
    postings, weights = settle(postings, "postings"), settle(weights, "weights")
    numbered = settle(
        weights.select("term").distinct().withColumn("_t", F.monotonically_increasing_id()), "numbers"
    )
    held = settle(
        lookup_join(postings, numbered, ["term"], id_col, max_rows=max_broadcast)
        .groupBy(id_col)
        .agg(F.collect_list("_t").alias("_terms"), F.collect_list("gain").alias("_values")),
        "held",
    )
    asked = settle(
        lookup_join(weights, numbered, ["term"], "query_id", max_rows=max_broadcast)
        .groupBy("query_id")
        .agg(F.collect_list("_t").alias("_terms"), F.collect_list("weight").alias("_values")),
        "asked",
    )
    n_held, n_asked = (
        df.agg(F.coalesce(F.sum(F.size("_terms")), F.lit(0))).first()[0] for df in (held, asked)
    )
    cells, blocks = _grid(n_held, n_asked)
    place = lambda column, of: F.pmod(F.xxhash64(column), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = held.withColumn("_cell", place(id_col, cells)).withColumn("_block", each(blocks))
    right = asked.withColumn("_block", place("query_id", blocks)).withColumn("_cell", each(cells))
    # One task per pair of cell and block.
    tasks = cells * blocks
    kinds = dict(held.dtypes) | dict(asked.dtypes)
    schema = f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, bm25 double"
    return (
        left.repartition(tasks, "_cell", "_block")
        .groupBy("_cell", "_block")
        .cogroup(right.repartition(tasks, "_cell", "_block").groupBy("_cell", "_block"))
        .applyInArrow(_first_of_cell(id_col, k, digits), schema)
    )


def _grid(n_held: int, n_asked: int) -> tuple[int, int]:
    """Numbers of cells and blocks that move the fewest words: a cell's are sent
    once per block and a block's once per cell."""
    cells, blocks = -(-n_held // CELL_WORDS) or 1, -(-n_asked // BLOCK_WORDS) or 1
    tasks = max(TASKS, cells * blocks)
    blocks = max(blocks, min(tasks, round((tasks * n_asked / max(n_held, 1)) ** 0.5)))
    return max(cells, -(-tasks // blocks)), blocks


def _ragged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and values of all rows, and where each row's begin and end."""
    terms, values = (rows.column(c).combine_chunks() for c in ("_terms", "_values"))
    sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return terms.flatten().to_numpy(), values.flatten().to_numpy(), at


def _first_of_cell(id_col: str, k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(held: pa.Table, asked: pa.Table) -> pa.Table:
        # In the order of ids, null first: of equal scores the first place wins.
        held = held.take(pc.sort_indices(held, [(id_col, "ascending")], null_placement="at_start"))
        found = list(_first(held, asked, k, digits)) if held.num_rows and asked.num_rows else []
        docs, queries, scores = (
            np.concatenate(x) if found else np.zeros(0, dtype=t)
            for x, t in zip(zip(*found) if found else ((), (), ()), (np.int64, np.int64, np.float64))
        )
        return pa.table({
            "query_id": asked.column("query_id").take(pa.array(queries)),
            id_col: held.column(id_col).take(pa.array(docs)),
            "bm25": pa.array(scores),
        })

    return work


def _first(
    held: pa.Table, asked: pa.Table, k: int, digits: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of documents, place of the query repeated, scores) per query."""
    terms, gains, at = _ragged(held)
    docs = np.repeat(np.arange(held.num_rows), np.diff(at))
    order = np.argsort(terms, kind="stable")
    terms, gains, docs = terms[order], gains[order], docs[order]
    known, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))
    wanted, weights, of = _ragged(asked)
    slot = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    here = known[slot] == wanted
    for q in range(asked.num_rows):
        own = np.flatnonzero(here[of[q] : of[q + 1]]) + of[q]
        if not len(own):
            continue
        posted = [slice(starts[i], ends[i]) for i in slot[own]]
        at_docs = np.concatenate([docs[p] for p in posted])
        added = np.concatenate([w * gains[p] for w, p in zip(weights[own], posted, strict=True)])
        scores = np.bincount(at_docs, added, held.num_rows)
        met = np.zeros(held.num_rows, dtype=bool)
        met[at_docs] = True
        places = np.flatnonzero(met)
        shown = np.round(scores[places], digits)
        if len(places) > k:
            edge = np.partition(shown, len(shown) - k)[len(shown) - k]
            near = np.flatnonzero(shown >= edge)
            near = near[np.lexsort((near, -shown[near]))][:k]
            places = places[near]
        yield places, np.full(len(places), q), scores[places]
