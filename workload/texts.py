"""Tokens, corpus statistics, BM25, vectors as text-free scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import scores as S
from curatrix.functions.text import tokens
from curatrix.operators import bm25 as B, cell_index as C, postings as P
from curatrix.operators.grouping import top_k
from curatrix.operators.vectors import nearest
from curatrix.session import scratch_path
from curatrix.sources.delimited import spread

from . import query
from .fixtures import cte, items, table, vectors

_SPLIT = r"[^\p{L}\p{M}\p{N}_]+"


def toks(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{_SPLIT}'), "
        "lambda w: w <> '')"
    )


def bm25_ctes(docs: str, asked: str) -> str:
    """CTEs from docs(id, text) and asked(query_id, text) to bm25(query_id,
    id, score)."""
    return f"""
  b_tok as materialized (select id, {toks('text')} as t from {docs}),
  b_size as materialized (select count(*) as n_docs, avg(len(t)) as avg_len from b_tok),
  b_tf as materialized (select id, len, term, count(*) as tf from (select id, len(t) as len,
    unnest(t) as term from b_tok) group by id, len, term),
  b_df as materialized (select term, count(*) as df from b_tf group by term),
  b_raw as materialized (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as raw
    from b_df cross join b_size),
  b_mean as materialized (select avg(raw) as mean from b_raw),
  b_idf as materialized (select term, df, case when raw < 0 then 0.25 * mean else raw end as idf
    from b_raw cross join b_mean),
  b_q as (select query_id, term, count(*) as qtf from (select query_id,
    unnest({toks('text')}) as term from {asked}) group by query_id, term),
  bm25 as (select q.query_id, f.id, sum(q.qtf * i.idf * f.tf * 2.5
      / (f.tf + 1.5 * (0.25 + 0.75 * f.len / s.avg_len))) as score
    from b_q q join b_tf f on f.term = q.term join b_idf i on i.term = q.term, b_size s
    group by q.query_id, f.id)
"""


def _docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "f19_tokenise",
    f"""select doc_id, len(t) as n, len(list_distinct(t)) as uniq,
        md5(array_to_string(t, ' ')) as digest
        from (select doc_id, {toks('text')} as t from documents)""",
)
def f19(spark, sf):
    t = _docs(spark, sf).select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n"),
        F.size(F.array_distinct("t")).cast("bigint").alias("uniq"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


_CORPUS = "with d as (select doc_id as id, text from documents), "


_A24 = (
    _CORPUS + bm25_ctes("d", "(select item_id as query_id, text from benchmark)")
    + """select term, df, round(idf, 6) as idf, n_docs, round(avg_len, 6) as avg_len
         from b_idf cross join b_size"""
)


@query("a24_corpus_statistics", _A24)
def a24(spark, sf):
    docs = _docs(spark, sf)
    words = B.tokenised(docs, "doc_id", "text")
    size = B.corpus_size(words)
    freq = B.document_frequency(B.term_counts(words, "doc_id"))
    weights = B.term_weights(freq, size.select("n_docs").scalar())
    return _statistics(weights, size)


def _statistics(weights, size):
    return weights.select(
        "term",
        "df",
        F.round("idf", 6).alias("idf"),
        size.select("n_docs").scalar().alias("n_docs"),
        F.round(size.select("avg_len").scalar(), 6).alias("avg_len"),
    )


@query("a24_statistics_after_changes", _A24)
def a24_changed(spark, sf):
    """Sums of signed changes equal the statistics of the documents as they are."""
    index = _changed_index(spark, sf)
    return _statistics(P.corpus_weights(spark, index), P.corpus_size(spark, index))


def _benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BM25 = _CORPUS + bm25_ctes("d", "(select item_id as query_id, text from benchmark)")


@query(
    "j15_bm25_scores",
    _BM25 + "select query_id, id as doc_id, round(score, 6) as score from bm25",
)
def j15(spark, sf):
    s = B.bm25_scores(_docs(spark, sf), _benchmark(spark, sf), "doc_id", "text", "text")
    return s.select("query_id", "doc_id", F.round("bm25", 6).alias("score"))


_TOP5 = (
    _BM25 + """select query_id, id as doc_id, rank, round(score, 6) as score from (select *,
      row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
      from bm25) where rank <= 5"""
)


def _ranked(spark, sf, index):
    top = P.rank_documents(_benchmark(spark, sf), index, k=5)
    return top.select(
        "query_id", F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("score")
    )


@query("j15_bm25_top5", _TOP5)
def j15_top(spark, sf):
    """Ranks read from a stored index of all documents."""
    index = scratch_path(spark, "index")
    docs = _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("before"),
        F.coalesce("text", F.lit("")).alias("after"),
    )
    P.put_batch(docs, index, 0)
    return _ranked(spark, sf, index)


def _changed_index(spark, sf):
    """An index that came about by changes: drafts of all documents and all
    pages come first; then every draft is replaced and every page removed."""
    index = scratch_path(spark, "index")
    null = F.lit(None).cast("string")
    docs = _docs(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" first draft of the text")).alias("draft"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    pages = table(spark, sf, "pages").select(
        (-F.col("page_id") - 1).cast("long").alias("id"), F.coalesce("html", F.lit("")).alias("draft"),
        null.alias("text"),
    )
    both = docs.unionByName(pages)
    P.put_batch(both.select("id", null.alias("before"), F.col("draft").alias("after")), index, 0)
    P.put_batch(both.select("id", F.col("draft").alias("before"), F.col("text").alias("after")), index, 1)
    return index


@query("j15_top5_after_changes", _TOP5)
def j15_changed(spark, sf):
    return _ranked(spark, sf, _changed_index(spark, sf))


@query(
    "j15_bm25_salted_join",
    "with d as (select page_id as id, html as text from pages), "
    + bm25_ctes(
        "d", "(select conv_id * 1000 + turn as query_id, text from conversations)"
    )
    + """select query_id, id as page_id, rank, round(score, 6) as score from (select *,
      row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
      from bm25) where rank <= 5""",
)
def j15_salted(spark, sf):
    """The form for query tables too large to broadcast."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    asked = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"
    )
    s = B.bm25_scores(pages, asked, "page_id", "text", "text", max_broadcast=0, k=5)
    top = top_k(s, ["query_id"], [F.round("bm25", 9).desc(), F.asc("page_id")], 5)
    return top.select("query_id", "page_id", "rank", F.round("bm25", 6).alias("score"))


# --- vectors ---------------------------------------------------------------
_UNIT = """unit as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)
    / greatest(sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double)
    * cast(y as double)))), 1e-12)) as v from embeddings)"""


@query(
    "f20_unit_vectors",
    f"""with {_UNIT} select vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 9)
        as norm, round(v[1], 9) as head, round(v[64], 9) as tail from unit""",
)
def f20(spark, sf):
    v = S.l2_normalise(F.col("embedding"))
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return e.select(
        "vec_id",
        F.round(norm, 9).alias("norm"),
        F.round(F.get("v", 0), 9).alias("head"),
        F.round(F.get("v", 63), 9).alias("tail"),
    )


@query(
    "f21_pairwise_cosine",
    f"""with {_UNIT} select a.vec_id, round(greatest(-1.0, least(1.0,
        list_dot_product(a.v, b.v))), 9) as cosine from unit a join unit b
        on b.vec_id = a.vec_id + 1""",
)
def f21(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", S.l2_normalise(F.col("embedding")).alias("v")
    )
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(other, "vec_id").select(
        "vec_id", F.round(S.dot(F.col("v"), F.col("w")), 9).alias("cosine")
    )


def _knn_sql(k: int) -> str:
    return f"""with {_UNIT} select query_id, item_id, rank, round(cosine, 6) as cosine from (
      select a.vec_id as query_id, b.vec_id as item_id, list_dot_product(a.v, b.v) as cosine,
        row_number() over (partition by a.vec_id order by list_dot_product(a.v, b.v) desc,
        b.vec_id) as rank from unit a join unit b on a.vec_id <> b.vec_id) where rank <= {k}"""


@query("j13_nearest_neighbours", _knn_sql(10))
def j13(spark, sf):
    v = vectors(spark, sf)
    found = nearest(v.withColumnRenamed("item_id", "query_id"), v, 10, skip_self=True)
    return found.select("query_id", "item_id", "rank", F.round("cosine", 6).alias("cosine"))


@query("j13_nearest_in_blocks", _knn_sql(5))
def j13_blocks(spark, sf):
    """The form for query tables that do not fit a task: blocks that all items pass."""
    from curatrix.operators import vectors as V

    v = vectors(spark, sf)
    asked = v.withColumnRenamed("item_id", "query_id")
    found = V.nearest(asked, v, 5, True, query_block=100, item_block=100)
    return found.select("query_id", "item_id", "rank", F.round("cosine", 6).alias("cosine"))


@query(
    "j13_recall_of_cells",
    f"""select count(distinct query_id) as queries, count(*) as wanted, true as reached
      from ({_knn_sql(10)})""",
)
def j13_cells(spark, sf):
    """Neighbours of all items from a cell index against the exact ones: the
    index holds two thirds of the vectors at first and the rest is added."""
    v, path = vectors(spark, sf), scratch_path(spark, "cells")
    late = F.pmod("item_id", F.lit(3)) == 2
    C.build(v.where(~late), path)
    C.add(v.where(late), path, 1)
    asked = v.withColumnRenamed("item_id", "query_id")
    found = C.search(asked, path, 10, skip_self=True)
    measured = C.recall(found, nearest(asked, v, 10, skip_self=True))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


@query(
    "j14_missing_vector_is_zero",
    cte("items")
    + f""", {_UNIT} select i.item_id, round(coalesce(list_dot_product(a.v, b.v), 0), 6) as cosine
      from items i left join unit a on a.vec_id = i.item_id
      left join unit b on b.vec_id = i.item_id + 3""",
)
def j14(spark, sf):
    v = vectors(spark, sf)
    shifted = v.select((F.col("item_id") - 3).alias("item_id"), F.col("vector").alias("w"))
    rows = items(spark, sf).select("item_id").join(v, "item_id", "left").join(
        shifted, "item_id", "left"
    )
    cos = S.dot(S.l2_normalise(F.col("vector")), S.l2_normalise(F.col("w")))
    return rows.select("item_id", F.round(F.coalesce(cos, F.lit(0.0)), 6).alias("cosine"))
