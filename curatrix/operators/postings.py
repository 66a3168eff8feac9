"""A stored text index: postings in blocks with bounds, and statistics that can
be taken back.

A batch of changes(id, before, after) is one number. It adds
- `terms` and `size`: signed changes of document frequency, of the number of
  documents and of their length, so that a change or removal of a document takes
  back what it had added; the statistics in force are their sums;
- `postings`: the documents as they are after it, dealt into blocks. A row is a
  term's postings in one block, with its largest count and its least document
  length, from which follows the largest gain that the term can bring there
  whatever the mean length has become;
- `dropped`: documents that were there before, whose older postings are void;
- `members`: the documents of every block, so that a block of void postings alone
  is never opened.

A document lies whole in one block, so the sum of a query's largest gains in a
block bounds every score in it. Ranking reads these bounds first, scores each
query's most promising blocks, and then only blocks that can still beat the k-th
score found: postings of other blocks are never opened."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import tokens
from ..session import fits, growing, settle
from .bm25 import B, K1, query_terms, term_weights
from .grouping import top_k

# Documents of a block, blocks scored first per query, least files of a batch's postings.
BLOCK_DOCS, PROBE, BUCKETS = 128, 8, 32
# Pairs of query and block that may be sent to the postings.
SENT_PAIRS = 4_000_000
# Batches that a reading of postings names one by one.
MOST_BATCHES = 1000
# Scores closer than this count as equal when a block is left out.
NEAR = 1e-6
PARTS = {
    "terms": "term string, df long",
    "size": "docs long, length long",
    "postings": "term string, block int, max_tf int, min_len int, "
    "held array<struct<id:{id},tf:int,len:int>>",
    "dropped": "id {id}",
    "members": "id {id}, block int",
}


def _changed_counts(changes: DataFrame) -> DataFrame:
    """(term, df, docs, length): the change of each term's document frequency,
    and in the row of the null term the change of the number of documents and of
    their length. Texts are cut into words once; a null text counts as no document,
    and a word that stands in a document before and after it changes nothing."""
    none = F.array().cast("array<string>")
    words = lambda c: F.when(F.col(c).isNotNull(), tokens(F.col(c)))
    cut = changes.select(words("before").alias("old"), words("after").alias("new"))
    held = lambda c: F.coalesce(F.col(c), none)
    sides = F.array(
        F.array_except(held("new"), held("old")),
        F.array_except(held("old"), held("new")),
        F.array(F.lit(None).cast("string")),
    )
    each = cut.select(
        (F.col("new").isNotNull().cast("long") - F.col("old").isNotNull().cast("long")).alias("docs"),
        (F.size(held("new")) - F.size(held("old"))).cast("long").alias("length"),
        F.posexplode(sides).alias("side", "terms"),
    ).select("docs", "length", "side", F.explode("terms").alias("term"))
    of = lambda c: F.sum(F.when(F.col("side") == 2, F.col(c)).otherwise(0)).alias(c)
    sign = F.when(F.col("side") == 0, 1).when(F.col("side") == 1, -1).otherwise(0)
    return each.groupBy("term").agg(F.sum(sign).cast("long").alias("df"), of("docs"), of("length"))


def _postings_of_block() -> Callable[[pa.Table], pa.Table]:
    """From (block, id, words) of the documents of a block to its postings, one
    row per term; rows of equal id and length count as one document."""

    def work(rows: pa.Table) -> pa.Table:
        words = rows.column("words").combine_chunks()
        sizes = words.value_lengths().to_numpy()
        # Documents by id, null first, as a sorted array of postings has them.
        ids = rows.column("id").combine_chunks()
        by_id = pc.sort_indices(pa.table({"id": ids}), [("id", "ascending")], null_placement="at_start")
        place: dict = {}
        rank = np.empty(len(ids), dtype=np.int64)
        for at, own in zip(by_id.to_pylist(), ids.take(by_id).to_pylist(), strict=True):
            rank[at] = place.setdefault(own, len(place))
        docs, first, doc = np.unique(
            np.stack([rank, sizes], axis=1), axis=0, return_index=True, return_inverse=True
        )
        coded = words.flatten().dictionary_encode()
        term = coded.indices.to_numpy().astype(np.int64)
        met, tf = np.unique(term * len(docs) + np.repeat(doc.reshape(-1), sizes), return_counts=True)
        term, own = np.divmod(met, max(1, len(docs)))
        order = np.lexsort((docs[own, 1], tf, docs[own, 0], term))
        term, own, tf = term[order], own[order], tf[order].astype(np.int32)
        length = docs[own, 1].astype(np.int32)
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        least = lambda f, v: f.reduceat(v, starts) if len(v) else v
        held = pa.ListArray.from_arrays(
            pa.array(np.append(starts, len(term)).astype(np.int32)),
            pa.StructArray.from_arrays(
                [ids.take(pa.array(first[own])), pa.array(tf), pa.array(length)], names=["id", "tf", "len"]
            ),
        )
        block = rows.column("block")[0].as_py()
        return pa.table({
            "term": coded.dictionary.take(pa.array(term[starts])),
            "block": np.full(len(starts), block, np.int32),
            "max_tf": least(np.maximum, tf),
            "min_len": least(np.minimum, length),
            "held": held,
        })

    return work


def put_batch(
    changes: DataFrame, path: str, batch: int, block_docs: int = BLOCK_DOCS, buckets: int = BUCKETS
) -> None:
    """Store one batch of changes(id, before, after): before is null for a new
    document, after for a removed one. A batch put again replaces itself, so a
    retry is harmless; batches are numbered in the order of the changes, and an
    id stands in a batch once."""
    held = settle(changes.select("id", "before", "after"), "changes")
    blocks = -(-held.count() // block_docs) or 1
    files = max(buckets, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Texts are dealt by block once; what follows is counted where they lie.
    dealt = (
        held.where("after is not null")
        .select("id", "after", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        .repartition(files, "block")
        .sortWithinPartitions("block")
    )
    kind = dict(held.dtypes)["id"]
    postings = (
        dealt.select("block", "id", tokens(F.col("after")).alias("words"))
        .groupBy("block")
        .applyInArrow(_postings_of_block(), PARTS["postings"].format(id=kind))
        .sortWithinPartitions("term", "block")
    )
    changed = settle(_changed_counts(held), "counts")
    terms = changed.where("term is not null and df != 0").select("term", "df")
    zero = F.lit(0).cast("long")
    size = changed.where("term is null").agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in ("docs", "length")]
    )
    dropped = held.where("before is not null").select("id")
    members = dealt.select("id", "block")
    # The postings go last: a batch without them brings nothing to be ranked.
    dropped = held.where("before is not null").select("id")
    parts = {"terms": terms, "size": size, "dropped": dropped, "members": members, "postings": postings}
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read_part(spark: SparkSession, path: str, name: str, id_type: str = "long") -> DataFrame:
    """One part of an index over all batches, with their `batch`."""
    schema = PARTS[name].format(id=id_type) + ", batch long"
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def corpus_size(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_docs, avg_len): statistics after all batches."""
    docs, length = (F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "length"))
    return read_part(spark, path, "size").agg(
        docs.alias("n_docs"), F.try_divide(length.cast("double"), docs).alias("avg_len")
    )


def document_frequency(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) after all batches; terms of no document are left out."""
    summed = read_part(spark, path, "terms").groupBy("term").agg(F.sum("df").alias("df"))
    return summed.where("df > 0")


def corpus_weights(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, idf) after all batches."""
    size = settle(corpus_size(spark, path), "size")
    # Written once: the mean idf and the weights both read it.
    frequency = settle(document_frequency(spark, path), "frequency")
    return term_weights(frequency, size.select("n_docs").scalar())


def gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class BlockRanking:
    """BM25 ranking of queries(query_id, text_col) over the index at `path`."""

    def __init__(
        self, queries: DataFrame, path: str, text_col: str = "text", id_type: str = "long",
        k: int = 10, probe: int = PROBE, digits: int = 9,
    ):
        spark = queries.sparkSession
        self.k, self.probe, self.digits = k, probe, digits
        self.mean = F.lit(corpus_size(spark, path).first()["avg_len"] or 1.0)
        self.postings = read_part(spark, path, "postings", id_type)
        self.dropped = (
            read_part(spark, path, "dropped", id_type).groupBy("id").agg(F.max("batch").alias("void"))
        )
        asked = query_terms(queries, text_col).join(corpus_weights(spark, path), "term")
        self.weights = settle(
            asked.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights"
        )
        # Bounds of blocks: only the narrow columns of the index are read.
        largest = F.greatest("weight", F.lit(0.0)) * gain(F.col("max_tf"), F.col("min_len"), self.mean)
        self.bounds = settle(
            self.postings.select("term", "batch", "block", "max_tf", "min_len")
            .join(self._void_blocks(spark, path, id_type), ["batch", "block"], "left_anti")
            .join(self.weights, "term")
            .groupBy("query_id", "batch", "block")
            .agg(F.sum(largest).alias("bound")),
            "bounds",
        )

    def _void_blocks(self, spark: SparkSession, path: str, id_type: str) -> DataFrame:
        """(batch, block) of which a later batch has dropped every document."""
        live = F.col("void").isNull() | (F.col("batch") >= F.col("void"))
        members = read_part(spark, path, "members", id_type).join(growing(self.dropped), "id", "left")
        return settle(
            members.groupBy("batch", "block").agg(F.max(live).alias("live")).where("not live").drop("live"),
            "void",
        )

    def _postings_of(self, blocks: DataFrame) -> DataFrame:
        """Postings of the batches that the blocks belong to, where these are few."""
        batches = [r["batch"] for r in blocks.select("batch").distinct().limit(MOST_BATCHES + 1).collect()]
        few = len(batches) <= MOST_BATCHES
        return self.postings.where(F.col("batch").isin(batches)) if few else self.postings

    def _scores(self, blocks: DataFrame) -> DataFrame:
        """(query_id, id, bm25) of the documents in (query_id, batch, block)."""
        postings = self._postings_of(blocks)
        if fits(self.weights) and fits(blocks, SENT_PAIRS):
            # Weights and the blocks' queries go to the postings, which stay.
            picked = blocks.groupBy("batch", "block").agg(F.collect_list("query_id").alias("_asked"))
            own = postings.join(F.broadcast(picked), ["batch", "block"])
            met = own.join(F.broadcast(self.weights), "term").where(F.array_contains("_asked", F.col("query_id")))
        else:
            wanted = blocks.join(self.weights, "query_id").select(
                "query_id", "term", "weight", "batch", "block"
            )
            met = postings.join(wanted, ["term", "batch", "block"])
        hits = met.select("query_id", "weight", "batch", F.explode("held").alias("h"))
        score = F.sum(F.col("weight") * gain(F.col("h.tf"), F.col("h.len"), self.mean))
        found = hits.groupBy("query_id", F.col("h.id").alias("id"), "batch").agg(score.alias("bm25"))
        live = F.col("void").isNull() | (F.col("batch") >= F.col("void"))
        return found.join(self.dropped, "id", "left").where(live).select("query_id", "id", "bm25")

    def blocks(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(first, scores of first, rest): the most promising blocks of every
        query, the scores found there, and the other blocks that could hold one
        of the first k by their bound."""
        ranked = [F.desc("bound"), F.asc("batch"), F.asc("block")]
        first = settle(top_k(self.bounds, ["query_id"], ranked, self.probe, "_r").drop("_r"), "probe")
        scores = settle(self._scores(first), "scores")
        best = top_k(scores, ["query_id"], [F.desc("bm25"), F.asc("id")], self.k, "_r")
        # Fewer than k scores set no bar.
        bar = best.where(F.col("_r") == self.k).select("query_id", F.col("bm25").alias("bar"))
        rest = (
            self.bounds.join(first.select("query_id", "batch", "block"), ["query_id", "batch", "block"], "left_anti")
            .join(bar, "query_id", "left")
            .where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - NEAR))
            .select("query_id", "batch", "block", "bound")
        )
        return first, scores, settle(rest, "rest")

    def top(self) -> DataFrame:
        """(query_id, id, bm25, rank): the first k documents that share a word
        with the query, by score of `digits` places, then id."""
        _, scores, rest = self.blocks()
        found = scores.unionByName(self._scores(rest))
        return top_k(found, ["query_id"], [F.round("bm25", self.digits).desc(), F.asc("id")], self.k)

    def report(self) -> DataFrame:
        """(query_id, blocks, read): blocks that hold a word of the query, and
        those whose postings are opened."""
        first, _, rest = self.blocks()
        read = first.select("query_id").unionByName(rest.select("query_id"))
        return (
            self.bounds.groupBy("query_id")
            .agg(F.count("*").alias("blocks"))
            .join(read.groupBy("query_id").agg(F.count("*").alias("read")), "query_id")
        )


def rank_documents(queries: DataFrame, path: str, **options) -> DataFrame:
    """BlockRanking(queries, path, ...).top(): exact ranks of the stored index."""
    return BlockRanking(queries, path, **options).top()
