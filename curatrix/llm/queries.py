"""Registered queries of the training-data operators: each maps the given
tables to an operator's entities and its result to the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    collision_hashing,
    decontaminate,
    deobfuscate,
    infilling,
    language_model,
    licences,
    packing,
    pieces,
    quality_crf,
    secret_scan,
    simhash,
    toxicity,
    whitening,
)
from .common import count_kind, remainder, spans_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as catalogue items: item_id, document."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(F.col("doc_id").alias("item_id"), F.col("text").alias("document"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return table.select(F.col("doc_id").alias("item_id"), "quality", "toxic")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table as evaluation queries: query_id, text."""
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return table.select(F.col("item_id").alias("query_id"), "text")


def _base(spans):
    return F.filter(spans, lambda s: s["origin"] == "base")


def _span_digest(found: DataFrame, spans: str, kinds: tuple[str, ...]) -> DataFrame:
    own = _base(F.col(spans))
    return found.select(
        F.col("item_id").alias("doc_id"),
        *[count_kind(own, k).alias(f"n_{k}") for k in kinds],
        F.sha2(spans_text(own), 256).alias("base_sha256"),
        spans_text(F.col(spans)).alias("spans"),
    )


@query
def op1_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(catalogue(spark, sf_dir))
    return _span_digest(found, "secrets", ("assign", "access", "hex"))


def _held_out(modulus: int, value: int):
    rest = remainder(F.col("doc_id"), modulus)
    return F.coalesce(rest == value, F.lit(False)).alias("held_out")


@query
def op2_quality_classifier(spark, sf_dir):
    learn = remainder(F.col("_key"), 3) != 1
    found = quality_crf.score_quality(
        catalogue(spark, sf_dir), judgements(spark, sf_dir), learn=learn
    ).withColumnRenamed("item_id", "doc_id")
    return found.select("doc_id", _held_out(3, 1), "score", "predicted")


@query
def op3_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.find_test_items(catalogue(spark, sf_dir), probes(spark, sf_dir))
    return found.select(
        F.col("item_id").alias("doc_id"),
        F.col("query_id").alias("item_id"),
        "distance",
        "allowed",
        "first_word",
        "last_word",
    )


@query
def op4_pii(spark, sf_dir):
    found = deobfuscate.find_identifiers(catalogue(spark, sf_dir))
    return _span_digest(found, "identifiers", deobfuscate.KINDS)


@query
def op5_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(catalogue(spark, sf_dir), words=4, radius=4)
    return found.select(
        F.col("item_id").alias("doc_id"), "fingerprint", "component_id", F.col("links").alias("copies")
    )


@query
def op6_toxicity(spark, sf_dir):
    learn = remainder(F.col("_key"), 4) != 2
    found = toxicity.score_toxicity(
        catalogue(spark, sf_dir), judgements(spark, sf_dir), learn=learn
    ).withColumnRenamed("item_id", "doc_id")
    return found.select("doc_id", _held_out(4, 2), "score", "predicted")


@query
def op7_sentencepiece(spark, sf_dir):
    found = pieces.encode_documents(catalogue(spark, sf_dir))
    return found.select(
        F.col("item_id").alias("doc_id"), "pieces", F.size("pieces").alias("n_pieces"), "lossless"
    )


@query
def op8_licence_scan(spark, sf_dir):
    found = licences.find_licences(catalogue(spark, sf_dir))
    return found.withColumnRenamed("item_id", "doc_id")


ORACLE["op8_licence_scan"] = licences.duckdb_sql("documents", "doc_id", "text")


@query
def op9_lm_scoring(spark, sf_dir):
    learn = remainder(F.col("_key"), 7) != 2
    found = language_model.score_texts(catalogue(spark, sf_dir), learn=learn)
    found = found.withColumnRenamed("item_id", "doc_id")
    return found.select(
        "doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as the catalogue's vectors: item_id, vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query
def op10_approximate_neighbours(spark, sf_dir):
    items = vector_store(spark, sf_dir)
    queries = items.where(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id")
    found = collision_hashing.nearest_by_collisions(queries, items, k=20)
    return found.select("query_id", "rank", F.col("item_id").alias("vec_id"), "score")


@query
def op11_embedding_whitening(spark, sf_dir):
    found = whitening.whiten_vectors(vector_store(spark, sf_dir))
    return found.select(
        F.col("item_id").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )


@query
def op12_fill_in_middle(spark, sf_dir):
    found = infilling.infill_documents(catalogue(spark, sf_dir))
    return found.select(
        F.col("item_id").alias("doc_id"),
        F.col("n_chars").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infilling.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias(
            "restored_sha256"
        ),
    )


ORACLE["op12_fill_in_middle"] = infilling.duckdb_sql("documents", "doc_id", "text")


@query
def op13_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(catalogue(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")
