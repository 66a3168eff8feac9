"""Vector building: batch encoding, resumable tables, run summary."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.documents import embedding_document
from ..functions.scores import l2_normalise
from ..functions.text import blank

# Vector width and rows per encoder call.
DIMENSION, BATCH = 384, 64

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder() -> Encoder:
    """Stand-in encoder: word counts hashed to DIMENSION buckets. A model is
    plugged in by passing its own factory."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSION))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                out[row, zlib.crc32(word.encode()) % DIMENSION] += 1.0
        return out

    return encode


def encode_texts(
    df: DataFrame, id_col: str, text_col: str,
    factory: Callable[[], Encoder] = hashing_encoder, batch: int = BATCH,
) -> DataFrame:
    """(id, vector): unit vectors of all texts. The encoder is made once per
    task and fed in small batches, whatever the partition size: only a batch's
    texts and vectors are Python's or numpy's at a time."""
    source = df.select(F.col(id_col), F.col(text_col))
    id_type = dict(source.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = factory()
        for held in batches:
            for at in range(0, held.num_rows, batch):
                part = held.slice(at, batch)
                m = np.asarray(encode(part.column(1).to_pylist()), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
                vectors = pa.ListArray.from_arrays(ends, m.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[id_col, "vector"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, vector array<float>")


def documents_to_encode(
    items: DataFrame, limit: int | None = None, order: Column | None = None
) -> DataFrame:
    """Items with a non-empty document; with a limit, the most popular ones."""
    rows = items.where(~blank(F.col("document")))
    if limit is None:
        return rows
    order = F.col("popularity").desc_nulls_last() if order is None else order
    return rows.orderBy(order, F.asc("item_id")).limit(limit)


def not_encoded(items: DataFrame, stored: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows without a stored vector; rows with a null key always remain."""
    return items.join(stored.select(key), key, "left_anti")


def encode_new(
    items: DataFrame, stored: DataFrame | None, limit: int | None = None,
    factory: Callable[[], Encoder] = hashing_encoder,
) -> DataFrame:
    """Vectors still missing from a store, ready to be appended to it."""
    rows = documents_to_encode(items, limit)
    if stored is not None:
        rows = not_encoded(rows, stored)
    return encode_texts(rows, "item_id", "document", factory)


def catalogue_vectors(
    items: DataFrame, factory: Callable[[], Encoder] = hashing_encoder
) -> DataFrame:
    """Vectors of the served catalogue over its embedding documents."""
    c = F.col
    text = embedding_document(
        c("title"), c("tagline"), c("overview"), c("genres"), c("keywords"), c("cast"),
        c("directors"),
    )
    return encode_texts(items.select("item_id", text.alias("text")), "item_id", "text", factory)


def run_summary(vectors: DataFrame) -> DataFrame:
    """One row: vectors, dimension, and the largest deviation from unit norm."""
    norm = F.sqrt(
        F.aggregate(
            F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x
        )
    )
    return vectors.agg(
        F.count("*").alias("total_vectors"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"),
        F.round(F.max(F.abs(norm - 1.0)), 4).alias("norm_error"),
    )


def unit_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    return df.withColumn(column, l2_normalise(F.col(column)))
