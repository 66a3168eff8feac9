"""Helpers of the training-data operators: keyed texts, bounded blocks, spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fits, growing

# Bytes of text worked on at once inside a task, whatever the Arrow batch holds.
BLOCK_BYTES = 2_000_000
# Labels, pairs of a key and a number, that may be sent to every task.
MOST_LABELS = 1_000_000
SPANS = "array<struct<kind:string,start:int,end:int,origin:string>>"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def keyed_texts(items: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _text) only, so other columns can have any name; null is empty."""
    return items.select(
        quoted(key).alias("_key"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("_text"),
    )


def key_type(df: DataFrame, column: str = "_key") -> str:
    return dict(df.dtypes)[column]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` text bytes, or one row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("_text"))
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key's text modulo a number; null keys give null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _marked(labels: DataFrame, key: str, label: str, learn: Column) -> DataFrame:
    """(_key, _label) of the labels to learn from, one per key: of conflicting
    labels the larger holds."""
    return (
        labels.select(quoted(key).alias("_key"), quoted(label).cast("int").alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isNotNull() & learn)
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
    )


def labelled_texts(
    items: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column
) -> DataFrame:
    """(_key, _text, _label) of every row whose key has a label to learn from.
    Up to MOST_LABELS labels are sent to the texts, which then stay."""
    marked = _marked(labels, key, label, learn)
    side = F.broadcast(marked) if fits(marked, MOST_LABELS) else growing(marked)
    return keyed_texts(items, key, text).join(side, "_key")


def labelled_sample(
    items: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    learn: Column,
    max_rows: int,
    max_chars: int,
) -> list[tuple[str, int]]:
    """At most max_rows (text, label) pairs to fit a model with on the driver.

    Rows come from labels(key, label) whose key fulfils `learn` (a condition on
    the column _key), chosen by a digest of the key so that the choice does not
    depend on order or partitions; texts over max_chars characters are left out
    of the fit, which bounds what is held. Rows with a null key or label do not
    count; of conflicting labels the larger holds. Texts of one key count once."""
    marked = _marked(labels, key, label, learn)
    total = marked.count()
    if not total:
        return []
    share = int(min(1.0, 0.95 * max_rows / total) * (1 << 20))
    chosen = marked.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < share).limit(max_rows)
    docs = keyed_texts(items, key, text).where(F.length("_text") <= max_chars)
    # The chosen rows are at most max_rows pairs of a key and a number.
    met = docs.join(F.broadcast(chosen), "_key").limit(2 * max_rows).collect()
    one = {r["_key"]: (r["_text"], r["_label"]) for r in met}
    return [one[k] for k in sorted(one)][:max_rows]
