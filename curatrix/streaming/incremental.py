"""File-stream forms of the incremental jobs. Each runs over what has arrived
since its checkpoint and stops; starting it again continues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.scores import l2_normalise
from ..operators.latest import last_write
from ..plans.embedding import encode_new
from ..sources.sinks import merge_buckets
from .keyed import first_per_key


def file_stream(
    spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet"
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    )


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files of one table, be its path that of a file or of a folder of
    files. The path goes in as a pattern that only it meets: a plain one may
    name folders alone."""
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, "*")


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything available, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _stream_id(session: SparkSession) -> str:
    """Id of the running query, which Spark keeps with its checkpoint: another
    source, or the same one after its checkpoint was lost, has another id."""
    found = session.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise RuntimeError("only to be called from a streaming batch")
    return found


def _stored(spark: SparkSession, store: str, schema: str, stream: str, batch_id: int) -> DataFrame:
    """Rows of all batches but this one; none while nothing was ever stored."""
    try:
        rows = spark.read.schema(f"{schema}, stream string, batch long").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    other = (F.col("stream") != stream) | (F.col("batch") != batch_id)
    return rows.where(other).drop("stream", "batch")


def stored_by_others(spark: SparkSession, store: str, schema: str, stream: str) -> DataFrame:
    """Rows that other streams put into a store. Folders are picked by their
    names; those of this stream are not opened."""
    try:
        rows = spark.read.schema(f"{schema}, stream string").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col("stream") != stream).drop("stream")


def _store_batches(stream: DataFrame, store: str, checkpoint: str, schema: str, fresh) -> None:
    """Append what fresh(batch, stored) finds new. A batch writes a folder of
    its own, named by the stream's id and the batch number: a retried one
    replaces its own output, and no other stream's batches are touched."""

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = _stream_id(session)
        done = _stored(session, store, schema, name, batch_id)
        path = f"{store}/stream={name}/batch={batch_id}"
        fresh(batch, done).write.mode("overwrite").parquet(path)

    drain(stream, checkpoint, each)


def build_vectors(
    spark: SparkSession, documents: DataFrame, store: str, checkpoint: str,
    id_type: str = "long",
) -> None:
    """Encode arriving documents(item_id, document) that have no vector yet."""
    schema = f"item_id {id_type}, vector array<float>"
    _store_batches(documents, store, checkpoint, schema, encode_new)


def upsert_vectors(
    spark: SparkSession, vectors: DataFrame, store: str, checkpoint: str
) -> None:
    """Append arriving vectors(item_id, vector) whose id is not stored.

    The ids that this stream has stored are state of the stream, hence a batch
    reads none of its own files again; of other streams' files it reads the
    ids. Of several rows of one id in one batch the smallest digest stays.
    Rows without an id are left out."""
    rows = vectors.select("item_id", l2_normalise(F.col("vector")).alias("vector"))
    passed = first_per_key(rows.where(F.col("item_id").isNotNull()), "item_id")

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        name = _stream_id(session)
        path = f"{store}/stream={name}/batch={batch_id}"
        others = stored_by_others(session, store, "item_id long", name)
        fresh = batch.join(others, "item_id", "left_anti")
        fresh.write.mode("overwrite").parquet(path)

    drain(passed, checkpoint, each)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).drop("stream", "batch")


def compact_log(
    log: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str],
    buckets: int = 16,
) -> None:
    """Keep one row per key, the newest, in a table cut into buckets by a
    digest of the key. A batch reads and rewrites only the buckets it touches.
    Deletes stay as rows so that late older writes cannot revive a key.
    Replaying a batch gives the same table, hence retries are harmless."""

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_buckets(batch, table, keys, buckets, lambda rows: last_write(rows, keys, order))

    drain(log, checkpoint, each)
