"""Writers. Sinks that replace a table write a new version beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .commits import WHOLE, CommitLog

# Partition column of tables of buckets.
BUCKET = "_bucket"


def flat_lists(df: DataFrame, sep: str = "|") -> DataFrame:
    """List columns joined to text, for formats without nesting."""
    return df.select(
        [
            F.array_join(F.col(f.name), sep).alias(f.name)
            if isinstance(f.dataType, T.ArrayType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat_lists(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """Reports are small frames; one file reads best."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").json(path)


# --- versioned tables ------------------------------------------------------
def new_version(df: DataFrame, table: str, base: int | None = None) -> str:
    """Write a frame, which may be derived from the table itself, as the
    newest version of a table and return its path. Readers of the old version
    are not disturbed and a failed write leaves it current. Versions follow the
    numbers of the table's commit log. With base, the commit that the frame was
    derived from, a version written by another in the meantime is a Conflict."""
    log = CommitLog(df.sparkSession, table)
    read = log.state()[0] if base is None else base
    data = f"version={uuid.uuid4().hex}"
    df.write.parquet(log.path(data))
    log.commit(read, data, [WHOLE])
    return log.path(data)


def complete_versions(spark: SparkSession, table: str) -> list[str]:
    """Names of the committed versions whose data are still there, oldest first."""
    log = CommitLog(spark, table)
    names = [log.manifest(n)["data"] for n in log.numbers()]
    return [n for n in names if log.exists(n)]


def current_version(spark: SparkSession, table: str) -> str | None:
    """Path of the newest version of a table replaced as a whole, null for none."""
    log = CommitLog(spark, table)
    data = log.state()[1].get(WHOLE)
    return log.path(data) if data else None


def read_buckets(spark: SparkSession, table: str) -> DataFrame | None:
    """Rows of a table of buckets with their `_bucket`: of each bucket the
    newest version that holds it. None while nothing was written."""
    log = CommitLog(spark, table)
    return log.read(log.state()[1], BUCKET)


def merge_buckets(batch: DataFrame, table: str, keys: list[str], buckets: int, merge) -> None:
    """Merge a batch into a table of buckets: merge(rows) of the batch and of
    the current rows of the buckets it touches becomes their newest version.
    Where another writer replaced one of these buckets in the meantime, the
    merge is done again on top of that, so neither is lost."""
    log = CommitLog(batch.sparkSession, table)
    at = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = batch.withColumn(BUCKET, at)
    touched = [str(r[0]) for r in fresh.select(BUCKET).distinct().collect()]
    if not touched:
        return

    def write(current: dict[str, str], path: str) -> None:
        stored = log.read({b: d for b, d in current.items() if b in touched}, BUCKET)
        rows = fresh if stored is None else fresh.unionByName(stored)
        merge(rows).write.partitionBy(BUCKET).parquet(path)

    log.replace(touched, write)
    log.drop_superseded()


def read_current(spark: SparkSession, table: str) -> DataFrame:
    path = current_version(spark, table)
    if path is None:
        raise FileNotFoundError(f"no version of {table}")
    return spark.read.parquet(path)
