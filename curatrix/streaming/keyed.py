"""Streams that remember their keys: what has passed before, and when.

The memory is the stream's own state, kept with its checkpoint, so a retried
batch starts from the state before it and gives the same rows again. State of
many keys belongs on disk: set `spark.sql.streaming.stateStore.providerClass`
to Spark's RocksDB provider on a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_per_key(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not passed before, one per key: of several in one
    batch, that of the smallest digest. The key is not null. Rows of a key
    come in pieces of bounded size, of which one row is held."""
    columns = stream.columns

    def pick(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            if state.exists:
                continue
            at = frame["_digest"].to_numpy().argmin()
            if best is None or frame["_digest"].iloc[at] < best["_digest"].iloc[0]:
                best = frame.iloc[[at]]
        if best is not None:
            state.update((True,))
            yield best[columns]

    ranked = stream.withColumn("_digest", F.xxhash64(*columns))
    return ranked.groupBy(key).applyInPandasWithState(
        pick, stream.schema, "passed boolean", "append", GroupStateTimeout.NoTimeout
    )


def due_fetches(
    requests: DataFrame, key: str, at: str, ttl_seconds: int, lateness: str = "1 hour"
) -> DataFrame:
    """Requests (key, at) for a payload that have to be fetched: a key's first
    one, and each that comes more than ttl_seconds after the fetch before.
    What lies between is answered by the payload that is there.

    at is a timestamp (in session time where it names no zone), taken by whole
    seconds. Rows of a batch are judged in
    the order of time; a row older than the latest fetch is answered by it.
    Rows more than `lateness` behind the newest time are left out, as are rows
    without key or time. A key is forgotten once its payload has expired for
    all rows that may still come, so state holds live payloads only. Times of
    a key are held by different seconds, not by rows."""

    def judge(
        names: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.empty(0, dtype=np.int64)
        for frame in frames:
            times = np.union1d(times, frame["_second"].to_numpy(dtype=np.int64))
        last = state.get[0] if state.exists else None
        due = []
        place = 0
        while place < len(times):
            if last is not None:
                place = int(np.searchsorted(times, last + ttl_seconds, side="right"))
                if place == len(times):
                    break
            last = int(times[place])
            due.append(last)
        state.update((last,))
        ends = max((last + ttl_seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(ends)
        if due:
            yield pd.DataFrame({key: [names[0]] * len(due), "_second": due})

    rows = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn(
        at, F.col(at).cast("timestamp")
    )
    seen = rows.withWatermark(at, lateness).select(
        key, at, F.unix_timestamp(at).alias("_second")
    )
    kind = dict(rows.dtypes)[key]
    found = seen.groupBy(key).applyInPandasWithState(
        judge, f"`{key}` {kind}, _second long", "fetched long", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(key, F.timestamp_seconds("_second").alias(at))
