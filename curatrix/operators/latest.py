"""Change logs: last write wins, recent entries, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .grouping import top_k


def last_write(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. The maximum of (order, row) merges partially, so a
    key with most of the log costs no more than any other."""
    rest = [c for c in log.columns if c not in keys + order]
    newest = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return newest.select(
        *[F.col(c) if c in keys else F.col("_m")[c].alias(c) for c in log.columns]
    )


def current_state(
    log: DataFrame, keys: list[str], order: list[str], deleted: Column
) -> DataFrame:
    """Rows alive after replaying the log."""
    return last_write(log, keys, order).where(~deleted)


def newest_first(state: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """Rows with their place in the owner's list, newest first."""
    return top_k(state, [owner], [F.desc(c) for c in order], None, "place")


def recent_distinct(
    log: DataFrame, user: str, text: str, order: list[str], keep: int = 10
) -> DataFrame:
    """Last `keep` different texts per user, letter case aside; each shown as
    typed last."""
    trimmed = log.where(F.trim(text) != "").withColumn(text, F.trim(text))
    newest = trimmed.groupBy(user, F.lower(text).alias("_k")).agg(
        F.max(F.struct(*order, text)).alias("_m")
    )
    rows = newest.select(user, *[F.col("_m")[c].alias(c) for c in [*order, text]])
    return top_k(rows, [user], [F.desc(c) for c in order], keep, "place")


def within_quota(log: DataFrame, guest: str, order: list[str], quota: int = 5) -> DataFrame:
    """First `quota` rows per guest."""
    return top_k(log, [guest], [F.asc(c) for c in order], quota, "place")


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in random but repeatable order, each at most once."""
    mark = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(mark, F.asc(id_col)).limit(n)
