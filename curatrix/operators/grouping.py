"""Keep-one, first-wins and list merging, all pre-aggregated before the
shuffle so that a key holding most of the rows stays cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import growing


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def keep_one(df: DataFrame, keys: list[str], order: list = ()) -> DataFrame:
    """One row per key (null is a key): the smallest by `order`, then by a
    hash of the whole row, so the choice does not depend on the run. min_by
    merges partial winners, hence no task ever holds a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.struct(*_columns(order), F.xxhash64(*df.columns))
    won = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_won"))
    return won.select(
        *[F.col(c) if c in keys else F.col("_won")[c].alias(c) for c in df.columns]
    )


def first_by(column: str, rank: Column, alias: str | None = None) -> Column:
    """Aggregate: the non-null value of the lowest rank."""
    c = F.col(column)
    return F.min_by(c, F.when(c.isNotNull(), rank)).alias(alias or column)


def merged_lists(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sorted distinct non-null list values per key. Values are made distinct
    per (key, column, value) before they are gathered, so a key with millions
    of copies only ever gathers its different values."""
    long = df.select(
        key,
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]
            )
        ).alias("e"),
    ).select(key, F.col("e.column").alias("column"), F.explode("e.v").alias("value"))
    distinct = long.where(F.col("value").isNotNull()).distinct()
    return distinct.groupBy(key).agg(
        *[
            F.array_sort(
                F.collect_list(F.when(F.col("column") == c, F.col("value")))
            ).alias(c)
            for c in columns
        ]
    )


def ordered_names(df: DataFrame, key: str, position: str, name: str, alias: str) -> DataFrame:
    """List of non-null names per key in the order of a position column."""
    return (
        df.where(F.col(name).isNotNull())
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(position, name))).alias("_l"))
        .select(key, F.transform("_l", lambda e: e[name]).alias(alias))
    )


def sole_owner(df: DataFrame, owner: str, key: str) -> DataFrame:
    """Let only the smallest owner keep a shared key; the others get null.
    The join is on both columns, so a hot key does not skew it."""
    owners = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(owner).alias(owner))
        .withColumn("_owns", F.lit(True))
    )
    return (
        df.join(growing(owners), [owner, key], "left")
        .withColumn(key, F.when(F.col("_owns"), F.col(key)))
        .select(df.columns)
    )


def duplicate_members(df: DataFrame, keys: list[str], nulls_count: bool = False) -> DataFrame:
    """Rows sharing their key with another row, as a one-row count."""
    rows = df if nulls_count else df.dropna(subset=keys)
    return (
        rows.groupBy(*keys)
        .count()
        .agg(
            F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0))
            .cast("bigint")
            .alias("members")
        )
    )


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int | None = None, into: str = "rank"
) -> DataFrame:
    """Rank per group; with k the plan cuts each partition to k rows per
    group before the shuffle."""
    ranked = df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(into) <= k)


def first_wins(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Union of sources where the earliest source keeps a repeated id."""
    return keep_one(df, by, order)


def narrow_two_lists(df: DataFrame, head: int = 10, total: int = 15) -> DataFrame:
    """Per query: the `head` best by vector score, then the best by text score
    until `total`, each id once. Input is the fused top list, so groups are
    small by construction; ids break ties. Adds `slot`."""
    by = Window.partitionBy("query_id")
    df = df.withColumn(
        "_s", F.row_number().over(by.orderBy(F.desc("semantic"), "item_id"))
    )
    rest = F.when(F.col("_s") > head, 1).otherwise(0)
    df = df.withColumn(
        "_t",
        F.row_number().over(
            Window.partitionBy("query_id", rest).orderBy(F.desc("bm25_norm"), "item_id")
        ),
    )
    slot = F.when(F.col("_s") <= head, F.col("_s")).otherwise(F.lit(head) + F.col("_t"))
    return df.withColumn("slot", slot).where(F.col("slot") <= total).drop("_s", "_t")
