"""Reference checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def broken_references(
    child: DataFrame, child_key: str | Column, parent: DataFrame, parent_key: str | Column
) -> DataFrame:
    """One row: child rows whose key has no parent (null keys included).
    Child keys are counted before the join, so a key shared by a third of the
    rows meets its parent as a single row."""
    def key(c):
        return (F.col(c) if isinstance(c, str) else c).alias("_k")

    counted = child.groupBy(key(child_key)).agg(F.count("*").alias("_n"))
    parents = parent.select(key(parent_key)).distinct()
    return counted.join(parents, "_k", "left_anti").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("broken")
    )


def link_report(
    links: DataFrame, link_key: Column, parent: DataFrame, parent_key: Column
) -> DataFrame:
    """Total links, links without a target, and the match percentage. Null
    links count in the total but are not broken."""
    keyed = links.select(link_key.alias("_k"))
    counted = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    parents = parent.select(parent_key.alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return (
        counted.join(parents, "_k", "left")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_links"),
            F.coalesce(
                F.sum(F.when(F.col("_k").isNotNull() & F.col("_hit").isNull(), F.col("_n"))),
                F.lit(0),
            )
            .cast("bigint")
            .alias("broken_links"),
        )
        .withColumn(
            "match_pct",
            F.when(
                F.col("total_links") > 0,
                F.round(
                    (F.col("total_links") - F.col("broken_links")) / F.col("total_links") * 100, 2
                ),
            ).otherwise(F.lit(0.0)),
        )
    )
