"""Profiles, rule checks, quality metrics and distributions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank, finite
from ..schema import ITEM_COLUMNS, schema_matches

# Severities of broken rules.
CRITICAL, HIGH, MEDIUM = "CRITICAL", "HIGH", "MEDIUM"


def missing_values(df: DataFrame, decimals: int = 4) -> DataFrame:
    """(column, null_count, null_pct) for every column, in one pass."""
    wide = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count"), F.col("_n"))
                    for c in df.columns
                ]
            )
        ).alias("e")
    ).select(
        "e.column",
        "e.null_count",
        F.when(
            F.col("e._n") > 0, F.round(F.col("e.null_count") / F.col("e._n") * 100, decimals)
        )
        .otherwise(0.0)
        .alias("null_pct"),
    )


def distinct_values(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, distinct_count), null counted as a value. The exact form makes
    (column, value) pairs distinct first, so it needs no Expand over every
    column and a column with one dominant value shuffles one row per task."""
    if approximate:
        wide = df.agg(
            *[
                (
                    F.approx_count_distinct(F.col(c))
                    + F.max(F.col(c).isNull()).cast("int")
                ).alias(c)
                for c in df.columns
            ]
        )
        return wide.unpivot([], df.columns, "column", "distinct_count")
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), _comparable(df, c).alias("value"))
                    for c in df.columns
                ]
            )
        ).alias("e")
    ).select("e.*")
    return long.distinct().groupBy("column").agg(F.count("*").alias("distinct_count"))


def _comparable(df: DataFrame, c: str) -> Column:
    nested = df.schema[c].dataType.typeName() in ("array", "map", "struct")
    return F.to_json(F.col(c)) if nested else F.col(c).cast("string")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows, whole-row duplicates and their percentage. Counts
    per distinct row are summed, so the exact answer costs one shuffle of
    distinct rows and no sampled estimate is needed."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("_c"))
        .agg(
            F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("row_count"),
            F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        )
        .withColumn(
            "duplicate_pct",
            F.when(
                F.col("row_count") > 0,
                F.round(F.col("duplicate_count") / F.col("row_count") * 100, 4),
            ).otherwise(0.0),
        )
    )


def excess_keys(df: DataFrame, key: str) -> DataFrame:
    """One row: rows minus distinct keys; null is one key."""
    return df.groupBy(key).agg(F.count("*").alias("_c")).agg(
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("excess")
    )


def type_summary(df: DataFrame) -> DataFrame:
    """(type, columns) from the schema; no data is read."""
    spark = df.sparkSession
    rows = [(f.dataType.simpleString(),) for f in df.schema]
    return (
        spark.createDataFrame(rows, "type string")
        .groupBy("type")
        .agg(F.count("*").alias("columns"))
    )


def sample_records(df: DataFrame, n: int = 5) -> DataFrame:
    """n rows as JSON, NaN and infinities as null: those of the least digest,
    so that the choice does not depend on partitions."""
    clean = [
        finite(F.col(f.name)).alias(f.name)
        if f.dataType.typeName() in ("float", "double")
        else F.col(f.name)
        for f in df.schema
    ]
    records = df.select(F.to_json(F.struct(*clean)).alias("record"))
    return records.orderBy(F.xxhash64("record"), "record").limit(n)


def profile(df: DataFrame, name: str, approximate: bool = False) -> DataFrame:
    """Column profile: one row per column with nulls and distinct values,
    counted exactly at any size unless sketches are asked for."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string"
    )
    return (
        types.join(missing_values(df), "column")
        .join(distinct_values(df, approximate), "column")
        .withColumn("component", F.lit(name))
    )


@dataclass(frozen=True)
class Rule:
    """A row-level check: `broken` is true for offending rows."""

    name: str
    severity: str
    broken: Column


def check_rules(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """(dataset, rule, severity, affected_rows) for every rule, one pass."""
    wide = df.agg(
        *[F.count_if(r.broken).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(dataset).alias("dataset"),
                        F.lit(r.name).alias("rule"),
                        F.lit(r.severity).alias("severity"),
                        F.col(f"r{i}").alias("affected_rows"),
                    )
                    for i, r in enumerate(rules)
                ]
            )
        ).alias("e")
    ).select("e.*")


def as_issue(count: DataFrame, column: str, dataset: str, rule: str, severity: str) -> DataFrame:
    """Turn a one-row count into a rule row."""
    return count.select(
        F.lit(dataset).alias("dataset"),
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.col(column).cast("bigint").alias("affected_rows"),
    )


def validation_status(issues: DataFrame) -> DataFrame:
    """FAILED for a dataset with any critical finding, else PASSED."""
    critical = F.count_if((F.col("severity") == CRITICAL) & (F.col("affected_rows") > 0))
    return issues.groupBy("dataset").agg(
        F.when(critical > 0, "FAILED").otherwise("PASSED").alias("status"),
        F.count_if(F.col("affected_rows") > 0).alias("issues"),
    )


# --- final quality report --------------------------------------------------
def no_ids() -> Column:
    ids = ["imdb_id", "tmdb_id", "movielens_id", "wiki_page"]
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in ids])


def rating_out_of_range() -> Column:
    return (F.col("rating_value") < 1.0) | (F.col("rating_value") > 10.0)


def item_flags() -> dict[str, Column]:
    """The eight row-level quality metrics."""
    return {
        "missing_titles": blank(F.col("title")),
        "empty_overviews": blank(F.col("overview")) & blank(F.col("plot_summary")),
        "missing_genres": F.coalesce(F.size("genres") <= 0, F.lit(True)),
        "invalid_imdb_format": ~F.col("imdb_id").rlike(r"^tt\d{7,8}$"),
        "invalid_tmdb_ids": F.col("tmdb_id") <= 0,
        "invalid_movielens_ids": F.col("movielens_id") <= 0,
        "invalid_ratings": rating_out_of_range(),
        "orphan_records": no_ids(),
    }


def quality_metrics(items: DataFrame) -> DataFrame:
    """(metric, value) for the eleven quality metrics."""
    flags = item_flags()
    wide = items.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    metrics = wide.unpivot([], list(flags), "metric", "value")
    return metrics.unionByName(duplicate_metrics(items))


# Metric of repeated keys: its columns and whether nulls count as a key.
_DUPLICATES = {
    "duplicate_imdb_ids": (["imdb_id"], False),
    "duplicate_tmdb_ids": (["tmdb_id"], False),
    "duplicate_title_year_combinations": (["title", "release_year"], True),
}


def duplicate_metrics(items: DataFrame) -> DataFrame:
    """(metric, value): rows that share a key with others, for three keys at
    once. Each row is one (metric, digest of the key) per key, counted before
    it is shuffled."""
    entries = []
    for name, (keys, nulls) in _DUPLICATES.items():
        text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        known = F.lit(True) if nulls else F.col(keys[0]).isNotNull()
        entries.append(F.struct(F.lit(name).alias("metric"), F.when(known, F.md5(text)).alias("k")))
    long = items.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    counted = long.where("k is not null").groupBy("metric", "k").count()
    sums = counted.where("count > 1").groupBy("metric").agg(F.sum("count").alias("value"))
    names = items.sparkSession.createDataFrame([(n,) for n in _DUPLICATES], "metric string")
    return names.join(sums, "metric", "left").select(
        "metric", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")
    )


def valid_item() -> Column:
    """Titled, with an id and, when rated, a rating in range."""
    rated_ok = F.col("rating_value").isNull() | ~rating_out_of_range()
    return F.coalesce(~blank(F.col("title")) & ~no_ids() & rated_ok, F.lit(False))


def keep_valid(items: DataFrame) -> DataFrame:
    """Titled items with an id and, when rated, a rating in range."""
    return items.where(valid_item())


def value_frequency(items: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, count) of exploded list values, most frequent first."""
    counts = (
        items.select(F.explode(column).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count("*").alias("count"))
    )
    ordered = counts.orderBy(F.desc("count"), F.asc("value"))
    return ordered if top is None else ordered.limit(top)


def rating_bin() -> Column:
    """Whole-number bin 1 to 9 of a rating, the last one closed."""
    n = F.greatest(F.lit(1), F.least(F.lit(9), F.floor("rating_value"))).cast("int")
    return F.when(F.col("rating_value").isNotNull(), n)


def rating_histogram(items: DataFrame) -> DataFrame:
    """(bin, count): whole-number bins 1 to 9."""
    return (
        items.where(F.col("rating_value").isNotNull())
        .groupBy(rating_bin().alias("_n"))
        .agg(F.count("*").alias("count"))
        .select(
            F.concat(
                F.col("_n").cast("string"),
                F.lit(".0-"),
                (F.col("_n") + 1).cast("string"),
                F.lit(".0"),
            ).alias("bin"),
            "count",
        )
    )


def quality_report(items: DataFrame) -> DataFrame:
    """Long report (section, name, value): totals, metrics, distributions and
    missing values of an item table."""
    def section(df, label, name, value):
        return df.select(
            F.lit(label).alias("section"),
            F.col(name).cast("string").alias("name"),
            F.col(value).cast("double").alias("value"),
        )

    valid = valid_item()
    wide = {
        ("statistics", "initial_rows"): F.count("*"),
        ("statistics", "final_rows"): F.count_if(valid),
        ("statistics", "schema_consistent"): F.lit(1.0 if schema_matches(items) else 0.0),
        **{("metrics", n): F.count_if(c) for n, c in item_flags().items()},
        **{
            ("missing", c): F.count_if(F.col(c).isNull())
            for c in ITEM_COLUMNS
            if c in items.columns
        },
        **{("ratings", f"{n}.0-{n + 1}.0"): F.count_if(rating_bin() == n) for n in range(1, 10)},
    }
    # Everything that is a number over all rows comes from one pass.
    one = items.agg(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(wide.values())])
    counted = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("section"), F.lit(n).alias("name"),
                        F.col(f"c{i}").alias("value"),
                    )
                    for i, (label, n) in enumerate(wide)
                ]
            )
        ).alias("e")
    ).select("e.*")
    parts = [
        counted.where((F.col("section") != "ratings") | (F.col("value") > 0)),
        section(duplicate_metrics(items), "metrics", "metric", "value"),
        section(value_frequency(items, "genres"), "genres", "value", "count"),
        section(value_frequency(items, "languages", 30), "languages", "value", "count"),
    ]
    return reduce(DataFrame.unionByName, parts)
