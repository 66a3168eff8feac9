"""Which expected source files are there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Files each provider must deliver.
REQUIRED_FILES = {
    "imdb": [
        "title.basics.tsv.gz",
        "title.ratings.tsv.gz",
        "title.principals.tsv.gz",
        "title.crew.tsv.gz",
        "name.basics.tsv.gz",
    ],
    "tmdb": [
        "movies_metadata.csv",
        "credits.csv",
        "keywords.csv",
        "links.csv",
        "links_small.csv",
        "ratings_small.csv",
    ],
    "movielens": ["movies.csv", "ratings.csv", "tags.csv", "links.csv"],
    "wikipedia": ["wiki_movie_plots_deduped.csv"],
}


def found_files(spark: SparkSession, path) -> DataFrame:
    """(provider, file, bytes) of all files; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("bytes"))
    )
    parts = F.split("path", "/")
    return listed.select(
        F.lower(F.element_at(parts, -2)).alias("provider"),
        F.element_at(parts, -1).alias("file"),
        "bytes",
    )


def check_manifest(
    found: DataFrame, required: dict[str, list[str]] = REQUIRED_FILES
) -> DataFrame:
    """(provider, file, state): present, missing or unexpected. Providers
    without any folder are not reported; those discovered are."""
    spark = found.sparkSession
    rows = [(p, f) for p, files in required.items() for f in files]
    wanted = spark.createDataFrame(rows, "provider string, file string")
    known = found.join(
        wanted.select("provider").distinct(), "provider", "left_semi"
    )
    wanted = wanted.join(known.select("provider").distinct(), "provider", "left_semi")
    keys = ["provider", "file"]

    def state(df, label):
        return df.select(*keys, F.lit(label).alias("state"))

    return reduce(
        DataFrame.unionByName,
        [
            state(wanted.join(known, keys, "left_semi"), "present"),
            state(wanted.join(known, keys, "left_anti"), "missing"),
            state(known.join(wanted, keys, "left_anti"), "unexpected"),
        ],
    )


def complete_providers(manifest: DataFrame) -> DataFrame:
    """Providers all of whose files are present; others are skipped."""
    return (
        manifest.groupBy("provider")
        .agg(F.count_if(F.col("state") == "missing").alias("missing"))
        .where(F.col("missing") == 0)
        .select("provider")
    )
