"""Delimited and parquet readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Null spellings, delimiters tried.
NULL_TOKENS = ["\\N", "NA", "NaN", ""]
DELIMITERS = [",", "\t", ";", "|"]


def nulls_for_tokens(df: DataFrame) -> DataFrame:
    """Text columns with the null spellings replaced by null."""
    def clean(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.when(~c.isin(NULL_TOKENS), c).alias(f.name)
        return c

    return df.select([clean(f) for f in df.schema])


def read_delimited(
    spark: SparkSession, path, schema: T.StructType | str, sep: str = ",",
    encoding: str = "UTF-8", corrupt: str | None = None, line_breaks: bool | None = None,
) -> DataFrame:
    """Delimited files with a declared schema and a header line. Tab-separated
    files have no quoting; broken rows are kept as nulls, with their text in
    `corrupt` when that column is in the schema. Everything is read as text
    where tokens can hide nulls, then cast leniently. line_breaks says whether
    quoted values may hold them, by default in all but tab-separated files;
    without, a large file is read in many splits."""
    line_breaks = sep != "\t" if line_breaks is None else line_breaks
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    reader = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", line_breaks)
    )
    if sep == "\t":
        reader = reader.option("quote", "")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    raw = nulls_for_tokens(reader.csv(path))
    return raw.select(
        [
            F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
            if not isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in wanted
        ]
    )


def spread_gzip(df: DataFrame) -> DataFrame:
    """A gzip file is one split; let its rows be rebalanced after the scan."""
    return df.hint("rebalance")


def spread(scan: DataFrame) -> DataFrame:
    """Rows over all cores, before heavy work per row."""
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def dialects(
    spark: SparkSession, path, pattern: str = "*", sample_bytes: int | None = None
) -> DataFrame:
    """(folder, file, encoding, delimiter) for every file below a path: utf-8
    when all bytes decode, else latin-1, which always does; the most frequent
    delimiter of the header line, else the default of the suffix. A file is one
    row of at most 2 GB; sample_bytes judges larger ones on their first bytes,
    and can then take a later latin-1 character for utf-8."""
    head = F.col("content") if sample_bytes is None else F.substring("content", 1, sample_bytes)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", head.alias("head"))
    )
    # Bytes that do not survive decoding and encoding were not utf-8; the last
    # three may be a character cut by the sample.
    text = F.try_validate_utf8(F.col("head").cast("string"))
    cut = F.try_validate_utf8(
        F.expr("substring(head, 1, greatest(0, length(head) - 3))").cast("string")
    )
    utf8 = text.isNotNull()
    if sample_bytes is not None:
        utf8 = utf8 | ((F.octet_length("head") == sample_bytes) & cut.isNotNull())
    decoded = F.decode("head", "ISO-8859-1")
    header = F.get(
        F.filter(
            F.transform(F.split(decoded, "\n"), lambda s: F.trim(s)), lambda s: s != ""
        ),
        0,
    )
    name = F.element_at(F.split("path", "/"), -1)
    default = F.when(name.contains(".tsv"), "\t").otherwise(",")

    def count(d: str):
        return F.length(header) - F.length(F.replace(header, F.lit(d), F.lit("")))

    counted = F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("o"),
                                 F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(counted)
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        name.alias("file"),
        F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"),
        F.when(best["n"] > 0, best["d"]).otherwise(default).alias("delimiter"),
    )


def load_statistics(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, and the bytes of all rows as JSON text."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint"))
    return df.agg(F.count("*").alias("row_count"), size.alias("_bytes")).select(
        F.lit(name).alias("table"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce("_bytes", F.lit(0)).cast("bigint").alias("est_bytes"),
    )
