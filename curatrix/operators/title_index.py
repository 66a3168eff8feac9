"""Index of text grams for lookups by contained text, with the first rows of
every short gram kept while it is built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import lookup_join
from .grouping import top_k

GRAM = 3


def grams(low: Column, n: int) -> Column:
    """All runs of n characters; a shorter text is its own run."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - (n - 1)))
    return F.transform(starts, lambda s: F.substr(low, s, F.lit(n)))


@dataclass(frozen=True)
class TitleIndex:
    """rows: item_id, text columns and `_low`; heads: the first `keep` rows of
    every gram of one to GRAM characters (gram, place, columns of rows);
    postings: (gram, item_id) of grams of GRAM characters; counts: (gram, n)."""

    rows: DataFrame
    heads: DataFrame
    postings: DataFrame
    counts: DataFrame
    order: tuple[str, ...]
    keep: int

    def write(self, path: str) -> None:
        """Heads and postings lie sorted by gram, so that a look-up skips all
        row groups but those of its grams. A gram in many texts spans files."""
        by_gram = self.postings.repartitionByRange("gram", F.xxhash64("item_id"))
        by_gram.sortWithinPartitions("gram").write.parquet(f"{path}/postings")
        self.heads.repartitionByRange("gram", "place").sortWithinPartitions(
            "gram", "place"
        ).write.parquet(f"{path}/heads")
        self.rows.write.parquet(f"{path}/rows")
        self.counts.write.parquet(f"{path}/counts")


def read_index(spark: SparkSession, path: str, order: list[str], keep: int) -> TitleIndex:
    """What `TitleIndex.write` stored; order and keep as at its building."""
    frames = [spark.read.parquet(f"{path}/{n}") for n in ("rows", "heads", "postings", "counts")]
    return TitleIndex(*frames, tuple(order), keep)


def _asked_grams(needles: DataFrame) -> DataFrame:
    """(gram): all that `first_containing` can look up for these needles."""
    n = F.col("needle")
    own = F.when(F.length(n) <= GRAM, F.array(n)).otherwise(grams(n, GRAM))
    return needles.where(F.length(n) > 0).select(F.explode(own).alias("gram")).distinct()


def build_index(
    items: DataFrame, text: str, order: list[str], keep: int, needles: DataFrame | None = None
) -> TitleIndex:
    """Index of items(item_id, text, columns of order) over the lower-cased
    text. `order` ranks the items that hold a needle, smallest first; `_low`
    is the lower-cased text, `_n` its length. item_id is unique and ends every
    order. Null texts hold nothing; an empty one neither. With needles, only
    the grams these can ask for are kept, for an index that is used once."""
    order = [*[c for c in order if c != "item_id"], "item_id"]
    low = F.lower(F.col(text))
    rows = items.withColumn("_low", low).withColumn("_n", F.length(low))
    rows = rows.where(F.col("_n") > 0)
    sizes = [grams(F.col("_low"), n) for n in range(1, GRAM + 1)]
    spread = rows.withColumn("gram", F.explode(F.array_distinct(F.concat(*sizes))))
    long = rows.where(F.col("_n") >= GRAM).select(
        F.explode(F.array_distinct(sizes[-1])).alias("gram"), "item_id"
    )
    if needles is not None:
        asked = _asked_grams(needles)
        spread = lookup_join(spread, asked, ["gram"], spread_by="item_id")
        long = lookup_join(long, asked, ["gram"], spread_by="item_id")
    heads = top_k(spread, ["gram"], [F.asc(c) for c in order], keep, "place")
    counts = long.groupBy("gram").agg(F.count("*").alias("n"))
    return TitleIndex(rows, heads, long.select("gram", "item_id"), counts, tuple(order), keep)


def rarest_grams(index: TitleIndex, needles: DataFrame) -> DataFrame:
    """(needle, gram): the gram of each longer needle that the fewest texts
    hold. A needle with a gram that no text holds is left out."""
    spread = needles.where(F.length("needle") > GRAM).select(
        "needle", F.explode(F.array_distinct(grams(F.col("needle"), GRAM))).alias("gram")
    )
    counted = spread.join(index.counts, "gram", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    rarest = counted.groupBy("needle").agg(
        F.min(F.struct(n.alias("n"), F.col("gram").alias("gram"))).alias("_r")
    )
    return rarest.where(F.col("_r.n") > 0).select("needle", F.col("_r.gram").alias("gram"))


def first_containing(index: TitleIndex, needles: DataFrame) -> DataFrame:
    """First `index.keep` rows that hold each different needle(needle), which
    is lower-cased: needle, columns of the items, place. An empty or null
    needle finds nothing.

    A needle of at most GRAM characters is a gram itself and reads the rows
    kept for it. A longer one reads the postings of its rarest gram; the rows
    these name are verified and cut to the first ones."""
    asked = needles.where(F.length("needle") > 0).select("needle").distinct()
    columns = [c for c in index.rows.columns if c not in ("_low", "_n")]
    short = asked.where(F.length("needle") <= GRAM)
    kept = index.heads.withColumnRenamed("gram", "needle").join(short, "needle")
    met = lookup_join(index.postings, rarest_grams(index, asked), ["gram"], spread_by="item_id")
    held = index.rows.join(met.select("needle", "item_id"), "item_id").where(
        F.col("_low").contains(F.col("needle"))
    )
    cut = top_k(held, ["needle"], [F.asc(c) for c in index.order], index.keep, "place")
    out = ["needle", *columns, "place"]
    return kept.select(out).unionByName(cut.select(out))
