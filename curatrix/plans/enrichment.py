"""Filling item gaps from landed payloads, and the detail view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.documents import item_document
from ..functions.payload import detail_fields, fill_fields, parsed_payload
from ..functions.text import blank
from ..operators.grouping import keep_one
from ..schema import ITEM_COLUMNS, ITEM_SCHEMA

# The fields whose absence makes an item a candidate.
GAP_FIELDS = [
    "poster_path",
    "backdrop_path",
    "trailer_url",
    "streaming_providers",
    "collection_name",
    "certification",
]


def has_gaps() -> Column:
    """An id is known and at least one of the six fields is missing."""
    gap = F.lit(False)
    for f in GAP_FIELDS:
        gap = gap | F.col(f).isNull()
    return (F.col("imdb_id").isNotNull() | F.col("tmdb_id").isNotNull()) & gap


def expired(fetched: Column, now: Column, ttl_seconds: int) -> Column:
    """Whether a cached row is older than the time to live; a fetch time that
    cannot be read counts as expired."""
    t = F.try_to_timestamp(fetched.cast("string"))
    age = F.unix_timestamp(now) - F.unix_timestamp(t)
    return F.coalesce(age > ttl_seconds, F.lit(True))


def freshest(
    log: DataFrame, key: str, payload: str, fetched: str, now: Column, ttl_seconds: int
) -> DataFrame:
    """Newest payload per key of a cache log, expired ones dropped. The newest
    row is found by a mergeable aggregate, not by sorting each key's rows."""
    newest = log.groupBy(key).agg(
        F.max(F.struct(fetched, payload)).alias("_m")
    )
    rows = newest.select(
        key, F.col(f"_m.{fetched}").alias(fetched), F.col(f"_m.{payload}").alias(payload)
    )
    return rows.where(~expired(F.col(fetched), now, ttl_seconds))


def known_mapping(mapping: DataFrame, key: str = "imdb_id", value: str = "tmdb_id") -> DataFrame:
    """Id mapping where 0 stands for `looked up, not there`."""
    return mapping.withColumn(value, F.nullif(F.col(value), F.lit(0)))


def fill_gaps(items: DataFrame, offers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keep existing values, take the offered one only for nulls. Offers are
    made unique per key first, so rows never multiply."""
    one = keep_one(offers.select(key, *columns), [key]).select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    types = {f.name: f.dataType for f in ITEM_SCHEMA}

    def filled(c: str) -> Column:
        new = F.col(f"_new_{c}")
        return F.coalesce(F.col(c), new.cast(types[c]) if c in types else new)

    joined = items.join(one, key, "left")
    return joined.select(
        *[filled(c).alias(c) if c in columns else F.col(c) for c in items.columns]
    )


def enrich(
    items: DataFrame, payloads: DataFrame, mapping: DataFrame | None = None,
    json_col: str = "payload",
) -> DataFrame:
    """Fill the gaps of an item table from payloads(tmdb_id, payload) and
    rebuild the documents. A missing tmdb_id is resolved through the mapping
    before the join, so such items are filled as well."""
    out = items
    if mapping is not None:
        found = keep_one(
            known_mapping(mapping).where(F.col("tmdb_id").isNotNull()), ["imdb_id"]
        ).select("imdb_id", F.col("tmdb_id").alias("_found"))
        out = out.join(found, "imdb_id", "left").withColumn(
            "_own", F.coalesce("tmdb_id", "_found")
        ).drop("_found")
    else:
        out = out.withColumn("_own", F.col("tmdb_id"))
    parsed = parsed_payload(payloads, json_col)
    fields = fill_fields(F.col("p"))
    offers = parsed.select(
        F.col("tmdb_id").alias("_own"), *[v.alias(n) for n, v in fields.items()]
    )
    # Only items with gaps need the payloads; the others pass through.
    out = out.withColumn("_key", F.when(has_gaps(), F.col("_own")))
    filled = fill_gaps(out, offers.withColumnRenamed("_own", "_key"), "_key", list(fields))
    filled = filled.withColumn("document", item_document())
    extra = [c for c in items.columns if c not in ITEM_COLUMNS]
    return filled.select(*extra, *ITEM_COLUMNS)


def with_details(items: DataFrame, payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Item detail view: payload values win when present, the item's own value
    stays otherwise."""
    p = F.col("p")
    details = keep_one(payloads.select("tmdb_id", json_col), ["tmdb_id"])
    joined = items.join(parsed_payload(details, json_col), "tmdb_id", "left")

    def newer(new: Column, old: str) -> Column:
        missing = new.isNull()
        if dict(items.dtypes)[old] == "string":
            missing = missing | blank(new)
        elif dict(items.dtypes)[old].startswith("array"):
            missing = missing | (F.size(new) == 0)
        else:
            missing = missing | (new == 0)
        return F.when(missing, F.col(old)).otherwise(new.cast(dict(items.dtypes)[old]))

    over = {
        "title": p["title"],
        "original_title": p["original_title"],
        "overview": p["overview"],
        "runtime_minutes": p["runtime"],
        "vote_count": p["vote_count"],
        "rating_value": p["vote_average"],
    }
    details = detail_fields(p)
    for shared in ("cast", "directors", "writers", "production_companies", "certification",
                   "trailer_url", "streaming_providers"):
        over[shared] = details.pop(shared)
    over = {n: v for n, v in over.items() if n in items.columns}
    cols = [newer(over[c], c).alias(c) if c in over else F.col(c) for c in items.columns]
    return joined.select(*cols, *[v.alias(n) for n, v in details.items()])
