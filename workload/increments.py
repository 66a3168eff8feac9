"""Vectors built and kept incrementally, change logs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import latest as L
from curatrix.plans import embedding as B, enrichment as E
from curatrix.session import scratch_path
from curatrix.sources import sinks
from curatrix.sources.delimited import spread
from curatrix.streaming import incremental as S
from curatrix.streaming.keyed import due_fetches

from . import query
from .fixtures import cte, full_items, items, log, table


def _documents(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("document"),
        F.col("n_chars").alias("popularity"),
    )
    return spread(docs)


@query(
    "e1_encode_documents",
    """select doc_id as item_id, 384 as dims, cast(regexp_matches(text, '[^\\s]') as int)::double
       as norm from documents""",
)
def e1(spark, sf):
    docs = _documents(spark, sf)
    done = B.encode_texts(docs, "item_id", "document")
    norm = F.aggregate(
        F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x
    )
    return done.select(
        "item_id", F.size("vector").alias("dims"), F.round(norm, 4).alias("norm")
    )


@query(
    "e2_resumed_build",
    "select doc_id as item_id, 1 as vectors from documents where trim(text) <> ''",
)
def e2(spark, sf):
    """A first run stops after the most popular; the second adds the rest."""
    store = scratch_path(spark, "vectors")
    docs = _documents(spark, sf)
    B.encode_new(docs, None, limit=100).write.parquet(store)
    B.encode_new(docs, spark.read.parquet(store)).write.mode("append").parquet(store)
    done = spark.read.parquet(store)
    return done.groupBy("item_id").agg(F.count("*").cast("int").alias("vectors"))


@query("e3_catalogue_vectors_a29", cte("items") + """select count(*) as total_vectors,
    384 as dimension, 0.0::double as norm_error from items""")
def e3(spark, sf):
    return B.run_summary(B.catalogue_vectors(items(spark, sf)))


@query(
    "a29_vector_summary",
    "select count(*) as total_vectors, max(len(embedding)) as dimension, round(max(abs(sqrt("
    "list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) - 1)), "
    "4) as norm_error from embeddings",
)
def a29(spark, sf):
    return B.run_summary(
        table(spark, sf, "embeddings").select(F.col("embedding").alias("vector"))
    )


@query(
    "p12_documents_to_encode",
    cte("items")
    + """select item_id from items where trim(regexp_replace(case when item_id % 4 = 1 then ' '
      else overview end, '\\s+', ' ', 'g')) <> '' order by popularity desc nulls last, item_id
      limit 300""",
)
def p12(spark, sf):
    rows = full_items(spark, sf).withColumn(
        "document", F.when(F.col("item_id") % 4 == 1, " ").otherwise(F.col("overview"))
    )
    return B.documents_to_encode(rows, limit=300).select("item_id")


@query(
    "p21_skip_encoded",
    """select o_orderkey, case when o_custkey % 9 = 0 then null else o_custkey end as item_id
       from orders where o_custkey % 9 = 0 or o_custkey not in
       (select c_custkey from customer where c_acctbal > 2000)""",
)
def p21(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("item_id"),
    )
    done = table(spark, sf, "customer").where("c_acctbal > 2000").select(
        F.col("c_custkey").alias("item_id")
    )
    return B.not_encoded(rows, done)


# --- change logs -----------------------------------------------------------
def _favourites(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "user_id", F.get_json_object("props", "$.k").alias("movie_id"), "ts", "event_id",
        "event_type",
    )


_STATE = """(select * from (select user_id, regexp_extract(props, '[0-9]+') as movie_id, ts,
    event_id, event_type, row_number() over (partition by user_id,
    regexp_extract(props, '[0-9]+') order by ts desc, event_id desc) as rn from events)
    where rn = 1 and event_type <> 'error')"""


@query(
    "e5_last_write_wins",
    f"""select user_id, movie_id, event_id, event_type, row_number() over (partition by user_id
        order by ts desc, event_id desc) as place from {_STATE}""",
)
def e5(spark, sf):
    alive = L.current_state(
        _favourites(spark, sf), ["user_id", "movie_id"], ["ts", "event_id"],
        F.col("event_type") == "error",
    )
    return L.newest_first(alive, "user_id", ["ts", "event_id"]).drop("ts")


_NOW = "timestamp '2024-01-31 00:00:00'"


@query(
    "e6_fresh_payloads",
    f"""select user_id, props from (select *, row_number() over (partition by user_id
        order by ts desc, props desc) as rn from events) where rn = 1
        and epoch({_NOW}) - floor(epoch(ts)) <= 86400 / 4""",
)
def e6(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("string"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return E.freshest(e, "user_id", "props", "ts", now, 86400 // 4).select("user_id", "props")


@query(
    "e6_negative_cache",
    "select event_id as imdb_id, nullif(user_id % 5, 0) as tmdb_id from events",
)
def e6_negative(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("imdb_id"), (F.col("user_id") % 5).alias("tmdb_id")
    )
    return E.known_mapping(e)


@query(
    "f39_expiry",
    f"""select event_id, event_id % 8 = 0 or epoch({_NOW}) - floor(epoch(ts)) > 604800 as expired
        from events""",
)
def f39(spark, sf):
    fetched = F.when(F.col("event_id") % 8 == 0, "yesterday").otherwise(
        F.col("ts").cast("string")
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", E.expired(fetched, now, 604800).alias("expired")
    )


@query(
    "w8_recent_searches",
    cte("log")
    + """, n as (select user_id, text, ts, query_id, row_number() over (partition by user_id,
        lower(trim(text)) order by ts desc, query_id desc) as rn from log where trim(text) <> '')
      select user_id, trim(text) as text, query_id, place from (select *, row_number() over (
        partition by user_id order by ts desc, query_id desc) as place from n where rn = 1)
      where place <= 10""",
)
def w8(spark, sf):
    done = L.recent_distinct(log(spark, sf), "user_id", "text", ["ts", "query_id"])
    return done.select("user_id", "text", "query_id", "place")


@query(
    "w9_guest_quota",
    """select user_id, event_id, place from (select user_id, event_id, row_number() over (
       partition by user_id order by ts, event_id) as place from events) where place <= 5""",
)
def w9(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return L.within_quota(rows, "user_id", ["ts", "event_id"]).drop("ts")


# --- streams ---------------------------------------------------------------
def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return S.table_stream(spark, f"{sf}/{name}.parquet", schema)


@query(
    "t1_stream_vector_build",
    "select doc_id as item_id, 1 as vectors from documents where trim(text) <> ''",
)
def t1(spark, sf):
    """A first source holds two thirds of the documents, a second one, with a
    checkpoint of its own, two thirds as well; each runs twice."""
    store, ckpt = scratch_path(spark, "store"), scratch_path(spark, "ckpt")
    for source in (0, 1):
        for _ in range(2):
            docs = _stream(spark, sf, "documents").where(F.col("doc_id") % 3 != source).select(
                F.col("doc_id").alias("item_id"), F.col("text").alias("document")
            )
            S.build_vectors(spark, docs, store, f"{ckpt}-{source}")
    done = S.read_store(spark, store)
    return done.groupBy("item_id").agg(F.count("*").cast("int").alias("vectors"))


@query(
    "t2_stream_vector_upsert",
    "select vec_id as item_id, len(embedding) as dims, 1 as copies from embeddings",
)
def t2(spark, sf):
    """The second source brings half known and half new ids; nothing that the
    first one stored is lost or repeated."""
    store, ckpt = scratch_path(spark, "store"), scratch_path(spark, "ckpt")
    for source in (0, 1):
        rows = _stream(spark, sf, "embeddings").where(F.col("vec_id") % 3 != source).select(
            F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
        )
        S.upsert_vectors(spark, rows, store, f"{ckpt}-{source}")
    done = S.read_store(spark, store)
    return done.groupBy("item_id").agg(
        F.max(F.size("vector")).cast("bigint").alias("dims"),
        F.count("*").cast("int").alias("copies"),
    )


@query(
    "t3_stream_favourites",
    f"select user_id, movie_id, event_id, event_type from {_STATE}",
)
def t3(spark, sf):
    """Two logs, each with part of the users, merge into one table."""
    store, ckpt = scratch_path(spark, "favourites"), scratch_path(spark, "ckpt")
    for part in (0, 1):
        rows = _stream(spark, sf, "events").where(F.col("event_id") % 2 == part).select(
            "user_id", F.get_json_object("props", "$.k").alias("movie_id"), "ts", "event_id",
            "event_type",
        )
        S.compact_log(rows, store, f"{ckpt}-{part}", ["user_id", "movie_id"], ["ts", "event_id"])
    state = sinks.read_buckets(spark, store)
    return state.where(F.col("event_type") != "error").drop("ts", "_bucket")


_TTL = 86_400


@query(
    "e6_stream_due_fetches",
    f"""with recursive e as (select distinct user_id, cast(floor(epoch(ts)) as bigint) as s
          from events where user_id is not null and ts is not null),
        later as (select user_id, s, min(s) over (partition by user_id order by s
          range between {_TTL + 1} following and unbounded following) as n from e),
        due as (select user_id, min(s) as s from e group by user_id
          union all select d.user_id, l.n from due d join later l
          on l.user_id = d.user_id and l.s = d.s where l.n is not null)
        select user_id, s from due""",
)
def e6_due(spark, sf):
    """Every event asks for its user's payload, which lives for a day: the
    requests that must fetch it, found by a stream that remembers its keys."""
    out, ckpt = scratch_path(spark, "due"), scratch_path(spark, "ckpt")
    asked = _stream(spark, sf, "events").select("user_id", "ts")
    due = due_fetches(asked, "user_id", "ts", _TTL)
    S.drain(due, ckpt, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.parquet(out).select("user_id", F.unix_timestamp("ts").alias("s"))
