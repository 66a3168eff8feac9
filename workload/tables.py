"""Scans, sinks, counts, samples, change logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from curatrix.functions.scores import l2_normalise
from curatrix.operators.grouping import top_k
from curatrix.operators.latest import random_sample
from curatrix.operators.vectors import new_vectors
from curatrix.plans.conform import rating_stats
from curatrix.session import scratch_path
from curatrix.sources import delimited, manifest, sinks

from . import query
from .fixtures import TABLES, cte, full_items, items, table, vectors


@query(
    "s1_source_manifest",
    "select * from (values "
    + ", ".join(f"('{t}.parquet', 'present')" for t in TABLES[1:])
    + f""", ('{TABLES[0]}.parquet', 'unexpected'), ('absent.csv', 'missing')) t(file, state)""",
)
def source_manifest(spark, sf):
    """The folder's name is the provider; its tables are files."""
    provider = sf.rstrip("/").rsplit("/", 1)[-1].lower()
    wanted = {provider: [f"{t}.parquet" for t in TABLES[1:]] + ["absent.csv"], "other": ["x.csv"]}
    found = manifest.found_files(spark, sf)
    return manifest.check_manifest(found, wanted).select("file", "state")


@query(
    "s2_dialect_report",
    """select * from (values ('nation_comma', 'utf-8', ','), ('nation_tab', 'utf-8', chr(9)),
       ('nation_semicolon', 'utf-8', ';'), ('nation_pipe', 'latin-1', '|'))
       t(folder, encoding, delimiter)""",
)
def dialect_report(spark, sf):
    root = scratch_path(spark, "dialect")
    nation = table(spark, sf, "nation")
    seps = {"comma": ",", "tab": "\t", "semicolon": ";"}
    for name, sep in seps.items():
        nation.coalesce(1).write.option("header", True).option("sep", sep).csv(
            f"{root}/nation_{name}"
        )
    accented = nation.withColumn("n_name", F.concat("n_name", F.lit("é")))
    accented.coalesce(1).write.option("header", True).option("sep", "|").option(
        "encoding", "ISO-8859-1"
    ).csv(f"{root}/nation_pipe")
    found = delimited.dialects(spark, root, "*.csv")
    return found.select("folder", "encoding", "delimiter").distinct()


_CUSTOMER = """select c_custkey, case when c_custkey % 10 = 0 then null else c_name end as c_name,
    c_nationkey, c_acctbal, case when c_custkey % 7 = 3 then null else c_mktsegment end
    as c_mktsegment from customer"""


def _marked_customers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 10 == 0, "\\N").otherwise(F.col("c_name")).alias("c_name"),
        "c_nationkey",
        "c_acctbal",
        F.when(F.col("c_custkey") % 7 == 3, "NA")
        .otherwise(F.col("c_mktsegment"))
        .alias("c_mktsegment"),
    )


def _scan_back(spark, sf, sep):
    root = scratch_path(spark, "scan")
    rows = _marked_customers(spark, sf)
    rows.write.option("header", True).option("sep", sep).option("compression", "gzip").csv(root)
    ddl = (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    )
    return delimited.spread_gzip(delimited.read_delimited(spark, root, ddl, sep))


@query("s3_scan_tab_separated", _CUSTOMER)
def scan_tab(spark, sf):
    return _scan_back(spark, sf, "\t")


@query("s3_scan_comma_separated", _CUSTOMER)
def scan_comma(spark, sf):
    return _scan_back(spark, sf, ",")


@query(
    "s8_load_statistics",
    " union all ".join(
        f"select '{t}' as \"table\", count(*) as row_count, "
        f"(select count(*) from information_schema.columns where table_name = '{t}') "
        f"as column_count from {t}"
        for t in TABLES
    ),
)
def load_statistics(spark, sf):
    parts = [
        delimited.load_statistics(table(spark, sf, t), t).select(
            "table", "row_count", F.col("column_count").cast("bigint").alias("column_count")
        )
        for t in TABLES
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "s9_parquet_scan_columns",
    "select l_orderkey, l_quantity from lineitem where l_quantity > 45 and l_discount < 0.03",
)
def parquet_scan(spark, sf):
    rows = delimited.read_parquet(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_discount"]
    )
    return rows.where((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03)).select(
        "l_orderkey", "l_quantity"
    )


@query(
    "s10_parquet_sink",
    "select p_type, count(*) as n, cast(sum(p_size) as bigint) as sizes from part group by p_type",
)
def parquet_sink(spark, sf):
    path = scratch_path(spark, "part")
    sinks.write_parquet(table(spark, sf, "part"), path, ["p_type"])
    back = spark.read.parquet(path)
    return back.groupBy("p_type").agg(
        F.count("*").alias("n"), F.sum("p_size").cast("bigint").alias("sizes")
    )


_FLAT = """select item_id, title, array_to_string(genres, '|') as genres,
    array_to_string(people, '|') as people, array_to_string(keywords, '|') as keywords from items"""


def _nested(spark, sf):
    return items(spark, sf).select(
        "item_id", "title", "genres", F.col("cast").alias("people"), "keywords"
    )


@query("s11_csv_sink", cte("items") + _FLAT)
def csv_sink(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv(_nested(spark, sf), path)
    ddl = "item_id bigint, title string, genres string, people string, keywords string"
    return delimited.read_delimited(spark, path, ddl)


@query("s12_ndjson_sink", cte("items") + _FLAT)
def ndjson_sink(spark, sf):
    path = scratch_path(spark, "json")
    rows = _nested(spark, sf)
    sinks.write_ndjson(rows, path)
    return sinks.flat_lists(spark.read.schema(rows.schema).json(path))


@query(
    "s13_report_sink",
    "select o_orderstatus, count(*) as orders from orders group by o_orderstatus",
)
def report_sink(spark, sf):
    path = scratch_path(spark, "report")
    report = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    sinks.write_report(report, path)
    return spark.read.schema("o_orderstatus string, orders bigint").json(path)


@query(
    "s14_audit_append",
    "select event_type, 2 * count(*) as entries from events group by event_type",
)
def audit_append(spark, sf):
    path = scratch_path(spark, "audit")
    entries = table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_audit(entries, path)
    sinks.append_audit(entries, path)
    back = spark.read.schema("event_id bigint, event_type string").json(path)
    return back.groupBy("event_type").agg(F.count("*").alias("entries"))


@query(
    "s15_rewrite_in_place",
    "select s_suppkey, round(s_acctbal * 4, 2) as s_acctbal from supplier",
)
def rewrite_in_place(spark, sf):
    store = scratch_path(spark, "supplier")
    start = table(spark, sf, "supplier").select(
        "s_suppkey", F.round(F.col("s_acctbal"), 2).alias("s_acctbal")
    )
    sinks.new_version(start, store)
    for _ in range(2):
        old = sinks.read_current(spark, store)
        sinks.new_version(old.withColumn("s_acctbal", F.col("s_acctbal") * 2), store)
    return sinks.read_current(spark, store).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query(
    "s16_vector_upsert",
    """select vec_id as item_id, round(list_sum(list_transform(embedding, lambda x:
         cast(x as double) / greatest(sqrt(list_sum(list_transform(embedding,
         lambda y: cast(y as double) * y))), 1e-12))), 6) as total,
         case when label < 5 then 'stored' else 'new' end as origin from embeddings""",
)
def vector_upsert(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label"
    )
    stored = rows.where(F.col("label") < 5).select(
        "item_id", l2_normalise(F.col("vector")).alias("vector")
    )
    twice = rows.select("item_id", "vector").unionByName(rows.select("item_id", "vector"))
    fresh = new_vectors(twice, stored, "item_id")
    both = stored.withColumn("origin", F.lit("stored")).unionByName(
        fresh.withColumn("origin", F.lit("new"))
    )
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return both.select("item_id", F.round(total, 6).alias("total"), "origin")


@query("a1_row_count", "select count(*) as row_count from lineitem")
def row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("row_count"))


@query(
    "a2_mean_and_count",
    """select l_partkey, round(avg(l_quantity), 8) as rating_value,
       count(l_quantity) as vote_count from lineitem group by l_partkey""",
)
def mean_and_count(spark, sf):
    stats = rating_stats(table(spark, sf, "lineitem"), "l_partkey", "l_quantity")
    return stats.withColumn("rating_value", F.round("rating_value", 8))


@query(
    "l1_top_by_popularity",
    cte("items")
    + "select item_id, popularity from items order by popularity desc nulls last, item_id limit 50",
)
def top_by_popularity(spark, sf):
    return (
        items(spark, sf)
        .select("item_id", "popularity")
        .orderBy(F.col("popularity").desc_nulls_last(), "item_id")
        .limit(50)
    )


@query(
    "l2_ordered_head",
    "select o_orderkey, o_totalprice from orders order by o_orderdate, o_orderkey limit 100",
)
def ordered_head(spark, sf):
    rows = table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(100)
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "l3_heuristic_top",
    cte("items")
    + """select item_id, language, rank from (
      select item_id, languages[1] as language, row_number() over (partition by languages[1]
        order by coalesce(popularity, 0) * coalesce(rating_value, 0) desc, item_id) as rank
      from items) where rank <= 50""",
)
def heuristic_top(spark, sf):
    from curatrix.plans.assembly import first_cut

    rows = items(spark, sf).withColumn("query_id", F.get("languages", 0))
    top = first_cut(rows)
    return top.select("item_id", F.col("query_id").alias("language"), "rank")


@query(
    "l6_random_sample",
    "select p_partkey, p_name from part order by md5(cast(p_partkey as varchar) || ':7'), "
    "p_partkey limit 24",
)
def sample(spark, sf):
    return random_sample(
        table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 24, seed=7
    )


@query(
    "p20_poster_sample",
    cte("items")
    + """select item_id, poster_path from items where poster_path is not null
         and poster_path <> '' order by md5(cast(item_id as varchar) || ':0'), item_id limit 48""",
)
def poster_sample(spark, sf):
    rows = items(spark, sf).select("item_id", "poster_path")
    rows = rows.where(F.col("poster_path").isNotNull() & (F.col("poster_path") != ""))
    return random_sample(rows, "item_id", 48)


@query(
    "u1_union_all",
    """select c_nationkey as nation, c_acctbal as balance from customer
       union all select s_nationkey, s_acctbal from supplier""",
)
def union_all(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_nationkey nation", "c_acctbal balance")
    b = table(spark, sf, "supplier").selectExpr("s_nationkey nation", "s_acctbal balance")
    return a.unionByName(b)


@query(
    "u2_union_distinct_keys",
    """select user_id, event_type, min(event_id) as event_id from (
         select user_id, event_type, event_id from events
         union all select user_id, event_type, event_id + 1000000000 from events)
       group by user_id, event_type""",
)
def union_distinct(spark, sf):
    from curatrix.operators.grouping import keep_one

    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    later = e.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return keep_one(e.unionByName(later), ["user_id", "event_type"], ["event_id"])


@query(
    "u3_append_to_store",
    "select label, count(*) as vectors from embeddings group by label",
)
def append_to_store(spark, sf):
    path = scratch_path(spark, "store")
    rows = table(spark, sf, "embeddings")
    rows.where(F.col("label") < 3).write.parquet(path)
    done = spark.read.parquet(path).select("vec_id")
    rows.join(done, "vec_id", "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("vectors"))


@query(
    "u4_distinct_id_set",
    """select o_custkey as id from orders where o_totalprice > 450000
       union select c_custkey from customer where c_acctbal > 9000""",
)
def distinct_ids(spark, sf):
    a = table(spark, sf, "orders").where("o_totalprice > 450000").selectExpr("o_custkey id")
    b = table(spark, sf, "customer").where("c_acctbal > 9000").selectExpr("c_custkey id")
    return a.union(b).distinct()


@query(
    "u5_list_overlaps",
    cte("items")
    + """select i.item_id, list_sort(list_distinct(list_filter(coalesce(i.keywords, []),
      lambda k: not list_contains(coalesce(i.genres, []), k)))) as spare,
      list_has_any(coalesce(i.genres, []), ['Drama', 'Horror']) as bleak,
      len(list_intersect(coalesce(i.people, []), ['Supplier#000000001', 'Supplier#000000003']))
        as shared from items i""",
)
def list_overlaps(spark, sf):
    empty = F.array().cast("array<string>")
    g, k = F.coalesce("genres", empty), F.coalesce("keywords", empty)
    named = F.array(F.lit("Supplier#000000001"), F.lit("Supplier#000000003"))
    return items(spark, sf).select(
        "item_id",
        F.array_sort(F.array_except(k, g)).alias("spare"),
        F.arrays_overlap(g, F.array(F.lit("Drama"), F.lit("Horror"))).alias("bleak"),
        F.size(F.array_intersect(F.coalesce("cast", empty), named)).cast("bigint").alias("shared"),
    )


@query(
    "w4_rank_per_group",
    """select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey,
       row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank
       from orders) where rank <= 3""",
)
def rank_per_group(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", "rank")


@query(
    "p22_canonical_projection",
    cte("items")
    + """select title, tmdb_id, array_to_string(coalesce(genres, []), ',') as genres,
         round(coalesce(popularity, 0) / 7, 4) as final_score,
         rating_value as rating, vote_count, popularity from items""",
)
def debug_projection(spark, sf):
    return full_items(spark, sf).select(
        "title",
        "tmdb_id",
        F.array_join(F.coalesce("genres", F.array().cast("array<string>")), ",").alias("genres"),
        F.round(F.coalesce("popularity", F.lit(0.0)) / 7, 4).alias("final_score"),
        F.col("rating_value").alias("rating"),
        "vote_count",
        "popularity",
    )


@query(
    "j12_items_with_vectors",
    cte("items")
    + """select i.item_id, i.title, len(e.embedding) as dims from items i
         left join embeddings e on e.vec_id = i.item_id""",
)
def items_with_vectors(spark, sf):
    v = vectors(spark, sf).select("item_id", F.size("vector").cast("bigint").alias("dims"))
    return items(spark, sf).select("item_id", "title").join(v, "item_id", "left")
