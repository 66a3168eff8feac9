"""SimHash groups, components, neighbours and the pipeline."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_shingle_sets import plain_kept

import corpus_pipeline
from curatrix.llm import collision_hashing, components, queries, simhash
from curatrix.session import settle

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    """Least id reachable, of {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_every_near_pair_shares_a_table(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        apart = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(apart & m == 0 for m in masks)
    # Every table tells apart what differs: about half of the bits at least.
    assert min(m.bit_count() for m in masks) >= 31


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One two THREE", "É a b c d\x0be f", "x" * 9000, "w v " * 9000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, document string")
    got = {r["_key"]: r["_bits"] % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    # The shingle hash is the one that Spark itself offers.
    native = spark.sql("select xxhash64('one two three') as h").first().h % 2**64
    assert got[4] == native


def near_prints(n, seed):
    """Dense balls of fingerprints around a few centres."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = {}
    for i in range(n):
        bits = rng.choice(centres) if i % 3 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(7)):
            bits ^= 1 << b
        out[i * 7 % n] = bits
    return out


def test_exploded_fingerprints_are_not_broadcast(spark):
    """A row becomes one per table, which the sizes of the files do not show."""
    rows = [(i, 1 << i % 60) for i in range(50)]
    held = settle(spark.createDataFrame(rows, "_id long, _bits long"), "folded")
    links = simhash.near_links(held, 4)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    linked = {i for r in links.collect() for i in (r.a, r.b)}
    assert linked == set(range(50))


@pytest.mark.parametrize("chunk", [16, 8192])
def test_links_give_all_components(spark, chunk):
    prints = near_prints(500, chunk)
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    rows = [(i, b - 2**64 if b >> 63 else b) for b, i in first.items()]
    df = spark.createDataFrame(rows, "_id long, _bits long")
    links = simhash.near_links(df, 4, chunk=chunk)
    roots = {r.node: r.root for r in components.least_reachable(links).collect()}
    want = plain_groups(prints, 4)
    assert {i: roots.get(first[b], first[b]) for i, b in prints.items()} == want


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(2).shuffle(ids)
    links = list(zip(ids, ids[1:], strict=False)) + [(300, 300), (400, 401), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.least_reachable(df).collect()}
    assert got == {**{i: 0 for i in ids}, 400: 400, 401: 400}


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(5, None), (3, ""), (9, "a b c d e"), (9, "a b c d e"), (2, "A B c d e"), (None, "q r s"), (7, "q r s")]
    df = spark.createDataFrame(rows, "item_id long, document string").withColumn("a", F.lit(1)).withColumn("root", F.lit(2))
    got = sorted(
        (r.item_id or -1, r.component_id, r.links) for r in simhash.near_duplicates(df).collect()
    )
    assert got == [(-1, 7, 2), (2, 2, 3), (3, 3, 2), (5, 3, 2), (7, 7, 2), (9, 2, 3), (9, 2, 3)]
    kept = simhash.keep_representatives(df)
    assert set(kept.columns) == set(df.columns)
    assert sorted(r.item_id or -1 for r in kept.collect()) == [-1, 2, 3, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_op5_equals_brute_force(spark):
    got = queries.QUERIES["op5_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_groups(prints, 4)


# --- neighbours ------------------------------------------------------------
def brute(ids, vectors, queries_at, k):
    out = {}
    for q in queries_at:
        order = sorted((-(vectors[q] @ v), i) for i, v in zip(ids, vectors, strict=True) if i != ids[q])
        out[ids[q]] = [(i, -s) for s, i in order[:k]]
    return out


@pytest.mark.parametrize("segment,block", [(16_384, 4096), (900, 40)])
def test_recall_against_brute_force(spark, segment, block):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    items = table.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    asked = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    rows = items.collect()
    ids = [r.item_id for r in rows]
    vectors = np.array([r.vector for r in rows], dtype=float)
    want = brute(ids, vectors, [n for n, i in enumerate(ids) if i % 20 == 0], 20)
    found = collision_hashing.nearest_by_collisions(asked, items, 20, segment=segment, query_block=block).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.score))
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda x: (-x[1], x[0]))
        hits += len({m[1] for m in mine} & {n[0] for n in near})
        at = {i: n for n, i in enumerate(ids)}
        for _, i, score in mine:
            assert abs(score - vectors[at[q]] @ vectors[at[i]]) < 1e-12
    assert hits / (20 * len(want)) >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [3.0, 1.0]), (3, [3.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "item_id long, vector array<float>").withColumn("score", F.lit("x"))
    asked = df.withColumnRenamed("item_id", "query_id")
    got = collision_hashing.nearest_by_collisions(asked, df, k=2).collect()
    near = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        near.setdefault(r.query_id, []).append((r.item_id, r.score))
    assert near == {
        1: [(2, 3.0), (3, 3.0)],
        2: [(3, 10.0), (1, 3.0)],
        3: [(2, 10.0), (1, 3.0)],
        10: [(1, -1.0), (2, -3.0)],
    }
    assert collision_hashing.nearest_by_collisions(asked, df.limit(0)).count() == 0
    assert collision_hashing.nearest_by_collisions(asked.limit(0), df).count() == 0


# --- pipeline --------------------------------------------------------------
def test_pipeline_keeps_what_plain_steps_keep(spark):
    from curatrix.llm import decontaminate, deobfuscate, pieces, quality_crf

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.collect()
    columns = docs.columns
    texts = {r.doc_id: r.text or "" for r in held}
    model = quality_crf.fitted_quality(
        corpus_pipeline._as_items(docs), queries.judgements(spark, SF), "item_id", "document",
        "quality", None, quality_crf.FIT_ROWS, quality_crf.FIT_CHARS,
    )
    ids = sorted(texts)
    scores = model.score([texts[i] for i in ids])
    kept = {i: texts[i] for i, s in zip(ids, scores, strict=True) if s >= quality_crf.THRESHOLD}
    first = plain_kept(kept)
    kept = {i: t for i, t in kept.items() if i in first}
    tests = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in decontaminate.normalise(t) for x in tests)}
    kept = {i: deobfuscate.redact(t) for i, t in kept.items()}
    vocabulary = pieces.Vocabulary.load()
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: pieces.decode_ids(vocabulary, r.pieces) for r in got} == kept
    assert all(r.lossless for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "mail a@b.cc", "en", "s", 11), (3, "mail a@b.cc", "en", "s", 11)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 4
    clean = corpus_pipeline.personal_data(spark, docs, SF).collect()
    assert sorted((r.text or "", r.n_chars or 0) for r in clean) == [("", 0), ("", 0), ("mail [email]", 12), ("mail [email]", 12)]
