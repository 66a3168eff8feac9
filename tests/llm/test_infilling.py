"""Fill-in-the-middle forms against plain slices, and exact round trips."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import infilling, queries

SF = "/root/testdata/sf0.01"
DOCS = "item_id long, document string, output string, `_key` string"


def plain(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", n, None, None, text
    p, m, s = text[:x], text[x:y], text[y:]
    if h[3] % 100 < 20:
        return "spm", n, x, y - x, f"<S>{s}<P>{p}<M>{m}"
    return "psm", n, x, y - x, f"<P>{p}<S>{s}<M>{m}"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "out", "key") for k, t in rows], DOCS)


ALPHABET = ["a", "B", " ", "\n", "\x00", "<", "P>", "S>", "M>", "é", "ß", "語", "Ａ", "🎬", "́", "𝒳"]


def test_rows_equal_plain_slices(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(ALPHABET, k=rng.randrange(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no key at all"), (None, "no key at all"), (7, "again"),
             (1002, "🎬" * 50), (1003, "plain ascii " * 300_000), (1004, "ü" * 1_500_000),
             (1005, "x<P"), (1006, "<S><P>"), (1007, "P>S>M><"), (-5, "minus")]
    found = infilling.infill_documents(docs_of(spark, rows).repartition(3))
    assert found.columns == ["item_id", "form", "n_chars", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(repr((k, *plain(k, t))) for k, t in rows)
    back = infilling.restore_documents(found).select("item_id", "document").collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((k, t or "")) for k, t in rows)


def test_forms_and_shares_follow_the_arguments(spark):
    rows = [(i, f"text number {i}") for i in range(500)]
    df = docs_of(spark, rows)
    counts = {r.form: r["count"] for r in infilling.infill_documents(df).groupBy("form").count().collect()}
    assert set(counts) == {"plain", "psm", "spm"} and 20 < counts["plain"] < 90
    every = infilling.infill_documents(df, infilled=100, suffix_first=100)
    assert {r.form for r in every.collect()} == {"spm"}
    assert {r.form for r in infilling.infill_documents(df, infilled=0).collect()} == {"plain"}
    other = infilling.infill_documents(df, seed=2).where("form != 'plain'").limit(500)
    assert other.join(infilling.infill_documents(df), ["item_id", "prefix_chars", "middle_chars"]).count() < 100


def test_index_converts_every_cut():
    for text in ("", "ascii only", "é", "aé語🎬b", "🎬🎬🎬", "ab" * 50 + "ü" + "c" * 70):
        data = np.frombuffer(text.encode(), np.uint8)
        index = infilling.Exceptions(data)
        points = np.arange(len(text) + 1)
        starts = np.array([len(text[:i].encode()) for i in points])
        assert (index.byte_of(points) == starts).all()
        assert (index.point_of(starts) == points).all()
        assert len(index.bytes) == sum(len(c.encode()) > 1 for c in text)


def test_empty_table_and_column_names(spark):
    df = docs_of(spark, [(1, "some text")])
    assert infilling.infill_documents(df.limit(0)).count() == 0
    named = df.select(F.col("item_id").cast("string").alias("the `id"), F.col("document").alias("a text"))
    row = infilling.infill_documents(named, key="the `id", text="a text").first()
    assert tuple(row) == ("1", *plain(1, "some text"))


def test_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        form, n, prefix, middle, output = plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (
            r.doc_id, n, form, prefix, middle, sha(output), sha(texts[r.doc_id] or ""),
        )
