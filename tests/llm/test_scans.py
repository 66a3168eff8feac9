"""Secrets, identifiers, test items and licences against plain versions."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from curatrix.llm import common, decontaminate, deobfuscate, licences, queries, secret_scan

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, document string, kind string, start int, `_key` string, `_text` string"


def items(spark, texts):
    rows = [(i, t, "x", 1, "k", "t") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEMS)


def spans(rows, column, origin=None):
    return {
        r.item_id: [
            (s.kind, s.start, s.end) for s in r[column] if origin in (None, s.origin)
        ]
        for r in rows
    }


# --- secrets ---------------------------------------------------------------
BASE = {
    "assign": (
        r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def plain_secrets(text):
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_trigram_queries_are_mandatory():
    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        if rule.kind == "hex":
            assert query is None
        else:
            assert secret_scan.trigrams_of(query)
    assert secret_scan.trigram_query("ab") is None
    assert secret_scan.trigram_query("(abc|xy)") is None
    assert secret_scan.trigram_query("Abc[0-9]+") == "abc"
    assert secret_scan.trigram_query("abc.*xyz") == ("and", ("abc", "xyz"))
    kind, either = secret_scan.trigram_query("a[bc]d")
    assert kind == "or" and set(either) == {"abd", "acd"}


def test_candidates_lose_no_match():
    rng = random.Random(1)
    parts = ["token", "API_KEY", "passwd", "=", ":", '"', " ", "AKIA", "x9", "abcdef0123", "ſecret", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    found = secret_scan.scan_texts(texts)
    for text, got in zip(texts, found, strict=True):
        assert [(s["kind"], s["start"], s["end"]) for s in got if s["origin"] == "base"] == plain_secrets(text)


def test_secrets_of_awkward_rows(spark):
    texts = [None, "", "é😀 Token: 'abcdefgh12'", "token=short", "ghp_" + "G" * 36, "z " * 200_000]
    texts.append("-----BEGIN RSA PRIVATE KEY-----")
    got = spans(secret_scan.find_secrets(items(spark, texts)).collect(), "secrets")
    assert got[0] == got[1] == got[3] == got[5] == []
    assert got[2] == [("assign", 3, 21)] and got[4] == [("repository", 0, 40)]
    assert got[6] == [("pem", 0, 31)]
    assert secret_scan.find_secrets(items(spark, texts).limit(0)).count() == 0
    twice = items(spark, texts).unionAll(items(spark, texts))
    assert secret_scan.find_secrets(twice).count() == 14


def test_op1_over_the_table(spark):
    rows = queries.QUERIES["op1_secret_scan"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_secrets(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[0] == k for w in want) for k in BASE)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


# --- identifiers -----------------------------------------------------------
def plain_identifiers(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and deobfuscate.luhn(d):
            found.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return sorted(found)


def test_identifiers_equal_the_plain_expressions():
    rng = random.Random(2)
    parts = ["a.b", "@", "x-1", ".", "com", "10", "255", "256", " ", "-", "+", "(", ")", "4111", "1", "é", "@@"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert sorted(deobfuscate.identifiers(text)) == plain_identifiers(text), text
        base = [(k, s, e) for k, s, e, o in deobfuscate.find_in_text(text) if o == "base"]
        assert base == plain_identifiers(text)


@pytest.mark.parametrize(
    "text,kind,hidden",
    [
        ("mail jo.e [at] example [dot] com now", "email", "jo.e [at] example [dot] com"),
        ("write joe at example dot co dot uk", "email", "joe at example dot co dot uk"),
        ("é joe(at)example.com", "email", "joe(at)example.com"),
        ("jое@ехample.com", "email", "jое@ехample.com"),
        ("joe@exa​mple.com", "email", "joe@exa​mple.com"),
        ("call plus four four two zero seven nine four six oh nine five eight", "phone",
         "plus four four two zero seven nine four six oh nine five eight"),
        ("host one nine two dot one six eight dot one dot five", "ip",
         "one nine two dot one six eight dot one dot five"),
        ("card ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, hidden):
    found = deobfuscate.find_in_text(text)
    assert [(deobfuscate.KINDS[k], text[s:e], o) for k, s, e, o in found] == [(kind, hidden, "added")]


def test_plain_prose_is_left_alone():
    for text in ("look at the dot. com", "one two three", "we met at noon.Then left", "zero at one dot"):
        assert deobfuscate.find_in_text(text) == []
        assert deobfuscate.redact(text) == text


def test_identifiers_of_awkward_rows(spark):
    texts = [None, "", "a@b.cc", "9" * 100_000, "+1" + " " * 100_000, "x" * 100_000 + "@"]
    df = items(spark, texts)
    got = spans(deobfuscate.find_identifiers(df).collect(), "identifiers")
    assert got == {0: [], 1: [], 2: [("email", 0, 6)], 3: [], 4: [], 5: []}
    redacted = deobfuscate.redact_identifiers(df)
    assert redacted.columns == df.columns
    assert {r.item_id: r.document for r in redacted.collect()} == dict(
        enumerate([None, "", "[email]", *texts[3:]])
    )
    assert deobfuscate.find_identifiers(df.limit(0)).count() == 0


def test_op4_over_the_table(spark):
    rows = queries.QUERIES["op4_pii"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_identifiers(texts[r.doc_id])
        joined = ",".join(f"{deobfuscate.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[0] == k for w in want) for k in range(4))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


# --- test items ------------------------------------------------------------
def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abc ")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abc"))
    return "".join(out)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
        want = distance_in(p, t)
        got = decontaminate.best_end(p, t, want)
        if want < len(p):
            assert got[0] == want
            assert distance_in(p, t[: got[1]]) == want and distance_in(p, t[: got[1] - 1]) > want


def test_passages_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 8)))
    tests = [" ".join(word() for _ in range(rng.randrange(8, 30))) for _ in range(6)]
    docs = []
    for i in range(60):
        body = " ".join(word() for _ in range(40))
        if i % 2:
            hidden = edited(rng, tests[i % 6], rng.randrange(12))
            body = f"{body} {hidden.upper() if i % 3 else hidden}\n{body[:20]}"
        docs.append(body)
    probes = spark.createDataFrame(list(enumerate(tests)), "query_id long, text string")
    got = decontaminate.find_test_items(items(spark, docs), probes).collect()
    want = {}
    for d, body in enumerate(docs):
        for q, test in enumerate(tests):
            best = distance_in(decontaminate.normalise(test), decontaminate.normalise(body))
            if best <= decontaminate.budget(len(decontaminate.normalise(test))):
                want[d, q] = best
    assert {(r.item_id, r.query_id): r.distance for r in got} == want and len(want) > 10
    for r in got:
        words = decontaminate.normalise(docs[r.item_id]).split(" ")
        passage = " ".join(words[r.first_word : r.last_word + 1])
        assert distance_in(decontaminate.normalise(tests[r.query_id]), passage) == r.distance
    # Blocks without a hit stand between others in one task.
    monkeypatch.setattr(decontaminate, "blocks", lambda batches: common.blocks(batches, 300))
    small = decontaminate.find_test_items(items(spark, docs).coalesce(1), probes).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    many = decontaminate.find_test_items(items(spark, docs), probes, pass_chars=100).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, got))


def test_test_items_of_awkward_rows(spark):
    docs = items(spark, [None, "", "say the word now", "sword", "x " * 100_000, "same same same same same text"])
    probes = spark.createDataFrame(
        [(1, "word"), (1, "word"), (2, None), (3, " "), (4, "Same same same same  same text")],
        "query_id long, text string",
    )
    got = decontaminate.find_test_items(docs, probes).collect()
    assert sorted((r.item_id, r.query_id) for r in got) == [(2, 1), (5, 4)]
    assert decontaminate.find_test_items(docs, probes.limit(0)).count() == 0
    assert decontaminate.find_test_items(docs.limit(0), probes).count() == 0
    kept = decontaminate.without_test_items(docs, probes)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(r.item_id for r in kept.collect()) == [0, 1, 3, 4]


# --- licences --------------------------------------------------------------
def test_licences_equal_sql(spark):
    texts = [
        None,
        "",
        "Licensed under the Apache License, Version 2.0.",
        "intro\nreleased UNDER the mit   license!\nthis work is licensed under the gnu general public license, version 3",
        "Licensed under the\nApache License, Version 2.0\n\nmore text",
        "a\n\nPermission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the Software to deal in the Software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies "
        "of the Software and to permit persons to whom the Software is furnished to do so",
        "license " * 5000,
        "Licensed under the Apache License",
        "under the license public software",
    ]
    df = items(spark, texts)
    got = sorted(map(tuple, licences.find_licences(df).collect()))
    con = duckdb.connect()
    con.execute("create table t (item_id bigint, document varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(licences.duckdb_sql("t", "item_id", "document")).fetchall())
    assert got == want
    assert {(r[0], r[3]) for r in got} >= {(2, "apache-2.0"), (3, "mit"), (3, "gpl-3.0"), (4, "apache-2.0"), (5, "mit")}
    assert licences.find_licences(df.limit(0)).count() == 0
    assert licences.find_licences(df.unionAll(df)).count() == 2 * len(got)


def test_anchor_words_are_in_every_near_text():
    rows = licences.template_rows(licences.TEMPLATES)
    anchors = licences.anchor_words(rows)
    for _, grams in rows:
        held = [g for g in grams if any(a in g for a in anchors)]
        assert 3 * (len(grams) - len(held)) < 2 * len(grams)


def test_licences_stay_native(spark):
    plan = licences.find_licences(items(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, "a@b.cc token=abcdefgh9")], "item_id long, document string")
    assert secret_scan.find_secrets(df).first().item_id is None
    assert deobfuscate.find_identifiers(df).where(F.col("item_id").isNull()).count() == 1


@pytest.mark.parametrize("text", ["foo bar", "foo bar foo", "foobar", "xfoo bar foo bar", "xfoo bar foo bary",
                                  "foo barfoo bar foo bar", "a foo bar. foo bar", "foo foo bar"])
def test_short_items_are_tried_at_every_place(text):
    """Hits that touch, or stand next to ones that are no whole words."""
    found = decontaminate.TestItems.build(["foo bar"], decontaminate.ERROR_RATE).matches(text)
    want = [m.start(1) for m in re.finditer(r"(?<![^ ])(?=(foo bar)(?![^ ]))", text)]
    assert found == [(0, 0, at, at + 7) for at in want[:1]]
