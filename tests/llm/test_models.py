"""Classifiers, the language model, the piece lattice: accuracy and exactness."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import language_model as lm, pieces, quality_crf, queries, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "item_id long, document string, score string, `_key` string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], DOCS)


# --- quality ---------------------------------------------------------------
def all_paths(emit, move):
    weights = {}
    for path in itertools.product((0, 1), repeat=len(emit)):
        w = sum(emit[t, y] for t, y in enumerate(path))
        w += sum(move[a, b] for a, b in itertools.pairwise(path))
        weights[path] = math.exp(w)
    return weights


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 1, 5])
    emit, move = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    single, pairs, total = quality_crf.marginals(emit, move, lengths)
    seen = np.zeros((2, 2))
    for n, start, z in zip(lengths, np.cumsum(lengths) - lengths, total, strict=True):
        if not n:
            continue
        paths = all_paths(emit[start : start + n], move)
        norm = sum(paths.values())
        assert math.isclose(z, math.log(norm))
        for t in range(n):
            want = sum(w for p, w in paths.items() if p[t] == 1) / norm
            assert math.isclose(single[start + t, 1], want)
        for p, w in paths.items():
            for a, b in itertools.pairwise(p):
                seen[a, b] += w / norm
    assert np.allclose(pairs, seen)


GOOD = "The river runs past the old mill and the houses.\nPeople walk there in the evening, slowly."
BAD = "BUY!! NOW!! BUY!! NOW!! CHEAP!!\n*** %%% $$$ ### win*** win*** win*** win***"


def judged(spark, n=60):
    texts = [f"{GOOD} {i}" if i % 2 else f"{BAD} {i}" for i in range(n)]
    labels = spark.createDataFrame(
        [(i, i % 2, 1 - i % 2) for i in range(n)] + [(None, 1, 1), (3, None, None)],
        "item_id long, quality int, toxic int",
    )
    return texts, labels


@pytest.mark.parametrize(
    "score,label", [(quality_crf.score_quality, "quality"), (toxicity.score_toxicity, "toxic")]
)
def test_classifiers_on_awkward_rows(spark, score, label):
    texts, labels = judged(spark)
    extra = [None, "", " \n ", GOOD, BAD, "word " * 60_000]
    df = docs_of(spark, texts + extra)
    rows = {r.item_id: r for r in score(df, labels).collect()}
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[60].score == rows[61].score == rows[62].score
    high, low = (63, 64) if label == "quality" else (64, 63)
    assert rows[high].score > 0.5 > rows[low].score
    assert score(df.limit(0), labels).count() == 0
    none = score(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    twice = docs_of(spark, [GOOD]).unionAll(docs_of(spark, [GOOD]))
    assert score(twice, labels).count() == 2


def test_good_documents_are_kept(spark):
    texts, labels = judged(spark)
    df = docs_of(spark, [*texts, GOOD, BAD])
    kept = quality_crf.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = {r.item_id for r in kept.collect()}
    assert 60 in ids and 61 not in ids and len(ids) == 31


def test_quality_learns_from_every_label(spark):
    """What only texts beyond the size of a group's average and beyond the rows
    of one group say is learnt, too."""
    texts, labels = judged(spark)
    long = [f"{t} {i}\n" * 40 for i, t in enumerate(texts)]
    df = docs_of(spark, [*long, GOOD, BAD])
    args = ("item_id", "document", "quality", None)
    model = quality_crf.fitted_quality(df, labels, *args, 10, 1000)
    assert model.score([GOOD])[0] > 0.5 > model.score([BAD])[0]
    # One group fits what plain fitting of all pairs fits.
    whole = quality_crf.fitted_quality(df, labels, *args, 60, 16_000)
    plain = quality_crf.fit([(t, i % 2) for i, t in enumerate(long)])
    assert np.allclose(whole.weights, plain.weights) and np.allclose(whole.move, plain.move)
    assert math.isclose(whole.slope, plain.slope) and math.isclose(whole.bias, plain.bias)
    one_class = quality_crf.fitted_quality(df, labels.where("quality = 1"), *args, 10, 16_000)
    assert (one_class.score([GOOD, BAD]) > 0.9).all()


@pytest.mark.parametrize(
    "name,modulus,value,label,least",
    [("op2_quality_classifier", 3, 1, "quality", 0.95), ("op6_toxicity", 4, 2, "toxic", 0.9)],
)
def test_held_out_accuracy(spark, name, modulus, value, label, least):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == value)
    scored = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good = [s for s, y in scored if y == 1]
    bad = [s for s, y in scored if y == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert area >= least


# --- language model --------------------------------------------------------
def test_slot_probabilities_sum_to_one():
    model = lm.Model.start(np.full(lm.SLOTS, 1 / lm.SLOTS))
    model.read += np.random.default_rng(0).normal(size=model.read.shape).astype(np.float32)
    near, far, bias, norm = model.tables()
    for a, b in ((0, 5), (lm.SLOTS, lm.SLOTS), (7, 900)):
        assert abs(np.exp(far[a] + near[b] + bias - norm[a, b]).sum() - 1) < 1e-4


def test_words_of_a_slot_share_it():
    """Within every slot the words seen and one unknown word have all mass."""
    counts = Counter(b"a b c d a a xing ying zing".split())
    words = lm.Words(9, len(counts), {}, np.zeros(lm.SLOTS), np.zeros(lm.SLOTS))
    for w, c in counts.items():
        words.slot_tokens[lm.ending_slot(w)] += c
        words.slot_words[lm.ending_slot(w)] += 1
    inner = words.inner()
    for slot in {lm.ending_slot(w) for w in counts}:
        held = sum(c + 1 for w, c in counts.items() if lm.ending_slot(w) == slot) + 1
        assert math.isclose(10 ** inner[slot], held)


def plain_base(train, texts):
    counts = Counter()
    for t in train:
        counts.update((t or "").encode().lower().split())
        counts[b" "] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((len(words), sum(counts[w] > 0 for w in words), n, base))
    return out


def test_base_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(30))) for _ in range(80)]
    texts += [None, "", "Ünknown \x0bÉ  A B", "long" * 40 + " " + "long" * 40, texts[0]]
    df = docs_of(spark, texts)
    # A tiny head, so that most words take the way of the join.
    gather = lm.Words.gather.__func__
    monkeypatch.setattr(lm.Words, "gather", classmethod(lambda cls, c: gather(cls, c, head=5)))
    learn = F.col("_key") % 3 != 0
    rows = {r.item_id: r for r in lm.score_texts(df, learn=learn).collect()}
    want = plain_base([t for i, t in enumerate(texts) if i % 3], texts)
    assert len(rows) == len(texts)
    for i, (n, known, total, base) in enumerate(want):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = queries.QUERIES["op9_lm_scoring"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_awkward_tables(spark):
    df = docs_of(spark, ["a b", None])
    assert lm.score_texts(df.limit(0)).count() == 0
    unseen = lm.score_texts(df, learn=F.lit(False)).collect()
    assert [(r.train_tokens, r.n_known) for r in unseen] == [(0, 0), (0, 0)]
    keyless = spark.createDataFrame([(None, "a"), (1, "a")], "item_id long, document string")
    assert {r.train_tokens for r in lm.score_texts(keyless).collect()} == {2}
    twice = lm.score_texts(df.unionAll(df)).collect()
    assert len(twice) == 4 and {r.train_tokens for r in twice} == {8}


# --- pieces ----------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_samples_follow_the_lattice(vocabulary):
    v = vocabulary
    known = {v.decoded[i].decode(): i for i in np.flatnonzero(v.factor > 0)}

    def paths(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                yield from ((known[rest[:n]], *p) for p in paths(rest[n:]))

    word, n = " there", 20_000
    weights = {
        p: math.prod(float(v.factor[i]) / math.exp(pieces.PER_CHARACTER * len(v.decoded[i])) for i in p)
        for p in paths(word)
    }
    total = sum(weights.values())
    ids, counts = pieces.encode_texts(v, list(range(n)), [word] * n, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(ends))
    assert set(seen) <= set(weights)
    for p, w in weights.items():
        share = w / total
        assert abs(seen[p] / n - share) < 5 * math.sqrt(share / n) + 1e-3


def test_encoding_is_lossless_and_repeatable(spark):
    texts = [
        None, "", " ", "\n\n", "a  b\tc\r\n", "▁ x▁y", "😀é漢字\u0000", "a" * 3000, "word " * 40_000,
        "漢" * 500, "  lead and trail  ",
    ]
    df = docs_of(spark, texts)
    rows = {r.item_id: r for r in pieces.encode_documents(df).collect()}
    assert len(rows) == len(texts) and all(r.lossless for r in rows.values())
    assert rows[0].pieces == rows[1].pieces == []
    again = {r.item_id: r.pieces for r in pieces.encode_documents(df.repartition(3, "document")).collect()}
    assert again == {k: r.pieces for k, r in rows.items()}
    other = {r.item_id: r.pieces for r in pieces.encode_documents(df, seed=1).collect()}
    assert other[8] != again[8]
    back = {r.item_id: r.document for r in pieces.decode_documents(pieces.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_documents(df.limit(0)).count() == 0
    keyless = spark.createDataFrame([(None, "a b"), (None, "a b")], "item_id long, document string")
    first, second = pieces.encode_documents(keyless).collect()
    assert first == second and first.item_id is None


def test_op7_over_the_table(spark):
    found = queries.QUERIES["op7_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert found.where(~F.col("lossless")).count() == 0
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
