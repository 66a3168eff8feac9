"""Documents that hold test items, by pigeonhole edit matching.

An item of n characters may differ from a passage by a budget of errors. Cut
into one piece more than the budget, at least one piece stays unedited, so the
exact pieces found in a text point to every passage within the budget. Each is
verified with Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, key_type, keyed_texts

# Share of an item's characters that may be edited.
ERROR_RATE = 0.08
# Shorter items say too little to allow edits: they count as whole words only.
LEAST_CHARS = 24
# Characters of test items searched for in one pass over the documents.
PASS_CHARS = 4_000_000


def normalise(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return 0 if n < LEAST_CHARS else int(n * rate)


def pieces(pattern: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): an even cut into errors + 1 pieces."""
    n = len(pattern)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(pattern: str, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the passage of the text nearest to the pattern, the
    first end on a tie; None beyond the budget. One bit per pattern character
    holds the vertical differences of a column of the distance matrix."""
    m = len(pattern)
    masks, full, top = _masks(pattern), (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score <= errors and (best is None or score < best[0]):
            best = (score, end)
    return best


def locate(pattern: str, text: str, errors: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest passage within the budget, the
    first end on a tie, then the latest start of the least distance."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)  # an exact copy needs no matrix
    if not errors:
        return None
    found = best_end(pattern, text, errors)
    if found is None:
        return None
    distance, end = found
    head = text[max(0, end - len(pattern) - distance) : end]
    back = _nearest_prefix(pattern[::-1], head[::-1], distance)
    return distance, end - back, end


def _nearest_prefix(pattern: str, text: str, distance: int) -> int:
    """Length of the shortest prefix of the text at that distance."""
    row = list(range(len(pattern) + 1))
    for i, c in enumerate(text, 1):
        if row[-1] == distance:
            return i - 1
        new = [i]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return len(text)


@dataclass
class TestItems:
    """Patterns of one pass with the automaton of their pieces."""

    patterns: list[str]
    errors: list[int]
    automaton: ahocorasick.Automaton

    @classmethod
    def build(cls, texts: list[str], rate: float) -> TestItems:
        patterns = [normalise(t) for t in texts]
        errors = [budget(len(p), rate) for p in patterns]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (p, k) in enumerate(zip(patterns, errors, strict=True)):
            for offset, piece in pieces(p, k) if p else ():
                where.setdefault(piece, []).append((i, offset))
        automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            automaton.add_word(piece, (len(piece), places))
        if where:
            automaton.make_automaton()
        return cls(patterns, errors, automaton)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end): the nearest passage of each
        item within its budget, in the normalised text."""
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        if len(self.automaton):
            for last, (length, places) in self.automaton.iter(text):
                for i, offset in places:
                    k, n = self.errors[i], len(self.patterns[i])
                    if not k:
                        # The only piece is the item: each hit stands for itself.
                        start = last + 1 - n
                        if i not in exact and self._whole_words(i, text, start, last + 1):
                            exact[i] = start
                        continue
                    a = last + 1 - length - offset - k
                    b = a + n + 2 * k
                    held = windows.setdefault(i, [])
                    # Hits come by end, so a window may begin before the last one.
                    if held and a <= held[-1][1] + 1:
                        held[-1][0] = min(held[-1][0], a)
                        held[-1][1] = max(held[-1][1], b)
                    else:
                        held.append([a, b])
        out = [(i, 0, at, at + len(self.patterns[i])) for i, at in exact.items()]
        for i, held in windows.items():
            found = []
            for a, b in held:
                at = max(0, a)
                hit = locate(self.patterns[i], text[at:b], self.errors[i])
                if hit and self._whole_words(i, text, at + hit[1], at + hit[2]):
                    found.append((hit[0], at + hit[1], at + hit[2]))
                if found and found[-1][0] == 0:
                    break
            if found:
                out.append((i, *min(found)))
        return sorted(out)

    def _whole_words(self, i: int, text: str, start: int, end: int) -> bool:
        if len(self.patterns[i]) >= LEAST_CHARS:
            return True
        return text[max(0, start - 1) : start] in ("", " ") and text[end : end + 1] in ("", " ")


def find_test_items(
    items: DataFrame,
    probes: DataFrame,
    key: str = "item_id",
    text: str = "document",
    probe_key: str = "query_id",
    probe_text: str = "text",
    error_rate: float = ERROR_RATE,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """(key, probe_key, distance, allowed, first_word, last_word): every pair
    of an item document and an evaluation text that it holds.

    Both sides are compared in lower case with white space as single spaces.
    A passage counts if its edit distance to the whole evaluation text is at
    most allowed = error_rate of that text's length; first_word and last_word
    number the document's white-space words, from zero, of the nearest passage.
    Texts shorter than LEAST_CHARS must occur unedited, as whole words.

    Documents are never moved. Evaluation texts go to the tasks in passes of
    bounded size, so a test set of any size is covered by more passes; within a
    pass its total is checked before it is sent. Null and empty texts of either
    side match nothing; repeated rows of items give repeated pairs, evaluation
    texts of equal key and text are taken once; null keys stay null; empty tables
    give no rows; further columns are left out."""
    docs = keyed_texts(items, key, text)
    tests = (
        keyed_texts(probes, probe_key, probe_text)
        .where(F.trim("_text") != "")
        .dropDuplicates(["_key", "_text"])
    )
    schema = (
        f"_key {key_type(docs)}, _probe {key_type(tests)}, distance int, allowed int, "
        "first_word int, last_word int"
    )
    found = items.sparkSession.createDataFrame([], schema)
    for part in _passes(tests, pass_chars):
        found = found.unionAll(_one_pass(docs, part, error_rate, schema))
    return found.withColumnsRenamed({"_key": key, "_probe": probe_key})


def _passes(tests: DataFrame, pass_chars: int) -> Iterator[list]:
    """Rows of tests(_key, _text) in lists of bounded size. Passes are cut by a
    digest, so that no ordering of all tests is needed."""
    size = F.sum(F.length("_text")).alias("n")
    total = tests.agg(size).first()["n"] or 0
    passes = max(1, -(-2 * total // pass_chars))
    numbered = tests.withColumn("_pass", F.pmod(F.xxhash64("_text"), F.lit(passes)))
    for r in sorted(numbered.select("_pass").distinct().collect()):
        yield numbered.where(F.col("_pass") == r["_pass"]).select("_key", "_text").collect()


def _one_pass(docs: DataFrame, tests: list, rate: float, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(
        ([t["_key"] for t in tests], [t["_text"] for t in tests])
    )
    # Types are named, as a block without any hit has no values to tell them.
    shape = docs.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = sent.value
        patterns = TestItems.build(texts, rate)
        for block in blocks(batches):
            rows, columns = [], {n: [] for n in shape.names[1:]}
            for row, raw in enumerate(block.column(1).to_pylist()):
                plain = normalise(raw)
                for i, distance, start, end in patterns.matches(plain):
                    rows.append(row)
                    first = plain.count(" ", 0, start)
                    for name, value in zip(
                        columns,
                        (
                            names[i],
                            distance,
                            patterns.errors[i],
                            first,
                            first + plain[start:end].strip().count(" "),
                        ),
                        strict=True,
                    ):
                        columns[name].append(value)
            keys = block.column(0).take(pa.array(rows, type=pa.int64()))
            found = [pa.array(v, type=shape.field(n).type) for n, v in columns.items()]
            yield pa.RecordBatch.from_arrays([keys, *found], names=shape.names)

    return docs.mapInArrow(run, schema)


def without_test_items(
    items: DataFrame,
    probes: DataFrame,
    text: str = "document",
    probe_text: str = "text",
    error_rate: float = ERROR_RATE,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """All rows and columns of the items whose document holds no evaluation
    text, by the rules of find_test_items. Rows are judged where they lie:
    nothing is shuffled, and rows with a null or repeated key count each."""
    tests = (
        keyed_texts(probes.withColumn("_k", F.lit(0)), "_k", probe_text)
        .where(F.trim("_text") != "")
        .dropDuplicates(["_text"])
    )
    at = items.columns.index(text)
    spark = items.sparkSession
    for part in _passes(tests, pass_chars):
        sent = spark.sparkContext.broadcast([t["_text"] for t in part])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            patterns = TestItems.build(sent.value, error_rate)
            for batch in batches:
                clean = [
                    t is None or not patterns.matches(normalise(t))
                    for t in batch.column(at).to_pylist()
                ]
                yield batch.filter(pa.array(clean, type=pa.bool_()))

        items = items.mapInArrow(run, items.schema)
    return items
