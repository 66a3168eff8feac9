"""Personal data in item documents, also where it is written in disguise.

A chain of transducers rewrites a text and keeps, for every character of the
result, the span of source characters that it came from: homoglyphs become
ASCII, invisible characters vanish, spelled digits become digits, and at/dot
disguises become @ and '.'. Identifiers are searched in the source and in the
rewritten text; spans of the latter are mapped back to source characters."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPANS, blocks, key_type, keyed_texts
from .secret_scan import _SPAN_ARRAY

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Look-alike characters and the ASCII they stand for.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p",
    "ѕ": "s", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ν": "v",
    "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ",
    " ": " ", "\u202f": " ",
}
# Full-width forms follow a rule: U+FF01..U+FF5E stand for U+0021..U+007E.
_TRANSLATE = str.maketrans(HOMOGLYPHS | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}

_ODD = re.compile("[" + "".join(map(chr, _TRANSLATE)) + INVISIBLE + "]")
_UNSEEN = re.compile("[" + INVISIBLE + "]+")
_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_UNIT = rf"(?:{_WORD}|[0-9])"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*)"
# A run of at least four digits, one of which is spelled.
_SPELLED = re.compile(
    rf"(?ai)(?<![a-z0-9])(plus[ -])?(?:{_UNIT}(?:[ -]|[ ]?(?:,|dot)[ ])){{3,}}{_UNIT}(?![a-z0-9])"
)
_ANY_WORD = re.compile(rf"(?ai)\b{_WORD}\b")
_DIGIT_OR_DOT = re.compile(rf"(?ai){_WORD}|[0-9]|plus|dot")
_LABEL = r"[A-Za-z0-9-]+"
_AT_FORM = re.compile(
    rf"(?ai)(?<=[a-z0-9._%+-])(?:{_AT}(?={_LABEL}(?:{_DOT}|\.){_LABEL})"
    rf"|\s+at\s+(?={_LABEL}(?:\.{_LABEL})*{_DOT}{_LABEL})|\s+@\s*(?={_LABEL}(?:{_DOT}|\.){_LABEL})"
    rf"|@\s*(?={_LABEL}(?:{_DOT}|\.){_LABEL}))"
)
_DOT_FORM = re.compile(rf"(?ai)(?<=[a-z0-9-]){_DOT}(?=[a-z0-9-])")
_ANY_DOT = re.compile(_DOT, re.A | re.I)
_BRACKET = re.compile(r"[\[({<]")
# Words of a local part between disguised dots.
_LOCAL_WORD = r"[a-z0-9._%+-]"
_CHAIN = re.compile(rf"(?ai)(?<!{_LOCAL_WORD}){_LOCAL_WORD}++(?:{_DOT}{_LOCAL_WORD}++)+")
# Four groups of digits or more between dots, disguised or not.
_GROUPS = re.compile(rf"(?ai)(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3,}}")
_DISGUISED_AT = re.compile(r"(?ai)[\[({<]\s*(?:at|@)\s*[\])}>]|\bdot\b|\s@|@\s|[\[({<]\s*\.\s*[\])}>]")
_TAIL = re.compile(rf"{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*", re.A | re.I)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _parts(address: str) -> list[str]:
    return [p.lstrip("0") for p in address.split(".")]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain, leftmost and without
    overlap; each @ is looked at once, so runs of any length cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the plain identifiers of a text."""
    found = []
    if "@" in text:
        found += [(0, s, e) for s, e in _emails(text)]
    if not _HAS_DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in _parts(m[0])):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, *m.span()))
    return found


class Rewritten:
    """A text with the source span (first, last) of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.first = self.last = np.arange(len(text), dtype=np.int32)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, given in rising order, by shorter or equal texts. A
        new character stands for the whole span that it replaces."""
        if not edits:
            return
        words, firsts, lasts, done = [], [], [], 0
        for start, end, new in edits:
            words += [self.text[done:start], new]
            firsts += [self.first[done:start], np.full(len(new), self.first[start])]
            lasts += [self.last[done:start], np.full(len(new), self.last[end - 1])]
            done = end
        self.text = "".join([*words, self.text[done:]])
        self.first = np.concatenate([*firsts, self.first[done:]])
        self.last = np.concatenate([*lasts, self.last[done:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1]) + 1


def _visible(out: Rewritten) -> None:
    out.text = out.text.translate(_TRANSLATE)
    out.replace([(m.start(), m.end(), "") for m in _UNSEEN.finditer(out.text)])


def _undisguised(out: Rewritten) -> None:
    """at and dot. A bare 'at' counts only before a host with a disguised dot;
    dots are restored within such a host and in the local part before it. A
    plain address takes words before it only over a dot in brackets."""
    chains = {m.end(): m for m in _CHAIN.finditer(out.text)}
    edits, done = [], 0
    for m in _AT_FORM.finditer(out.text):
        if m.start() < done:
            continue
        host = _TAIL.match(out.text, m.end())
        end = host.end() if host else m.end()
        after = [(d.start(), d.end(), ".") for d in _DOT_FORM.finditer(out.text, m.end(), end)]
        local = chains.get(m.start())
        if local and (m[0] != "@" or after or _BRACKET.search(local[0])):
            edits += [
                (d.start(), d.end(), ".")
                for d in _ANY_DOT.finditer(out.text, max(done, local.start()), local.end())
            ]
        edits += [(m.start(), m.end(), "@"), *after]
        done = end
    out.replace(edits)


def _dotted_numbers(out: Rewritten) -> None:
    """Disguised dots between four groups of digits or more."""
    out.replace(
        [
            (d.start(), d.end(), ".")
            for m in _GROUPS.finditer(out.text)
            for d in _ANY_DOT.finditer(out.text, m.start(), m.end())
        ]
    )


def _digits(out: Rewritten) -> None:
    """Spelled digits in runs of four or more."""
    edits = []
    for run in _SPELLED.finditer(out.text):
        if not _ANY_WORD.search(run[0]):
            continue
        at = done = run.start()
        for m in _DIGIT_OR_DOT.finditer(out.text, run.start(), run.end()):
            word = m[0].lower()
            value = {"plus": "+", "dot": "."}.get(word) or DIGITS.get(word, word)
            # Separators between the parts go with the part that follows.
            edits.append((done if done > at else m.start(), m.end(), value))
            done = m.end()
    out.replace(edits)


def rewrite(text: str) -> Rewritten | None:
    """The text after all transducers, or None when it holds no disguise."""
    odd = not text.isascii() and _ODD.search(text)
    at = _DISGUISED_AT.search(text)
    words = _ANY_WORD.search(text)
    if not (odd or at or words):
        return None
    out = Rewritten(text)
    if odd:
        _visible(out)
    if odd or at:
        _undisguised(out)
        _dotted_numbers(out)
    if odd or words:
        _digits(out)
    return None if out.text == text else out


def _found(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int]]]:
    """find_in_text, and the spans found after rewriting that hold a whole
    plain span of their kind and more."""
    plain = identifiers(text)
    found = [(k, s, e, "base") for k, s, e in plain]
    wider = []
    out = rewrite(text)
    if out is not None:
        # Spans of one kind never share characters, so starts and ends both rise.
        starts: list[list[int]] = [[] for _ in KINDS]
        ends: list[list[int]] = [[] for _ in KINDS]
        for k, s, e in sorted(plain):
            starts[k].append(s)
            ends[k].append(e)
        for k, s, e in identifiers(out.text):
            a, b = out.source(s, e)
            first = bisect_right(ends[k], a)
            stop = bisect_left(starts[k], b, first)
            if first == stop:
                found.append((k, a, b, "added"))
                starts[k].insert(first, a)
                ends[k].insert(first, b)
            elif any(
                a <= starts[k][i] and ends[k][i] <= b and b - a > ends[k][i] - starts[k][i]
                for i in range(first, stop)
            ):
                wider.append((k, a, b))
    return sorted(found), wider


def find_in_text(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, origin) by kind, then start. Plain spans all
    stay; one found after rewriting is added unless a span of its kind that
    stands already shares characters with it."""
    return _found(text)[0]


def find_identifiers(items: DataFrame, key: str = "item_id", text: str = "document") -> DataFrame:
    """(key, identifiers): personal data in every item document.

    identifiers is an array of (kind, start, end, origin) in code points of the
    source, end exclusive, by kind (email, ip, card, phone), then start. origin
    is 'base' for what stands in the source as it is, 'added' for what appears
    after the transducers. Whole texts are read and nothing is shuffled. Null
    and empty texts give an empty array, null keys stay null, repeated rows give
    repeated results, an empty table an empty one; further columns of any name
    are left out."""
    docs = keyed_texts(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "origin": o} for k, s, e, o in find_in_text(t)]
                for t in block.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(found, type=_SPAN_ARRAY)],
                names=["_key", "identifiers"],
            )

    out = docs.mapInArrow(run, f"_key {key_type(docs)}, identifiers {SPANS}")
    return out.withColumnRenamed("_key", key)


def redact(text: str) -> str:
    """The text with every identifier replaced by its kind in brackets; spans
    that overlap are replaced as one, under the first kind. A plain span goes
    with the disguised words that belong to it."""
    found, wider = _found(text)
    spans = sorted([(s, e, k) for k, s, e, _ in found] + [(s, e, k) for k, s, e in wider])
    words, done = [], 0
    for s, e, k in spans:
        if s >= done:
            words += [text[done:s], f"[{KINDS[k]}]"]
        done = max(done, e)
    return "".join([*words, text[done:]]) if spans else text


def redact_identifiers(items: DataFrame, text: str = "document") -> DataFrame:
    """All rows and columns of items; identifiers in the text column give way
    to their kind in brackets. Null texts stay null."""
    at = items.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = pa.array(
                [None if t is None else redact(t) for t in column.to_pylist()], type=column.type
            )
            yield pa.RecordBatch.from_arrays(
                [new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema
            )

    return items.mapInArrow(run, items.schema)
