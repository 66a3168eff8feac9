"""Secrets in item documents, found through a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams
that each of its matches must hold. Documents are indexed in segments, one per
bounded block of a partition: a segment's postings list, for each trigram that
some rule asks for, the documents holding it. A rule's query intersects and
unites postings; only candidate documents are verified with the expression
itself. A rule without mandatory trigrams scans the whole segment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPANS, blocks, key_type, keyed_texts

_sre = re._parser
_OPS = re._constants


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# Published forms of credentials; the first three are the base.
RULES = (
    Rule(
        "assign",
        r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        8,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("repository", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("messenger", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

# A set of exact strings larger than this is not followed any further.
MOST_STRINGS = 64
_WHOLE = frozenset([""])


def _all_of(queries):
    """Conjunction; None stands for a query that every text fulfils."""
    parts = tuple(dict.fromkeys(q for q in queries if q is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any_of(queries):
    queries = list(queries)
    if not queries or any(q is None for q in queries):
        return None
    parts = tuple(dict.fromkeys(queries))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings):
    """Query of texts holding at least one of the strings."""
    return _any_of(
        _all_of(s[i : i + 3] for i in range(len(s) - 2)) if s.isascii() else None for s in strings
    )


def _class(members):
    """Strings of a character class, or None when it has too many."""
    out = set()
    for op, arg in members:
        if op is _OPS.LITERAL:
            out.add(chr(arg).lower())
        elif op is _OPS.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _derive(sequence):
    """(exact strings or None, query of what else must hold) of a parsed run."""
    strings, queries, whole = _WHOLE, [], True
    for op, arg in sequence:
        exact, query = None, None
        if op is _OPS.LITERAL:
            exact = frozenset([chr(arg).lower()])
        elif op is _OPS.IN:
            exact = _class(arg)
        elif op is _OPS.AT or op in (_OPS.ASSERT, _OPS.ASSERT_NOT):
            exact = _WHOLE
        elif op is _OPS.SUBPATTERN:
            exact, query = _derive(arg[3])
        elif op is _OPS.BRANCH:
            found = [_derive(x) for x in arg[1]]
            if all(e is not None for e, _ in found):
                exact = frozenset().union(*(e for e, _ in found))
                query = _any_of(q for _, q in found)
            else:
                query = _any_of(
                    _all_of([q, None if e is None else _of_strings(e)]) for e, q in found
                )
        elif op in (_OPS.MAX_REPEAT, _OPS.MIN_REPEAT, _OPS.POSSESSIVE_REPEAT):
            low, high, inner = arg
            e, q = _derive(inner)
            if (low, high) == (0, 1) and e is not None:
                exact = e | _WHOLE
            elif low:
                query = _all_of([q, None if e is None else _of_strings(e)])
        queries.append(query)
        met = None if exact is None else {a + b for a in strings for b in exact}
        if met is not None and len(met) <= MOST_STRINGS:
            strings = frozenset(met)
        else:
            whole = False
            queries.append(_of_strings(strings))
            strings = _WHOLE if exact is None else exact
    if whole:
        return strings, None
    return None, _all_of([*queries, _of_strings(strings)])


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every match of the
    expression fulfils: a trigram, ("and", ...) or ("or", ...); None when the
    expression demands no trigram."""
    exact, query = _derive(_sre.parse(pattern))
    return query if exact is None else _of_strings(exact)


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.zeros(1 << 24, dtype=bool)
    for t in set().union(*map(trigrams_of, queries)):
        wanted[_code(t)] = True
    return [re.compile(r.pattern) for r in rules], queries, wanted


def build_postings(texts: list[str], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Inverted index of one segment: trigram code -> rising document numbers.
    Letter case is folded for ASCII; only wanted trigrams are kept."""
    raw = [t.encode().lower() for t in texts]
    held = np.frombuffer(b"\0\0".join(raw) + b"\0\0", dtype=np.uint8).astype(np.int32)
    codes = (held[:-2] << 16) | (held[1:-1] << 8) | held[2:]
    at = np.flatnonzero(wanted[codes])
    ends = np.cumsum([len(r) + 2 for r in raw])
    pairs = np.unique(codes[at].astype(np.int64) * len(raw) + np.searchsorted(ends, at, "right"))
    grams, first = np.unique(pairs // len(raw), return_index=True)
    if not len(grams):
        return {}
    return dict(zip(grams.tolist(), np.split(pairs % len(raw), first[1:]), strict=True))


def candidates(query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Documents of a segment that fulfil a trigram query."""
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        return postings.get(_code(query), np.empty(0, dtype=np.int64))
    found = [candidates(q, postings, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    found.sort(key=len)
    out = found[0]
    for other in found[1:]:
        out = np.intersect1d(out, other, assume_unique=True)
    return out


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[dict]]:
    """Spans of one segment: per text, by start, then by the order of rules."""
    expressions, queries, wanted = _compiled(rules)
    postings = build_postings(texts, wanted)
    found: list[list[tuple]] = [[] for _ in texts]
    for order, rule in enumerate(rules):
        for i in candidates(queries[order], postings, len(texts)).tolist():
            for m in expressions[order].finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), order, m.end()))
    return [
        [
            {
                "kind": rules[o].kind,
                "start": s,
                "end": e,
                "origin": "base" if rules[o].base else "added",
            }
            for s, o, e in sorted(f)
        ]
        for f in found
    ]


def find_secrets(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """(key, secrets): the credentials in every item document.

    secrets is an array of (kind, start, end, origin) in code points, end
    exclusive, by start, then by the order of rules; matches of one rule do not
    overlap, those of different rules may. origin is 'base' for the three base
    rules, else 'added'. Whole texts are read, nothing is shuffled, and a task
    holds one segment at a time. Null and empty texts give an empty array, null
    keys stay null, repeated rows give repeated results, an empty table an empty
    one; further columns of any name are left out."""
    docs = keyed_texts(items, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = scan_texts(block.column(1).to_pylist(), rules)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(found, type=_SPAN_ARRAY)], names=["_key", "secrets"]
            )

    out = docs.mapInArrow(run, f"_key {key_type(docs)}, secrets {SPANS}")
    return out.withColumnRenamed("_key", key)


_SPAN_ARRAY = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("origin", pa.string())]
    )
)
