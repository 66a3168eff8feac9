"""Fill-in-the-middle forms of item documents.

A text is cut at two code points and its three spans change places. Cuts are
drawn in code points but spans are copied as bytes. For that only the exceptions
are recorded: where a block of texts holds characters of several bytes, and how
many bytes more than one they have had so far. Without an exception before it a
cut's byte is the cut itself; otherwise a binary search among the exceptions gives
the excess to add. A block of plain ASCII has an empty index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, key_type, keyed_texts, quoted

# Marks of the three spans.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORM = "form string, n_chars long, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Characters of several bytes in a run of UTF-8: their places in code
    points and the bytes in excess of one up to each, itself included."""

    def __init__(self, data: np.ndarray):
        first = np.flatnonzero(data >= 0xC0)
        lead = data[first]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.bytes = first
        # Code points before an exception: its byte less the excess before it.
        self.points = first - self.excess[:-1]

    def point_of(self, at: np.ndarray) -> np.ndarray:
        """Code points before bytes that begin a character or end the run."""
        if not len(self.bytes):
            return at
        return at - self.excess[np.searchsorted(self.bytes, at, "left")]

    def byte_of(self, at: np.ndarray) -> np.ndarray:
        """First byte of code points, or the end of the run."""
        if not len(self.points):
            return at
        return at + self.excess[np.searchsorted(self.points, at, "left")]


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a key: the first 8-digit groups of the hex
    SHA-256 of `seed:key`. A null key draws as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def infill_documents(
    items: DataFrame,
    key: str = "item_id",
    text: str = "document",
    seed: int = 1,
    infilled: int = 90,
    suffix_first: int = 20,
) -> DataFrame:
    """(key, form, n_chars, prefix_chars, middle_chars, output): one row per item
    row. output is the text as it is (form plain), or its spans behind their
    marks: prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

    Of a key's four draws the first two, modulo n_chars + 1, are the cuts: the
    prefix ends after the smaller, the middle after the larger. The third, modulo
    100, leaves a text plain from `infilled` on; the fourth, modulo 100, decides
    for spm below `suffix_first`. Equal keys draw alike, whatever their text.

    Lengths count code points; those of spans are null for plain rows. Null and
    empty texts are plain and empty, and so, as they are, are texts that hold one
    of the marks, which could not be told from the marks added. Texts are worked
    on whole, in blocks of bounded size. Null keys draw as an empty key; repeated
    rows repeat; an empty table gives an empty one; further columns are left out."""
    docs = keyed_texts(items, key, text)
    first, second, third, fourth = draws(F.col("_key"), seed)
    plain = (F.col("_text") == "") | F.col("_text").rlike(_MARK) | (third % 100 >= infilled)
    form = F.when(plain, 0).when(fourth % 100 < suffix_first, 2).otherwise(1).cast("int")
    drawn = docs.select("_key", "_text", first.alias("_a"), second.alias("_b"), form.alias("_form"))
    names = np.array([PLAIN, PSM, SPM])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column(1)
            wide = 8 if pa.types.is_large_string(texts.type) else 4
            offsets = np.frombuffer(
                texts.buffers()[1], np.int64 if wide == 8 else np.int32, len(texts) + 1, texts.offset * wide
            ).astype(np.int64)
            held = texts.buffers()[2]
            base, stop = int(offsets[0]), int(offsets[-1])
            data = np.frombuffer(held, np.uint8, stop - base, base) if stop > base else np.zeros(0, np.uint8)
            edges = offsets - base
            index = Exceptions(data)
            points = index.point_of(edges)
            n = np.diff(points)
            a, b = (block.column(i).to_numpy() % (n + 1) for i in (2, 3))
            low, high = np.minimum(a, b), np.maximum(a, b)
            cut = np.stack([edges[:-1], index.byte_of(points[:-1] + low),
                            index.byte_of(points[:-1] + high), edges[1:]], axis=1)
            forms = block.column(4).to_numpy()
            out = []
            for (s, x, y, e), f in zip(cut.tolist(), forms.tolist(), strict=True):
                if f == 0:
                    out.append(data[s:e].tobytes())
                    continue
                spans = (data[s:x], data[y:e], data[x:y])
                shown = (0, 1, 2) if f == 1 else (1, 0, 2)
                out.append(b"".join([p for i in shown for p in (marks[i], spans[i].tobytes())]))
            moved = pa.array(forms > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array(names[forms].tolist(), pa.string()),
                    pa.array(n, pa.int64()),
                    pa.compute.if_else(moved, pa.array(low, pa.int64()), None),
                    pa.compute.if_else(moved, pa.array(high - low, pa.int64()), None),
                    pa.array(out, pa.binary()).cast(pa.string(), safe=False),
                ],
                names=["_key", "form", "n_chars", "prefix_chars", "middle_chars", "output"],
            )

    found = drawn.mapInArrow(run, f"_key {key_type(docs)}, {FORM}")
    return found.select(
        F.col("_key").alias(key), "form", "n_chars", "prefix_chars", "middle_chars", "output"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of infill_documents was made from. Marks cannot
    arise where a mark and a span meet, and no infilled text holds one, so the
    marks found are those added."""
    parts = F.split(output, _MARK, -1)
    at = lambda i: F.element_at(parts, i)
    return (
        F.when(form == PSM, F.concat(at(2), at(4), at(3)))
        .when(form == SPM, F.concat(at(3), at(4), at(2)))
        .otherwise(output)
    )


def restore_documents(found: DataFrame, text: str = "document") -> DataFrame:
    """infill_documents' rows with their texts put together again as `text`."""
    return found.withColumn(text, restored(quoted("output"), quoted("form")))


def duckdb_sql(table: str, key: str, text: str) -> str:
    """DuckDB SQL of the digests of every row of a table, with default options."""
    groups = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::bigint as h{i + 1}" for i in range(4))
    return f"""
with texts as (
  select {key} as k, coalesce({text}, '') as t, sha256('1:' || coalesce({key}::varchar, '')) as h
  from {table}
), drawn as (
  select k, t, length(t) as n, {groups} from texts
), cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
    case when n = 0 or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
), spans as (
  select *, substring(t, 1, x) as p, substring(t, x + 1, y - x) as m, substring(t, y + 1, n - y) as s
  from cut
), made as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end as output
  from spans
)
select k as doc_id, n::bigint as n, form,
  case when form <> 'plain' then x::bigint end as prefix_chars,
  case when form <> 'plain' then (y - x)::bigint end as middle_chars,
  sha256(output) as output_sha256,
  sha256(case form when 'plain' then output
    when 'psm' then split(substring(output, 4), '<S>')[1]
      || split(output, '<M>')[2] || split(split(output, '<S>')[2], '<M>')[1]
    else split(split(output, '<P>')[2], '<M>')[1]
      || split(output, '<M>')[2] || split(substring(output, 4), '<P>')[1] end) as restored_sha256
from made"""
