"""An index of query predicates: which queries does an item satisfy?

A query is a conjunction of clauses on fields of an item: some value out of a
set, no value out of a set, a number within bounds. Queries are numbered and a
set of queries is one whole number, a bit each. Sets are posted under every value
they name; bounds are kept sorted with the set of queries up to each, so that a
binary search gives all queries an item's number satisfies. An item is then a few
look-ups joined by `and`, `or` and `not`. A query that names no value of a field
is in that field's set of unconcerned queries, and one that names nothing at all
is in all of those: it needs neither a key that all items share nor a row of its
own per item.

Items are dealt into parts and queries into blocks of bounded size, and every
part meets every block in one task."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Queries of a block, items of a part.
QUERY_BLOCK, ITEM_PART = 512, 8192
ANY, NONE, BOUND = "any", "none", "bound"


def some_of(field: str, values: Column) -> Column:
    """Clause: the item's list holds one of the values. No clause for an empty
    list of values."""
    return F.when(F.size(values) > 0, _clause(field, ANY, values=values))


def none_of(field: str, values: Column) -> Column:
    """Clause: the item's list is known and holds none of the values. Against a
    null among the values only an empty list can be known to."""
    return F.when(F.size(values) > 0, _clause(field, NONE, values=values))


def within(field: str, low: Column | None = None, high: Column | None = None) -> Column:
    """Clause: the item's number is known and within the bounds given."""
    null = F.lit(None)
    low, high = (null if b is None else b for b in (low, high))
    return F.when(low.isNotNull() | high.isNotNull(), _clause(field, BOUND, low=low, high=high))


def _clause(field, kind, values=None, low=None, high=None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(kind).alias("kind"),
        (null if values is None else values).cast("array<string>").alias("values"),
        (null if low is None else low).cast("double").alias("low"),
        (null if high is None else high).cast("double").alias("high"),
    )


def all_of(*clauses: Column, unless: Column | None = None) -> Column:
    """The conjunction of clauses; null, which no item satisfies, where `unless`
    is true or null."""
    held = F.array_compact(F.array(*clauses))
    return held if unless is None else F.when(~unless, held)


class PredicateIndex:
    """Queries as lists of clauses (or None for one that nothing satisfies)."""

    def __init__(self, queries: list[list[dict] | None]):
        self.size = len(queries)
        self.all = (1 << self.size) - 1
        self.alive = sum(1 << i for i, q in enumerate(queries) if q is not None)
        # field -> [queries with a clause, value -> queries].
        self.wanted: dict[str, list] = {}
        self.banned: dict[str, list] = {}
        bounds: dict[tuple[str, str], list[tuple[float, int]]] = {}
        for i, clauses in enumerate(queries):
            bit = 1 << i
            for c in clauses or ():
                field = c["field"]
                if c["kind"] == BOUND:
                    for side in ("low", "high"):
                        if c[side] is not None:
                            bounds.setdefault((field, side), []).append((c[side], i))
                    continue
                held = (self.wanted if c["kind"] == ANY else self.banned).setdefault(field, [0, {}])
                held[0] |= bit
                for v in set(c["values"]):
                    held[1][v] = held[1].get(v, 0) | bit
        # (field, side) -> [queries with a bound, sorted bounds, queries up to each].
        self.bounds = {}
        for at, pairs in bounds.items():
            pairs.sort()
            reached, sets = 0, [0]
            for _, i in pairs:
                reached |= 1 << i
                sets.append(reached)
            self.bounds[at] = (reached, [b for b, _ in pairs], sets)

    def satisfied(self, lists: dict[str, list | None], numbers: dict[str, float | None]) -> int:
        """Queries whose clauses an item meets. A null list or number meets no
        clause on it; a list with a null is not known to hold none of a set."""
        out = self.alive
        for field, (concerned, posted) in self.wanted.items():
            met = 0
            for v in lists[field] or ():
                if v is not None:
                    met |= posted.get(v, 0)
            out &= met | ~concerned
        for field, (concerned, posted) in self.banned.items():
            values = lists[field]
            if values is None:
                out &= ~concerned
                continue
            for v in values:
                out &= ~(concerned if v is None else posted.get(v, 0))
            if values:
                out &= ~posted.get(None, 0)
        for (field, side), (concerned, sorted_, sets) in self.bounds.items():
            x = numbers[field]
            if x is None or x != x:
                met = 0
            elif side == "low":
                met = sets[bisect_right(sorted_, x)]
            else:
                met = concerned ^ sets[bisect_left(sorted_, x)]
            out &= met | ~concerned
        return out

    def _packed(self, queries: int) -> np.ndarray:
        """A set of queries as bytes, one bit each."""
        return np.frombuffer(queries.to_bytes((self.size + 7) // 8, "little"), np.uint8)

    def _table(self, sets: list[int]) -> np.ndarray:
        packed = [self._packed(s) for s in sets]
        return np.stack(packed) if packed else np.zeros((0, (self.size + 7) // 8), np.uint8)

    def _named(self, column: pa.Array, posted: dict) -> np.ndarray:
        """Queries of each list that post one of its values, nulls aside."""
        out = np.zeros((len(column), (self.size + 7) // 8), np.uint8)
        values = [v for v in posted if v is not None]
        codes = pc.index_in(column.flatten(), pa.array(values, column.type.value_type))
        hit = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            owner = np.repeat(np.arange(len(column)), _sizes(column))[hit]
            rows = self._table([posted[v] for v in values])[codes.take(pa.array(hit)).to_numpy()]
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[starts]] = np.bitwise_or.reduceat(rows, starts, axis=0)
        return out

    def mask(self, rows: pa.Table) -> np.ndarray:
        """Booleans of (item, query): what `satisfied` says of every row, a field
        of all rows at a time."""
        out = np.repeat(self._packed(self.alive)[None], rows.num_rows, axis=0)
        for field, (concerned, posted) in self.wanted.items():
            out &= self._named(_whole(rows, field), posted) | ~self._packed(concerned)
        for field, (concerned, posted) in self.banned.items():
            column = _whole(rows, field)
            sizes = _sizes(column)
            unknown = column.is_null().to_numpy(zero_copy_only=False)
            nulls = np.flatnonzero(column.flatten().is_null().to_numpy(zero_copy_only=False))
            unknown[np.repeat(np.arange(len(column)), sizes)[nulls]] = True
            met = self._named(column, posted)
            met[unknown] |= self._packed(concerned)
            met[sizes > 0] |= self._packed(posted.get(None, 0))
            out &= ~met
        for (field, side), (concerned, sorted_, sets) in self.bounds.items():
            x = pc.fill_null(pc.cast(_whole(rows, field), pa.float64(), safe=False), np.nan).to_numpy()
            table = self._table(sets)
            if side == "low":
                met = table[np.searchsorted(sorted_, x, "right")]
            else:
                met = table[np.searchsorted(sorted_, x, "left")] ^ self._packed(concerned)
            met[np.isnan(x)] = 0
            out &= met | ~self._packed(concerned)
        return np.unpackbits(out, axis=1, count=self.size, bitorder="little").astype(bool)


def _whole(rows: pa.Table, field: str) -> pa.Array:
    column = rows.column(field).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy()


def meet(
    items: DataFrame,
    queries: DataFrame,
    lists: list[str],
    numbers: list[str],
    work: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table],
    schema: str,
    query_block: int | None = None,
    item_part: int | None = None,
) -> DataFrame:
    """Rows that `work` makes of each (part of items, block of queries, mask).

    items(item_id, fields...), queries(query_id, demands, ...), where demands is
    the column made by all_of; both are counted first, so hand over what is
    written. Blocks of queries go to every part; an item is sent once per block,
    so once for a table of up to query_block queries."""
    spark = items.sparkSession
    blocks = max(1, -(-queries.count() // (query_block or QUERY_BLOCK)))
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-items.count() // (item_part or ITEM_PART)),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = items.select("*", deal("item_id", parts).alias("_p"), every(blocks).alias("_b"))
    right = queries.select("*", deal("query_id", blocks).alias("_b"), every(parts).alias("_p"))
    # Spread by number, so that small parts are not put together into one task.
    left, right = (s.repartition(parts, "_p", "_b") for s in (left, right))
    empty_table = to_arrow_schema(spark.createDataFrame([], schema).schema).empty_table()

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows and asked.num_rows:
            index = PredicateIndex(asked.column("demands").to_pylist())
            mask = index.mask(rows.select([*lists, *numbers]))
            if mask.any():
                return work(rows, asked, mask)
        return empty_table

    return left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(run, schema)


def pair_table(rows: pa.Table, asked: pa.Table, mask: np.ndarray) -> pa.Table:
    """(query_id, item_id) of a mask."""
    item, query = np.nonzero(mask)
    return pa.table(
        {"query_id": asked.column("query_id").take(pa.array(query)),
         "item_id": rows.column("item_id").take(pa.array(item))}
    )


def count_table(rows: pa.Table, asked: pa.Table, mask: np.ndarray) -> pa.Table:
    """(query_id, n) of a mask; one row per query that some item meets."""
    counts = mask.sum(axis=0)
    met = np.flatnonzero(counts)
    return pa.table(
        {"query_id": asked.column("query_id").take(pa.array(met)), "n": pa.array(counts[met], pa.int64())}
    )
