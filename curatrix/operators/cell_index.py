"""A stored index of item vectors by cells, for approximate neighbours.

Centroids are fitted once on a bounded sample; every vector is stored with the
cell of its nearest centroid, in rows that later batches add to. A query is sent
to the cells of its nearest centroids only, so its work is their share of the
vectors. Cells are worked in groups of bounded size: a query is copied once to
each group that holds a cell it probes, a vector goes once to the task that works
its group (once per block of queries where very many ask for one)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scores import l2_normalise
from ..session import settle
from .fusion import DIGITS
from .grouping import top_k

# Vectors that centroids are fitted on, chosen by a digest of id; rounds of it.
SAMPLE, ROUNDS = 20_000, 12
# Largest number of cells; by default the root of the number of vectors.
CELLS = 4096
# Share of the cells that a query probes, and the least. Vectors that fall into
# clusters need a fifth for a recall of 0.9, vectors without any two thirds.
PROBES, LEAST_PROBES = 0.7, 4
# Vectors of a group of cells or part of a cell, queries of a block.
PART, QUERY_BLOCK = 16_384, 4096
# Rows of queries that a task makes at once, products that it holds at once.
SENT_ROWS, PRODUCTS = 8192, 2_000_000
SEED = 7


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors: Lloyd's rounds by largest inner product,
    an empty cell taking the vector that is worst placed."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    held = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        products = sample @ held.T
        own = products.argmax(axis=1)
        sums = np.zeros_like(held)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=cells)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            worst = np.argsort(products[np.arange(len(sample)), own], kind="stable")[: len(empty)]
            sums[empty] = sample[worst]
        norms = np.sqrt(np.square(sums).sum(axis=1, keepdims=True))
        held = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), held)
    return held


def _unit(vectors: DataFrame, key: str) -> DataFrame:
    """(key, vector): unit vectors; null, empty and zero ones are left out."""
    v = F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
    return vectors.where(usable).select(key, l2_normalise(v).alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def build(
    vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = SEED
) -> None:
    """Fit centroids on at most `sample` of vectors(item_id, vector) and store
    them, then store every vector in its cell."""
    unit = settle(_unit(vectors, "item_id"), "unit")
    total = unit.count()
    cells = cells or min(CELLS, max(1, int(np.sqrt(total))))
    share = int(min(1.0, 1.2 * sample / max(1, total)) * (1 << 20))
    chosen = unit.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 20)) < share)
    rows = chosen.orderBy(F.xxhash64("item_id"), "item_id").limit(sample).select("vector").collect()
    spark = vectors.sparkSession
    if rows:
        centroids = fit_centroids(np.array([r["vector"] for r in rows]), cells, seed=seed)
        # At most CELLS rows.
        held = spark.createDataFrame(list(enumerate(centroids.tolist())), "cell int, vector array<double>")
        held.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        add(unit, path, 0)


def centroids_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r["vector"] for r in rows])


def add(vectors: DataFrame, path: str, batch: int) -> None:
    """Store a batch of vectors in the cells of an index. A batch put again
    replaces itself; centroids stay as they were fitted."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast(centroids_of(spark, path))
    unit = _unit(vectors, "item_id")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                own = (_matrix(rows.column(1), rows.num_rows) @ held.value.T).argmax(axis=1)
                cell = pa.array(own.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*rows.columns, cell], names=["item_id", "vector", "cell"])

    kind = dict(unit.dtypes)["item_id"]
    placed = unit.mapInArrow(place, f"item_id {kind}, vector array<double>, cell int")
    placed.sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/vectors/batch={batch}")


def _groups(sizes: dict[int, int], cells: int, part: int) -> tuple[np.ndarray, list[int]]:
    """(group of every cell, parts of every group): cells that follow one another
    form groups of `part` vectors at most; a larger cell is a group of its own, cut
    into parts. Cells without vectors belong to none (-1)."""
    group_of, parts, held = np.full(cells, -1), [], part
    for cell in sorted(sizes):
        if held + sizes[cell] > part:
            parts.append(max(1, -(-sizes[cell] // part)))
            held = 0
        held += sizes[cell]
        group_of[cell] = len(parts) - 1
    return group_of, parts


def search(
    queries: DataFrame, path: str, k: int, skip_self: bool = False,
    probes: float = PROBES, part: int = PART, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, item_id, cosine, rank): the k items of the largest cosine
    found in the cells that a query of queries(query_id, vector) probes; exact
    cosines, ties by id. An item stored twice counts once, by its best vector."""
    spark = queries.sparkSession
    centroids = centroids_of(spark, path)
    many = min(len(centroids), max(LEAST_PROBES, int(np.ceil(probes * len(centroids)))))
    stored = spark.read.parquet(f"{path}/vectors").select("item_id", "vector", "cell")
    # A row per cell: at most CELLS.
    sizes = {r["cell"]: r["n"] for r in stored.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    group_of, parts = _groups(sizes, len(centroids), part)
    held = spark.sparkContext.broadcast((centroids, group_of))
    asked = _unit(queries, "query_id")
    kind = dict(asked.dtypes)["query_id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, group_of = held.value
        step = max(1, SENT_ROWS // max(1, int(group_of.max(initial=0)) + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = batch.slice(start, step)
                products = _matrix(rows.column(1), rows.num_rows) @ centroids.T
                near = np.sort(np.argpartition(-products, many - 1, axis=1)[:, :many], axis=1)
                # Runs of cells of one query and group; cells without vectors are not asked.
                row, cell = np.repeat(np.arange(rows.num_rows), many), near.reshape(-1)
                group = group_of[cell]
                row, cell, group = (x[group >= 0] for x in (row, cell, group))
                order = np.lexsort((cell, group, row))
                row, cell, group = row[order], cell[order], group[order]
                new = np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))[: len(row)]
                starts = np.flatnonzero(new)
                at = pa.array(row[starts])
                cells = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(at), rows.column(1).take(at), cells, pa.array(group[starts].astype(np.int32))],
                    names=["query_id", "query_vector", "cells", "group"],
                )

    sent = settle(
        asked.mapInArrow(probe, f"query_id {kind}, query_vector array<double>, cells array<int>, `group` int"),
        "probes",
    )
    # A row per group or cell: at most CELLS.
    blocks = sent.groupBy("group").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_bs"))
    shape = [(c, int(g), parts[g]) for c, g in enumerate(group_of.tolist()) if g >= 0]
    cut = F.broadcast(spark.createDataFrame(shape, "cell int, `group` int, _ps int").join(blocks, "group"))
    cut_groups = F.broadcast(cut.select("group", "_ps", "_bs").distinct())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    right = stored.join(cut, "cell").select(
        "item_id", "vector", "cell", "group", deal("item_id", "_ps").alias("_p"), every("_bs").alias("_b")
    )
    left = sent.join(cut_groups, "group").select(
        "query_id", "query_vector", "cells", "group", deal("query_id", "_bs").alias("_b"), every("_ps").alias("_p")
    )
    item_kind = dict(stored.dtypes)["item_id"]

    def meet(rows: pa.Table, items: pa.Table) -> pa.Table:
        out = {"query_id": [], "item_id": [], "cosine": []}
        if rows.num_rows and items.num_rows:
            items = items.sort_by("item_id")
            q, v = (_matrix(t.column(c), t.num_rows) for t, c in ((rows, "query_vector"), (items, "vector")))
            order = np.unique(items.column("item_id").to_numpy(), return_inverse=True)[1]
            first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
            known, own = np.unique(items.column("cell").to_numpy(), return_inverse=True)
            asked = rows.column("cells").combine_chunks()
            of = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy())
            cell = asked.flatten().to_numpy()
            place = np.minimum(np.searchsorted(known, cell), len(known) - 1)
            probed = np.zeros((len(q), len(known)), dtype=bool)
            here = known[place] == cell
            probed[of[here], place[here]] = True
            step = max(1, PRODUCTS // len(v))
            for at in range(0, len(q), step):
                products = q[at : at + step] @ v.T
                np.round(np.clip(products, -1.0, 1.0, out=products), DIGITS, out=products)
                products[~probed[at : at + step, own]] = -np.inf
                if len(first) < len(order):
                    # An item that is stored more than once counts by its best vector.
                    products = np.maximum.reduceat(products, first, axis=1)
                for i, line in enumerate(products):
                    # All that can be among the first k, the query's own id aside.
                    few = min(len(line), k + 1)
                    bar = np.partition(line, len(line) - few)[len(line) - few]
                    near = np.flatnonzero((line >= bar) & (line > -np.inf))
                    near = near[np.lexsort((near, -line[near]))][: k + 1]
                    out["query_id"].append(np.full(len(near), at + i))
                    out["item_id"].append(first[near])
                    out["cosine"].append(line[near])
        flat = {n: np.concatenate(c) if c else np.zeros(0) for n, c in out.items()}
        take = lambda t, c, at: t.column(c).take(pa.array(at.astype(np.int64)))
        return pa.table({
            "query_id": take(rows, "query_id", flat["query_id"]),
            "item_id": take(items, "item_id", flat["item_id"]),
            "cosine": pa.array(flat["cosine"], pa.float64()),
        })

    found = (
        left.groupBy("group", "_p", "_b")
        .cogroup(right.groupBy("group", "_p", "_b"))
        .applyInArrow(meet, f"query_id {kind}, item_id {item_kind}, cosine double")
    )
    if skip_self:
        found = found.where(F.col("query_id") != F.col("item_id"))
    best = found.groupBy("query_id", "item_id").agg(F.max("cosine").alias("cosine"))
    return top_k(best, ["query_id"], [F.desc("cosine"), F.asc("item_id")], k)


def recall(found: DataFrame, exact: DataFrame, digits: int = 9) -> DataFrame:
    """(queries, wanted, met, recall) of found against exact(query_id, item_id,
    cosine): a place is met by each item found that is as near as the last of
    the exact ones."""
    near = F.round("cosine", digits)
    asked = exact.groupBy("query_id").agg(F.count("*").alias("wanted"), F.min(near).alias("bar"))
    got = (
        found.join(asked, "query_id")
        .where(near >= F.col("bar"))
        .groupBy("query_id")
        .agg(F.count("*").alias("got"))
    )
    both = asked.join(got, "query_id", "left")
    met = F.coalesce(F.sum(F.least("wanted", F.coalesce("got", F.lit(0)))), F.lit(0))
    return both.agg(
        F.count("*").alias("queries"),
        F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"),
        met.alias("met"),
        F.try_divide(met.cast("double"), F.sum("wanted")).alias("recall"),
    )
