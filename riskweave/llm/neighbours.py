"""Operator 1, approximate nearest neighbours: a forest of random-projection trees.

The top of every tree is fitted on a bounded sample and dealt to all tasks; it
cuts space into cells.  All vectors go to their cell of every tree, and each cell
grows the rest of its tree over all its own vectors, so depth follows the data.
A query costs, for a leaf, the squared margins by which it lies on the other side
of the planes above that leaf; leaves of all trees stand in one priority queue by
that cost, and are taken until enough candidates have come up.  Their distances
are exact.  Equal vectors are one entry of the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize

TREES = 4
#: Vectors that fit the tops of the trees, at most (about; drawn by hash), and cells of a tree at most.
SAMPLE, MOST_CELLS = 40_000, 2048
#: Vectors of a cell and of a leaf, about.
CELL, LEAF = 4096, 300
#: A query's queue ends after so many candidates, as a share of the index and at least; counted over all trees, so copies count.
#: Vectors without any clusters need the share (see the README for recall); clustered ones do with far less.
SHARE, CANDIDATES = 1.0, 4000
EVERY, NEAREST = 100, 10


@dataclass
class Top:
    """Planes of all trees as heaps: (trees, nodes, dimensions) directions and (trees, nodes) thresholds."""

    directions: np.ndarray
    thresholds: np.ndarray

    @property
    def depth(self) -> int:
        return (self.thresholds.shape[1] + 1).bit_length() - 1

    def cells(self, tree: int, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            right = (vectors * self.directions[tree, node]).sum(axis=1) > self.thresholds[tree, node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def costs(self, query: np.ndarray) -> np.ndarray:
        """(trees, cells): what each cell costs the query."""
        margins = self.directions @ query - self.thresholds
        cost = np.zeros((len(margins), 1))
        for level in range(self.depth):
            own = margins[:, (1 << level) - 1 : (2 << level) - 1]
            cost = np.stack([cost + np.where(own > 0, own**2, 0), cost + np.where(own > 0, 0, own**2)], axis=2).reshape(len(margins), -1)
        return cost


def _plane(vectors: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A unit direction between two of the vectors; a random one where they are equal."""
    a, b = random.integers(0, len(vectors), 2)
    line = vectors[a] - vectors[b]
    size = np.linalg.norm(line)
    if not np.isfinite(size) or size == 0:
        line = random.normal(size=vectors.shape[1])
        size = np.linalg.norm(line)
    return line / size


def fit_top(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 1) -> Top:
    random, nodes = np.random.default_rng(seed), (1 << depth) - 1
    dims = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
    top = Top(np.zeros((trees, nodes, dims)), np.zeros((trees, nodes)))
    for t in range(trees):
        parts = {0: np.arange(len(sample))}
        for node in range(nodes):
            ids = parts.pop(node)
            own = sample[ids] if len(ids) else sample
            line = _plane(own, random)
            at = own @ line
            top.directions[t, node], top.thresholds[t, node] = line, np.median(at)
            right = at > top.thresholds[t, node]
            parts[2 * node + 1], parts[2 * node + 2] = (ids[~right], ids[right]) if len(ids) else (ids, ids)
    return top


@dataclass
class Leaves:
    """Row numbers of each leaf; all planes of the tree; for each leaf, the planes above it and its side (1, -1; 0 fills up)."""

    rows: list[np.ndarray]
    directions: np.ndarray
    thresholds: np.ndarray
    above: np.ndarray
    side: np.ndarray

    def costs(self, query: np.ndarray) -> np.ndarray:
        margins = self.directions @ query - self.thresholds
        return (np.maximum(0.0, margins[self.above] * self.side) ** 2).sum(axis=1)


def grow(vectors: np.ndarray, random: np.random.Generator) -> Leaves:
    """A tree over all ``vectors``; its halves are equal in size, ties or not."""
    rows, paths, planes = [], [], [(np.zeros(vectors.shape[1]), 0.0)]
    todo: list[tuple[np.ndarray, list]] = [(np.arange(len(vectors)), [])]
    while todo:
        ids, path = todo.pop()
        if len(ids) <= LEAF:
            rows.append(ids)
            paths.append(path)
            continue
        line = _plane(vectors[ids], random)
        at = vectors[ids] @ line
        order = np.argsort(at, kind="stable")
        half = len(ids) // 2
        planes.append((line, (at[order[half - 1]] + at[order[half]]) / 2))
        own = len(planes) - 1
        todo += [(ids[order[:half]], [*path, (own, 1.0)]), (ids[order[half:]], [*path, (own, -1.0)])]
    deepest = max(1, max(map(len, paths)))
    padded = np.array([[*p, *[(0, 0.0)] * (deepest - len(p))] for p in paths])
    return Leaves(rows, np.stack([p[0] for p in planes]), np.array([p[1] for p in planes]), padded[:, :, 0].astype(np.int64), padded[:, :, 1])


def _deal(shared):
    """(tree, cell) of every vector in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                vectors = _matrix(part.column(1))
                for tree in range(len(shared.value.thresholds)):
                    cells = shared.value.cells(tree, vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), tree), pa.int32()), pa.array(cells, pa.int32()), part.column(0), part.column(1)], names=["tree", "cell", "cid", "vector"])

    return run


def _visit(shared, visits: int):
    """The cells of all trees that cost a query least, with their costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            rows, trees, cells, costs = [], [], [], []
            for i, query in enumerate(vectors):
                cost = shared.value.costs(query)
                best = np.argsort(cost, axis=None, kind="stable")[:visits]
                rows += [i] * len(best)
                trees.append(best // cost.shape[1])
                cells.append(best % cost.shape[1])
                costs.append(cost.ravel()[best])
            if rows:
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(trees), pa.int32()), pa.array(np.concatenate(cells), pa.int32()), taken.column(0), taken.column(1), pa.array(np.concatenate(costs), pa.float64())], names=["tree", "cell", "query", "vector", "cost"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(candidates: int, most: int):
    """Leaves of one cell for the queries that visit it: cost, size and the nearest of each."""
    schema = pa.schema([("query", pa.int64()), ("leaf", pa.string()), ("cost", pa.float64()), ("size", pa.int64()), ("near", pa.list_(pa.struct([("score", pa.float64()), ("cid", pa.int64())])))])

    def run(key: tuple, own: pa.Table, queries: pa.Table) -> pa.Table:
        tree, cell = (k.as_py() for k in key)
        if not own.num_rows or not queries.num_rows:
            return schema.empty_table()
        own, queries = own.sort_by("cid").combine_chunks(), queries.combine_chunks()
        cids = own["cid"].to_numpy()
        vectors = _matrix(own["vector"].combine_chunks())
        tree_of = grow(vectors, np.random.default_rng([tree, cell]))
        sizes = np.array([len(x) for x in tree_of.rows])
        rows = []
        for query, vector, base in zip(queries["query"].to_pylist(), _matrix(queries["vector"].combine_chunks()), queries["cost"].to_pylist(), strict=True):
            costs = base + tree_of.costs(vector)
            order = np.argsort(costs, kind="stable")
            # What stands behind this many candidates in its own cell can't be taken from the common queue either.
            for k in order[: int(np.searchsorted(np.cumsum(sizes[order]), candidates)) + 1]:
                ids = tree_of.rows[k]
                score = np.sqrt(((vectors[ids] - vector) ** 2).sum(axis=1))
                best = np.lexsort((cids[ids], score))[:most]
                rows.append({"query": query, "leaf": f"{tree}-{cell}-{k}", "cost": float(costs[k]), "size": len(ids), "near": [{"score": float(score[b]), "cid": int(cids[ids[b]])} for b in best]})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


def nearest(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEAREST, trees: int = TREES, share: float = SHARE, candidates: int = CANDIDATES) -> DataFrame:
    """The ``k`` nearest others found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score (Euclidean distance).

    Vectors that are null, empty, zero or hold a null or a number that isn't
    finite take no part, nor do rows without an id; of an id with several vectors
    the smallest counts.  If vectors differ in length, those of the commonest
    length (the shorter, if two are as common) take part.  Ties go to the smaller
    id.  With fewer than ``k`` others all are returned.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    v = F.col("vector")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size(v) == (lengths["d"] if lengths else 1)).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))
    rows = materialize(rows)
    classes = materialize(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.first("vector").alias("vector")))

    # The smallest k + 1 ids of each class, first within parts of it.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    firsts = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    few = firsts(firsts(rows.select("h1", "h2", "vec_id", part.alias("part")), "h1", "h2", "part"), "h1", "h2")
    ids = materialize(few.groupBy("h1", "h2").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("cid", "ids"))

    n = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, n / CELL))))
    depth = min(depth, int(math.log2(MOST_CELLS)))
    candidates = max(candidates, math.ceil(share * n))
    # Twice the cells that hold so many candidates, so that the queue doesn't end for want of cells.
    visits = math.ceil(2 * candidates / max(1, n) * (1 << depth)) + trees
    drawn = min(1.0, SAMPLE / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64("cid", F.lit("sample")), F.lit(1 << 20)) < int(drawn * (1 << 20))).select("cid", "vector").toArrow().sort_by("cid")
    top = fit_top(_matrix(sample["vector"].combine_chunks()), depth if sample.num_rows else 0, trees)
    shared = embeddings.sparkSession.sparkContext.broadcast(top)  # at most TREES * MOST_CELLS planes

    kind = dict(classes.dtypes)["vector"]
    index = classes.select("cid", "vector").mapInArrow(_deal(shared), f"tree int, cell int, cid long, vector {kind}")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("query_id", F.col("cid").alias("query")))
    queries = asked.select(F.col("query").alias("cid")).distinct().join(classes.select("cid", "vector"), "cid").select("cid", "vector")
    visiting = queries.mapInArrow(_visit(shared, visits), f"tree int, cell int, query long, vector {kind}, cost double")
    found = index.groupBy("tree", "cell").cogroup(visiting.groupBy("tree", "cell")).applyInArrow(_search(candidates, k + 1), "query long, leaf string, cost double, size long, near array<struct<score:double,cid:long>>")
    # The shared queue: leaves by cost until enough candidates have come.
    before = F.sum("size").over(Window.partitionBy("query").orderBy("cost", "leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    taken = found.withColumn("before", before).where(F.col("before") < candidates).groupBy("query", F.substring_index("leaf", "-", 2).alias("cell"))
    # A cell holds an entry once, so its nearest k + 1 are enough.
    taken = taken.agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).select("query", F.explode("near").alias("c")).groupBy("query", "c.cid").agg(F.min("c.score").alias("score"))
    by_score = Window.partitionBy("query").orderBy("score", "cid")
    best = materialize(taken.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= k + 1).drop("_r"))
    spread = best.join(ids, "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    spread = spread.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    lists = materialize(spread.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near")))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "query").select("query_id", F.posexplode(others).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")
