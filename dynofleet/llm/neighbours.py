"""Approximate nearest neighbours by largest inner product, on a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row goes to the leaf that it reaches by walking down.
A query takes leaves best bin first, by a priority queue over all branches seen. How many it visits
is widened until, for sampled queries whose true neighbours Spark has found among all rows, the
wanted recall is reached. Rows of a leaf and its queries meet in cells of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the tree is fitted on, queries that visits are calibrated on: documented bounds.
FIT_ROWS, CALIBRATION_QUERIES = 30_000, 128
#: Rows of some leaves, and visits of queries to these leaves, that meet in one cell.
CELL_ROWS, CELL_VISITS = 16_384, 65_536


@dataclass
class Tree:
    """Nodes in flat arrays; children of a node are ``first..first + count - 1``, a leaf has none."""

    centre: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray  # leaf number, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row, nearest centre first at each level."""
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.count[node] > 0)).size:
            for n in np.unique(node[inner]):
                rows = inner[node[inner] == n]
                kids = slice(self.first[n], self.first[n] + self.count[n])
                c = self.centre[kids]
                node[rows] = self.first[n] + (x[rows] @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        return self.leaf[node]

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """Leaves in order of best-bin-first traversal: the open branch of the largest inner product next."""
        product = -(self.centre @ q)
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, n = heapq.heappop(heap)
            if self.count[n] == 0:
                out.append(int(self.leaf[n]))
            for kid in range(self.first[n], self.first[n] + self.count[n]):
                heapq.heappush(heap, (float(product[kid]), kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        n = np.bincount(of, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c, (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


def fit_tree(x: np.ndarray, scale: float, branches: int = 12, leaf_rows: int = 1500) -> Tree:
    """``scale``: rows that a sampled row stands for. A node of about ``leaf_rows`` rows is a leaf."""
    rng = np.random.default_rng(5)
    centre, first, count, open_ = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [0], [0], [(0, x)]
    while open_:
        n, rows = open_.pop(0)
        k = min(branches, len(rows) // 4)
        if k < 2 or len(rows) * scale <= leaf_rows or len(np.unique(rows, axis=0)) < k:
            continue
        c, of = _kmeans(rows, k, rng)
        used = [j for j in range(k) if (of == j).any()]
        if len(used) < 2:
            continue
        first[n], count[n] = len(centre), len(used)
        for j in used:
            open_.append((len(centre), rows[of == j]))
            centre.append(c[j])
            first.append(0)
            count.append(0)
    leaf = np.full(len(centre), -1)
    ends = np.flatnonzero(np.array(count) == 0)
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centre), np.array(first), np.array(count), leaf)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or not finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _top(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, row numbers, scores) of the best ``k`` rows of all queries, ties to the smaller id, never itself.

    A matrix product of some queries with all rows finds who can be among the best; the scores given
    are sums in one fixed order, the same for equal vectors wherever they stand.
    """
    for lo in range(0, len(q), at_once):
        part = q[lo : lo + at_once]
        rough = part @ x.T
        own = ids[None, :] == q_ids[lo : lo + at_once, None]
        rough[own] = -np.inf
        if x.shape[0] > k:
            least = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k]
            slack = 1e-9 * (1 + np.linalg.norm(part, axis=1) * np.linalg.norm(x, axis=1).max())
            near = (rough >= (least - slack)[:, None]) & ~own
        else:
            near = ~own
        i, at = np.nonzero(near)
        exact = (x[at] * part[i]).sum(1)
        order = np.lexsort((ids[at], -exact, i))
        i, at, exact = i[order], at[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        yield lo + i[best], at[best], exact[best]


_HITS = "query_id long, vec_id long, score double, leaf int"


def _hits(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds, strict=True)], names=["query_id", "vec_id", "score", "leaf"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _calibrated(rows: DataFrame, tree: Tree, q_ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Visits, doubled and then narrowed, at which the sampled queries find ``recall`` of their true neighbours."""
    dims = q.shape[1]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dims)
            leaf = tree.assign(x)
            yield _hits([(q_ids[i], ids[at], s, leaf[at]) for i, at, s in _top(ids, x, q_ids, q, k)])

    truth = _ranked(rows.mapInArrow(brute, _HITS), k).select("query_id", "leaf").collect()  # at most queries x k rows
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.best_bins(v, tree.leaves))} for i, v in zip(q_ids, q, strict=True)}
    needed = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in truth)
    if not needed:
        return 1
    reached = lambda visits: np.searchsorted(needed, visits, side="right") / len(needed)
    visits = 1
    while visits < tree.leaves and reached(visits) < recall:
        visits *= 2
    low = visits // 2
    while visits - low > 1:
        mid = (low + visits) // 2
        low, visits = (low, mid) if reached(mid) >= recall else (mid, visits)
    return min(visits, tree.leaves)


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.94, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query among all other rows.

    Rows whose vector is null, zero, or holds null or non-finite components take no part, nor do
    those of another length than most have, or without an id. Fewer candidates than ``k``: all.
    Ties go to the smaller vec_id; rows that repeat an id are candidates each, but never of that id.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("asks")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dims, n = sizes["d"], sizes["count"]
    clean = clean.filter(F.size("v") == dims)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toPandas()["v"]
    sample = np.array(sample.tolist(), dtype=np.float64).reshape(-1, dims)
    tree = fit_tree(sample, n / max(1, len(sample)))
    asked = clean.filter("asks").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION_QUERIES).select("vec_id", "v").toPandas()
    visits = _calibrated(clean, tree, asked["vec_id"].to_numpy(np.int64), np.array(asked["v"].tolist(), dtype=np.float64).reshape(-1, dims), k, recall)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("v"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column("vec_id"), batch.column("v")], names=["leaf", "vec_id", "v"])

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                bins = [tree.best_bins(v, visits) for v in _matrix(part.column("v"), dims)]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(b) for b in bins]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bins), pa.int32()), part.column("vec_id").take(row), part.column("v").take(row)], names=["leaf", "vec_id", "v"])

    kind = f"leaf int, vec_id long, v {vectors.schema[vector_col].dataType.simpleString()}"
    rows = clean.select("vec_id", "v").mapInArrow(to_leaf, kind)
    asks = clean.filter("asks").select("vec_id", "v").mapInArrow(to_bins, kind)
    # Leaves that follow each other share a cell, a large leaf has several: one count a leaf, so bounded by the tree.
    count = lambda df: {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().collect()}
    of_rows, of_asks = count(rows), count(asks)
    group, held, visited = [], [], []
    for leaf in range(tree.leaves):
        here = of_rows.get(leaf, 0)
        if not held or held[-1] + here > CELL_ROWS:
            held.append(0)
            visited.append(0)
        held[-1] += here
        visited[-1] += of_asks.get(leaf, 0)
        group.append(len(held) - 1)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), F.col(at))
    row_cells, ask_cells = pick([max(1, -(-x // CELL_ROWS)) for x in held], "g"), pick([max(1, -(-x // CELL_VISITS)) for x in visited], "g")
    spread = lambda own, n: F.pmod(F.xxhash64("vec_id", F.lit(own)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("g", pick(group, "leaf")).withColumn("rc", spread(1, row_cells)).select("*", every(ask_cells).alias("qc"))
    right = asks.withColumn("g", pick(group, "leaf")).withColumn("qc", spread(2, ask_cells)).select("*", every(row_cells).alias("rc"))

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        parts = []
        if a.num_rows and b.num_rows:
            ids, q_ids = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            x, q = _matrix(a.column("v"), dims), _matrix(b.column("v"), dims)
            of_x, of_q = a.column("leaf").to_numpy(), b.column("leaf").to_numpy()
            for leaf in np.intersect1d(of_x, of_q):
                r, c = np.flatnonzero(of_x == leaf), np.flatnonzero(of_q == leaf)
                parts += [(q_ids[c][i], ids[r][at], s, np.zeros(len(at))) for i, at, s in _top(ids[r], x[r], q_ids[c], q[c], k)]
        if parts:  # the best of all leaves of the cell
            q_of, v_of, score, zero = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((v_of, -score, q_of))
            best = order[np.arange(len(order)) - np.searchsorted(q_of[order], q_of[order]) < k]
            parts = [(q_of[best], v_of[best], score[best], zero[best])]
        return pa.Table.from_batches([_hits(parts)])

    hits = left.groupBy("g", "rc", "qc").cogroup(right.groupBy("g", "rc", "qc")).applyInArrow(cell, _HITS)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
