"""Whitening of embeddings by a covariance that is read off variances alone.

For two centred columns x and y, var(x + y) = var(x) + var(y) + 2 cov(x, y): squares of every dimension and
of the sum of every two dimensions give the whole covariance. All values are whole numbers, so
the sums of squares are exact and don't depend on the order of rows; only the last division rounds.

An entry c becomes x = floor(1024 c) + 100000. Centred is n x - S, S being the sum of the dimension. Tasks square
y = x - m, m a whole number next to the mean S / n, and what is left of the centring (r = n m - S, at most n / 2) is put
in exactly afterwards: the sum of (n y + r)^2 is n^2 sum(y^2) + 2 n r sum(y) + n r^2.

Rows take no part if their vector is null, empty, or holds null or non-finite entries, or if it has another
length than most (of equally frequent lengths the largest counts). Repeated rows and repeated or null ids count each by
itself. Components along which nothing varies (e below 1e-12 of the trace: one vector only, or fewer
than components) have null ``whitened``. An empty table gives no rows. Other columns are not read. Entries from
2^30 up raise an error, as sums of their squares could not be exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.common import stored

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 30)
#: Rows that a task squares at once.
BLOCK = 2048
#: Components with less than this part of the trace are taken for none.
RANK = 1e-12


def usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows (places in ``column``) whose vectors are whole and finite, and their x, as longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(np.asarray(column.is_valid()))
    if not len(there):
        return {}
    lists = column.drop_null()
    size = np.asarray(lists.value_lengths())
    flat = lists.flatten()
    values = np.asarray(flat.fill_null(math.nan), dtype=np.float64)
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    whole = (bad[ends] == bad[ends - size]) & (size > 0)
    out = {}
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        c = values[(ends[rows] - n)[:, None] + np.arange(n)]
        if np.abs(c).max() >= LARGEST:
            raise ArithmeticError("entries from 2^30 up can't be squared exactly")
        out[n] = there[rows], np.floor(c * SCALE).astype(np.int64) + SHIFT
    return out


def sums(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """Number of vectors of the most frequent length, and the sum of every dimension; one row a task and length is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for n, (_, x) in usable(b.column(0)).items():
                one = total.setdefault(n, [0, np.zeros(n, object)])
                one[0] += len(x)
                one[1] += x.sum(axis=0).astype(object)
        rows = [(n, i, k, str(s)) for n, (k, all_) in total.items() for i, s in enumerate(all_)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["size", "i", "k", "s"])

    found = vectors.select(column).mapInArrow(task, "size int, i int, k long, s string")
    by = found.groupBy("size", "i").agg(F.sum("k").alias("k"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = by.filter("i = 0").orderBy(F.desc("k"), F.desc("size")).first()
    if most is None:
        return 0, []
    return most.k, [int(r.s) for r in by.filter(F.col("size") == most["size"]).orderBy("i").collect()]


def squares(vectors: DataFrame, column: str, middle: list[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """By dimensions (i, j), i <= j: sum of y and of its square, where y is the centred dimension (i = j) or the sum of two.

    Each task adds up its own rows; what is shuffled is one row for each task and pair of dimensions.
    """
    size, m = len(middle), np.array(middle, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros((size, size), object), np.zeros((size, size), object)
        for b in batches:
            _, x = usable(b.column(0)).get(size, (None, np.zeros((0, size), np.int64)))
            for k in range(0, len(x), BLOCK):
                y = x[k : k + BLOCK] - m
                y = np.asfortranarray(y if 4 * int(np.abs(y).max()) ** 2 * len(y) < 1 << 63 else y.astype(object))  # whole numbers of any size where longs don't do
                for i in range(size):
                    both = y[:, i:] + y[:, i : i + 1]
                    both[:, 0] = y[:, i]
                    first[i, i:] += both.sum(axis=0).astype(object)
                    both *= both
                    second[i, i:] += both.sum(axis=0).astype(object)
        i, j = np.triu_indices(size)
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in first[i, j]]), pa.array([str(v) for v in second[i, j]])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "a", "b"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = vectors.select(column).mapInArrow(task, "i int, j int, a string, b string").groupBy("i", "j").agg(whole("a"), whole("b"))
    return {(r.i, r.j): (int(r.a), int(r.b)) for r in found.collect()}  # one row for each pair of dimensions


@dataclass(frozen=True)
class Whitening:
    """n, the dimensions' sums, and components by falling eigenvalue: vectors in rows, eigenvalues, parts of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def covariance(n: int, total: list[int], middle: list[int], found: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """The covariance of x, each entry the nearest double to the exact value."""
    size = len(total)
    left = [n * m - s for m, s in zip(middle, total, strict=True)]

    def variance(i: int, j: int) -> int:  # n^3 times
        a, b = found[i, j]
        r = left[i] if i == j else left[i] + left[j]
        return n * n * b + 2 * n * r * a + n * r * r

    own = [variance(i, i) for i in range(size)]
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            out[i, j] = out[j, i] = own[i] / n**3 if i == j else (variance(i, j) - own[i] - own[j]) / (2 * n**3)
    return out


def learn(vectors: DataFrame, most: int = 8, column: str = "embedding") -> Whitening | None:
    """The first ``most`` components of all vectors, or None without vectors. Two passes: sums, then squares."""
    n, total = sums(vectors, column)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in total]
    values, columns = np.linalg.eigh(covariance(n, total, middle, squares(vectors, column, middle)))
    order = np.argsort(-values, kind="stable")[:most]
    trace = float(values.sum())
    explained = values[order] / trace if trace > 0 else np.zeros(len(order))
    return Whitening(n, total, columns[:, order].T.copy(), values[order], explained)


def transform(vectors: DataFrame, w: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, ``deviation`` (decimal, exact) and ``whitened``, an array by component, of every vector that takes part."""
    size, n = len(w.sums), w.n
    middle = [(2 * s + n) // (2 * n) for s in w.sums]
    m, left = np.array(middle, np.int64), np.array([n * a - s for a, s in zip(middle, w.sums, strict=True)], object)
    offset = np.array([float(r) / n for r in left])
    flat = (w.explained <= RANK) | (w.values <= 0)
    project = np.where(flat[:, None], np.nan, w.components / np.sqrt(np.where(flat, 1.0, w.values))[:, None]).T
    number = vectors.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column(1)).get(size, (np.zeros(0, np.int64), np.zeros((0, size), np.int64)))
            y = x - m
            d = y.astype(object) * n + left if len(y) and size * (n * (int(np.abs(y).max()) + 1)) ** 2 >= 1 << 63 else y * n + left.astype(np.int64)
            deviation = (d * d).sum(axis=1)
            white = (y + offset) @ project
            ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel(), pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([str(v) for v in deviation.tolist()], pa.string()), lists], [key, "deviation", "whitened"])

    out = vectors.select(key, column).mapInArrow(task, f"`{key}` {number}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(white: DataFrame, parts: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over components that vary."""
    at = lambda i: F.get("whitened", F.lit(i))
    cells = [F.abs(F.covar_pop(at(i), at(j)) - (1.0 if i == j else 0.0)) for i in range(parts) for j in range(i, parts)]
    return white.agg(F.array_max(F.array(*cells)).alias("e")).first().e


def whitened(vectors: DataFrame, most: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error."""
    w = learn(vectors, most, column)
    if w is None:
        white, parts, n, explained, error = vectors.select(key, F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0), 0, 0, [], None
    else:
        white = stored(transform(vectors, w, key, column))
        parts, n, explained, error = len(w.values), w.n, w.explained.tolist(), identity_error(white, len(w.values))
    rows = white.select(F.col(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col(key),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
