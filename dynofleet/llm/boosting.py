"""Histogram gradient-boosted trees over document statistics.

The statistics of all documents are computed in the tasks by numpy over flat bytes; the model is
fitted on a bounded, documented sample of labelled rows, and is a handful of arrays that travel
with the tasks. Scoring walks all trees of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.textops import Slice, shingles, slices

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "symbols", "upper", "digits", "marks", "stops", "not_ascii",
    "distinct_words", "same_as_before", "in_repeated_windows", "log_lines", "repeated_lines", "longest_word",
)

_BYTE_CLASSES = {
    "symbols": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "marks": b"!?",
    "stops": b".,;:",
    "not_ascii": bytes(range(0xC0, 256)),
}


def _class_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(members)] = 1
    return out


_TABLES = {k: _class_table(v) for k, v in _BYTE_CLASSES.items()}


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def _repeats(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value: does it occur twice or more in its text, and is it not the first there?"""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))  # stable: equal values keep their order
    v, o = values[order], owner[order]
    same = np.zeros(len(v) + 1, dtype=bool)
    same[1:-1] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice, later = np.empty(len(v), dtype=bool), np.empty(len(v), dtype=bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def statistics(s: Slice) -> np.ndarray:
    """A row of STATISTICS for every text of the slice; an empty text gives zeros."""
    n_bytes = np.diff(s.offsets)
    starts, ends, hashes, bounds = s.words()
    n_words = np.diff(bounds)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    cols = {"log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n_words)}
    cols["word_bytes"] = _sums(ends - starts, bounds) / per_word
    for name, t in _TABLES.items():
        cols[name] = _sums(t[s.data], s.offsets) / per_byte
    _, later = _repeats(hashes, bounds)
    cols["distinct_words"] = np.where(n_words > 0, 1 - _sums(later, bounds) / per_word, 0)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][n_words > 0]] = False
    cols["same_as_before"] = _sums(again, bounds) / per_word
    grams, at = shingles(hashes, bounds, 5)
    twice, _ = _repeats(grams, at)
    hit = np.flatnonzero(twice)
    first = hit + np.repeat(bounds[:-1] - at[:-1], np.diff(at))[hit]
    covered = np.zeros(len(hashes) + 6, np.int32)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + 5, -1)
    cols["in_repeated_windows"] = np.where(n_words >= 5, _sums(np.cumsum(covered)[: len(hashes)] > 0, bounds), 0) / per_word
    breaks = s.data == 10
    cols["log_lines"] = np.log1p(_sums(breaks, s.offsets))
    begin = np.unique(np.concatenate((s.offsets[:-1][n_bytes > 0], np.flatnonzero(breaks[:-1]) + 1 if len(breaks) else []))).astype(np.int64)
    end = np.append(begin[1:], len(s.data)).astype(np.int64)
    _, repeated = _repeats(s.span_hashes(begin, end), line_bounds := np.searchsorted(begin, s.offsets))
    cols["repeated_lines"] = _sums(repeated & (end - begin > 1), line_bounds) / np.maximum(np.diff(line_bounds), 1)
    longest = np.zeros(s.n)
    if len(starts):
        full = n_words > 0
        longest[full] = np.maximum.reduceat(ends - starts, bounds[:-1][full])
    cols["longest_word"] = np.log1p(longest)
    return np.column_stack([cols[c] for c in STATISTICS]).astype(np.float64)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right where the value is greater
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Fit by logistic loss on histograms of at most ``bins`` quantile bins a column.

    No rows, or one class only: a constant score, (ones + 1) / (rows + 2).
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    inner = 2**depth - 1
    base = float(np.log(prior / (1 - prior)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])
    total = np.full(len(y), base)
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = node - first
            best, best_f, best_b = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = at * bins + codes[j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                g_all, h_all = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
                gain[(hs < least) | (h_all - hs < least)] = -1
                gain = gain[:, : len(edges[j])]
                b = gain.argmax(1)
                won = gain[np.arange(width), b] > best
                best[won], best_f[won], best_b[won] = gain[np.arange(width), b][won], j, b[won]
            for k in np.flatnonzero(best_b >= 0):
                feature[first + k], cut[first + k] = best_f[k], edges[best_f[k]][best_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        total += leaf[at]
        out_f.append(feature)
        out_c.append(cut)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_c), np.array(out_l), base)


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and one double column for each of STATISTICS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text_")):
                x = statistics(s)
                part = batch.slice(s.lo, s.n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c) for c in x.T)], names=[*keep, *STATISTICS])

    schema = docs.select(*keep).schema
    for c in STATISTICS:
        schema = schema.add(c, "double")
    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(work, schema)


def held_out() -> F.Column:
    """Rows kept out of the fit: crc32 of doc_id as text, modulo 4, is 2 (null doc_id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = 20_000) -> Trees:
    """Fit on at most ``fit_rows`` labelled rows that are not held out, chosen by a hash of doc_id.

    Labels that are null are no labels; a document labelled twice counts as good if any label says so.
    The sample is the only thing that is bounded: its size in bytes is known, so it is broadcast.
    """
    chosen = (
        labels.filter(~held_out() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("y_"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_statistics(rows, ("doc_id", "y_")).limit(2 * fit_rows).toPandas().sort_values(["doc_id", *STATISTICS], kind="stable")
    return fit(found[list(STATISTICS)].to_numpy(float), found["y_"].to_numpy(float))


def score(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` of every document (null and empty texts are scored as zero statistics)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text_")):
                part = batch.slice(s.lo, s.n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(model.score(statistics(s)))], names=[*keep, "score"])

    return docs.select(*keep, F.col("text").alias("text_")).mapInArrow(work, docs.select(*keep).schema.add("score", "double"))
