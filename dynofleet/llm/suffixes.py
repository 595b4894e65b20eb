"""Exact substring dedup: every byte of a 100-byte string that also starts earlier is removed.

The strings are dealt out by their minimiser: the smallest hash of the 32-byte grams in a string.
Equal strings have equal minimisers, so they meet wherever they come from, and following strings
with one minimiser stay together as one stretch of text. Stretches that are equal as a whole need
their digests only. Where one minimiser has different stretches, their texts meet in buckets of
bounded size: the bucket is sorted into a Burrows-Wheeler transform, and a breadth-first backward
extension of intervals sets common-prefix lengths by increasing value, up to the minimum length;
neighbours whose common prefix is still open then begin with the same string of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.llm.common import stored
from dynofleet.llm.textops import Slice, rolling_hashes, slices

#: Bytes of a gram whose smallest hash deals out a string.
GRAM = 32
#: Bytes of text in a bucket, about; stretches of one minimiser beyond which its strings are compared by digest.
BUCKET_BYTES, HOT_STRETCHES = 1 << 20, 4000


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over x[i : i + width], by doubling; the last width - 1 places hold fewer."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def stretches(s: Slice, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, strings, minimiser, digest, loop) of every run of strings with one minimiser.

    ``loop``: the minimiser comes twice in the run, so a string may repeat inside of it.
    """
    n_bytes = np.diff(s.offsets)
    none = np.zeros(0, np.int64)
    if len(s.data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    span = length - GRAM + 1
    grams = rolling_hashes(s.data, GRAM)
    low = _sliding(grams, span, np.minimum)
    end = np.repeat(s.offsets[1:], n_bytes)
    valid = np.zeros(len(s.data) + 1, dtype=bool)
    valid[: len(s.data)] = np.arange(len(s.data)) + length <= end
    usable = valid[: len(low)]
    first = np.zeros(len(s.data) + 1, dtype=bool)
    first[s.offsets[:-1]] = True
    new = usable.copy()
    new[1:] &= (low[1:] != low[:-1]) | first[1 : len(low)] | ~usable[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    count = np.diff(np.concatenate(([0], np.cumsum(usable)))[np.append(start, len(low))])
    text = np.searchsorted(s.offsets, start, side="right") - 1
    digest = s.span_hashes(start, start + count + length - 1)
    # Grams that are the smallest of some string; the run's own among them are counted.
    back = _sliding(np.concatenate((np.zeros(span - 1, np.uint64), np.where(usable, low, 0))), span, np.maximum)[: len(grams)]
    smallest = np.flatnonzero(back == grams)
    a, b = np.searchsorted(smallest, start), np.searchsorted(smallest, start + count + span - 1)
    run = np.repeat(np.arange(len(start)), b - a)
    place = smallest[np.arange(len(run)) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a)[:-1])), b - a)]
    hits = np.bincount(run[grams[place] == low[start][run]], minlength=len(start))
    return text, start - s.offsets[text], count, low[start], digest, hits > 1


_STRETCH = "minimiser long, digest long, doc_id long, start int, n int, loop boolean, known boolean"


def stretch_table(docs: DataFrame, length: int) -> DataFrame:
    """The stretches of all texts. ``known``: the same slice of the input has an equal one earlier."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for s in slices(batch.column("text")):
                text, start, n, minimiser, digest, loop = stretches(s, length)
                doc = ids[s.lo : s.hi][text]
                order = np.lexsort((start, doc, digest, minimiser))
                same = np.append(False, (digest[order[1:]] == digest[order[:-1]]) & (minimiser[order[1:]] == minimiser[order[:-1]]))[: len(order)]
                first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                known = np.zeros(len(order), dtype=bool)
                known[order] = same & ((doc[order] != doc[first]) | (start[order] != start[first]))  # rows that repeat a document are no earlier place
                cols = [minimiser.view(np.int64), digest.view(np.int64), doc, start.astype(np.int32), n.astype(np.int32), loop, known]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in _STRETCH.split(", ")])

    return docs.mapInArrow(work, _STRETCH)


def sort_out(table: DataFrame) -> DataFrame:
    """minimiser, doc_id, start, n, again of the stretches that matter.

    ``again``: equal to an earlier one as a whole. The others share their minimiser with a different
    stretch, or hold it twice. One exchange by minimiser (known repeats go anywhere); the sorted rows
    are read as a stream that remembers one row, so a common minimiser takes time but no memory.
    """
    names = ("minimiser", "digest", "doc_id", "start", "n", "loop", "known")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_m = last_d = waiting = None  # waiting: the first row of a minimiser that has one digest so far
        origin = (0, 0)  # doc_id and start of the first row of the digest that goes on
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            m, d, doc, start, n, loop, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
            goes_on = last_m is not None and m[0] == last_m
            same_m = np.append(goes_on, m[1:] == m[:-1])
            same_d = np.append(goes_on and d[0] == last_d, d[1:] == d[:-1]) & same_m
            at = np.maximum.accumulate(np.where(same_d, -1, np.arange(len(d))))  # -1: begun in an earlier batch
            again = known | (same_d & ((doc != np.where(at < 0, origin[0], doc[at])) | (start != np.where(at < 0, origin[1], start[at]))))
            origin = (int(doc[at[-1]]), int(start[at[-1]])) if at[-1] >= 0 else origin
            group = np.cumsum(~same_m)  # 0: the one that goes on
            mixed = np.zeros(group[-1] + 1, dtype=bool)
            mixed[0] = several
            mixed[group[same_m & ~same_d]] = True
            emit = again | mixed[group] | loop
            rows = np.flatnonzero(emit)
            cols = [m[rows], doc[rows], start[rows], n[rows], again[rows]]
            if waiting is not None and goes_on and mixed[0]:
                cols = [np.append(c, w).astype(c.dtype) for c, w in zip(cols, waiting, strict=True)]
                waiting = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["minimiser", "doc_id", "start", "n", "again"])
            last_m, last_d, several = m[-1], d[-1], bool(mixed[group[-1]])
            if group[-1] > 0:
                waiting = None
                k = int(np.searchsorted(group, group[-1]))
                if not emit[k]:
                    waiting = (m[k], doc[k], start[k], n[k], False)

    key = F.when(F.col("known"), F.xxhash64("doc_id", "start")).otherwise(F.col("minimiser"))
    dealt = table.withColumn("_key", key).repartition("_key").sortWithinPartitions("minimiser", "digest", "doc_id", "start").drop("_key")
    return dealt.mapInArrow(work, "minimiser long, doc_id long, start int, n int, again boolean")


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` symbols at least (symbols 0..256), and the lengths of
    common prefixes below eight between neighbours (8: eight or more). Shorter suffixes sort first."""
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    # Eight symbols in one key: 0 marks the end of a stretch, so symbols need nine bits; seven fit a word.
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    differ = ordered[1:] ^ ordered[:-1]
    common = np.full(n, 7, np.int16)
    common[0] = 0
    for k in range(7):
        common[1:] = np.where((differ >> np.uint64(9 * (6 - k)) != 0) & (common[1:] == 7), k, common[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(differ != 0)))
    have = 7
    while have < depth:
        second = np.zeros(n, np.int64)
        second[: n - have] = rank[have:] + 1 if have < n else 0
        # Only suffixes that share their rank are sorted again.
        size = np.bincount(rank)
        again = order[size[rank[order]] > 1]
        if not len(again):
            break
        places = np.flatnonzero(size[rank[order]] > 1)
        by = np.argsort(rank[again] * np.int64(n + 1) + second[again], kind="stable")
        order[places] = again[by]
        pair_rank, pair_second = rank[order], second[order]
        rank[order] = np.concatenate(([0], np.cumsum((pair_rank[1:] != pair_rank[:-1]) | (size[pair_rank[1:]] > 1) & (pair_second[1:] != pair_second[:-1]))))
        have *= 2
    return order, common


def equal_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it the number of its class: equal first ``length`` symbols.

    Symbol 0 ends a stretch. Intervals of all patterns of one length are extended backward by one
    symbol at a time; an interval that ends where no common prefix is set yet sets it to that length
    and is extended further, any other is dropped. What is still open at ``length`` is a class.
    Only classes of suffixes with ``length`` symbols before their 0 mean anything.
    """
    n = len(text)
    order, common = transform(text, length)
    before = text[order - 1]  # the transform: the symbol in front (of the first suffix: the last 0)
    to = np.empty(n, np.int64)
    by_symbol = np.argsort(before, kind="stable")
    to[by_symbol] = np.arange(n)
    head = text[order]
    open_ = np.ones(n + 1, dtype=bool)
    open_[:n][common < 7] = False
    open_[n] = False
    # Patterns of seven symbols whose right neighbour differs in the last of them, or at the end of the order.
    edge = np.append(np.flatnonzero(common < 7), n)
    right = np.append(common, 6)[edge[1:]] == 6
    begin, end = edge[:-1][right], edge[1:][right]
    for level in range(7, length):
        if not len(begin):
            break
        size = end - begin
        place = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        owner = np.repeat(np.arange(len(begin)), size)
        go = before[place] != 0
        if not go.any():
            break
        target, owner = to[place[go]], owner[go]
        by = np.argsort(target, kind="stable")
        target, owner = target[by], owner[by]
        new = np.ones(len(target), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (target[1:] != target[:-1] + 1) | (head[target[1:]] != head[target[:-1]])
        first = np.flatnonzero(new)
        begin = target[first]
        end = target[np.append(first[1:], len(target)) - 1] + 1
        sets = open_[end]
        begin, end = begin[sets], end[sets]
        open_[end] = False  # the common prefix of places end - 1 and end is ``level``
    return order, np.cumsum(~open_[:n])


def bucket_repeats(doc: np.ndarray, start: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, first, last + 1): runs of starts whose string also starts earlier in the bucket."""
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 0
    order, number = equal_classes(joined, length)
    stretch = np.repeat(np.arange(len(texts)), sizes + 1)
    place = np.arange(len(joined)) - np.repeat(ends - sizes, sizes + 1)
    full = place + length <= sizes[stretch]
    keep = full[order]
    at, number = order[keep], number[keep]
    s = stretch[at]
    by = np.lexsort((start[s] + place[at], doc[s], number))
    number, at = number[by], at[by]
    same = np.append(False, number[1:] == number[:-1])[: len(number)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(number))))
    d, p = doc[stretch[at]], start[stretch[at]] + place[at]
    later = at[same & ((d != d[first]) | (p != p[first]))]  # the first place doesn't repeat itself, however many rows hold it
    d, p = doc[stretch[later]], start[stretch[later]] + place[later]
    by = np.lexsort((p, d))
    d, p = d[by], p[by]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1))) if len(d) else np.zeros(0, np.int64)
    return d[cut], p[cut], p[np.append(cut[1:], len(p)) - 1] + 1 if len(d) else p


_RANGE = "doc_id long, first int, last int"


def _with_texts(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Adds ``text`` (binary) to stretches (minimiser, doc_id, start, n)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer()
                data = memoryview(data) if data is not None else b""
                for w in wanted:
                    for col, value in zip(out, (w["minimiser"], doc, w["start"], bytes(data[w["start"] : w["start"] + w["n"] + length - 1])), strict=True):
                        col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["minimiser", "doc_id", "start", "text"])

    wanted = rows.groupBy("doc_id").agg(F.collect_list(F.struct("minimiser", "start", "n")).alias("wanted"))
    return docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(work, "minimiser long, doc_id long, start int, text binary")


def _hot_ranges(texts: DataFrame, length: int) -> DataFrame:
    """Repeats among stretches of very common minimisers: each string by a 128-bit digest, summed up before it is dealt out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                data = [b.as_py() for b in part.column("text")]
                s = Slice(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))), 0)
                n = np.diff(s.offsets) - length + 1
                at = np.repeat(s.offsets[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                one = s.span_hashes(at, at + length)
                two = s.span_hashes(at, at + length, seed=1)
                row = np.repeat(np.arange(s.n), n)
                doc, place = part.column("doc_id").to_numpy()[row], part.column("start").to_numpy()[row] + at - s.offsets[row]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32))], names=["d1", "d2", "doc_id", "place"])

    strings = texts.mapInArrow(work, "d1 long, d2 long, doc_id long, place int")
    first = strings.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = strings.join(first, ["d1", "d2"]).filter(F.struct("doc_id", "place") != F.col("first"))
    return later.select("doc_id", F.col("place").alias("first"), (F.col("place") + 1).alias("last"))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, first, last): ranges of byte starts whose string of ``length`` also starts earlier.

    docs: doc_id (long, not null) and text (not null).
    """
    found = stored(sort_out(stretch_table(docs, length)))
    same = found.filter("again").select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("last"))
    odd = found.filter("not again").drop("again")
    hot = odd.groupBy("minimiser").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_STRETCHES).drop("_n")
    texts = stored(_with_texts(docs, odd, length))
    bulk = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = int(bulk // BUCKET_BYTES) + 1
    kind = T.StructType.fromDDL(_RANGE)

    def solve(table: pa.Table) -> pa.Table:
        d, a, b = bucket_repeats(table.column("doc_id").to_numpy(), table.column("start").to_numpy().astype(np.int64), [x.as_py() for x in table.column("text")], length)
        return pa.table([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=kind.names)

    cold = texts.join(hot, "minimiser", "left_anti").withColumn("_b", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)))
    solved = cold.groupBy("_b").applyInArrow(solve, kind)
    return same.unionByName(solved).unionByName(_hot_ranges(texts.join(hot, "minimiser", "left_semi"), length))


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller
    doc_id, or before in the same text. Strings never cross texts and are judged on the input. Null
    texts are empty; texts shorter than ``length`` and rows without doc_id stay whole; an empty table
    gives no rows. Rows that repeat a doc_id and its text are one document and are cut alike, so a passage stays in all of them
    where it comes first. Rows that share a doc_id but not the text are cut by their joint list.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeated_starts(given.filter("doc_id is not null"), length)
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text, ranges_ in zip(batch.column("text"), batch.column("ranges"), strict=True):
                data = text.as_py().encode()
                if not ranges_.is_valid:
                    row = (len(data), 0, 0, data)
                else:
                    spans = ranges_.values
                    mark = np.zeros(len(data) + 1, np.int32)
                    np.add.at(mark, np.minimum(spans.field("first").to_numpy(), len(data)), 1)
                    np.add.at(mark, np.minimum(spans.field("last").to_numpy() + length - 1, len(data)), -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    row = (len(data), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes())
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return given.join(by_doc, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
