"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 8 bytes decides where chunks end, so an insertion moves no
boundary beyond its own neighbourhood. Chunks are deduplicated by an 88-bit digest: all but the
first occurrence, in order of doc_id and place, are repeats. The chunks that hang over the ends of
a shared passage don't repeat: at both ends of every run of repeats the bytes are compared with those
around the earlier occurrence, and the run grows as far as they agree. Runs that are long enough then
are cut out of their document. Every byte cut stands earlier, by doc_id and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.llm.common import sized_broadcast, stored
from dynofleet.llm.textops import Slice, byte_table, slices

GEAR = byte_table(11, np.uint32)
#: A boundary is where the hash is smallest within so many bytes on either side, so chunks have 33 bytes in the mean
#: and few are much longer; a chunk never exceeds LONGEST bytes (nine bits).
APART, LONGEST = 16, 511
#: The hash of places that end no character.
_NEVER = np.uint32(0xFFFFFFFF)
#: Bytes from the end of a run within which its chunks say where to compare on; and bytes compared beyond the
#: chunk that hangs over, as a boundary depends on the bytes within APART, and on 7 before those.
NEAR, MARGIN = 128, 24
#: Bytes that a run of repeated chunks must have to be cut out.
LEAST_RUN = 100
#: Bytes of text chunked at once: a dozen words of memory for each.
SLICE = 1 << 20


def gear_hash(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sum of GEAR[byte k back] << k over the last 8 bytes of the same text, by doubling the window."""
    h = GEAR[data]
    for m in (1, 2, 4):
        back = np.zeros_like(h)
        back[m:] = h[:-m] << np.uint32(m)
        back[place < m] = 0
        h = h + back
    return h


def smallest_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of x[i : i + width], by doubling; the last places see fewer."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def chunks(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the chunks of a slice; chunks tile their texts."""
    data, n_bytes = s.data, np.diff(s.offsets)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    place = np.arange(len(data)) - np.repeat(s.offsets[:-1], n_bytes)
    h = gear_hash(data, place)
    whole = np.append((data[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
    h = np.where(whole, h >> np.uint32(1), _NEVER)
    # Texts are set apart, so that none sees its neighbours.
    pos = np.arange(len(data)) + APART * (np.repeat(np.arange(s.n), n_bytes) + 1)
    spread = np.full(len(data) + APART * (s.n + 1) + 1, _NEVER)
    spread[pos] = h
    low = smallest_of(spread, APART)
    at = np.flatnonzero(whole & (h < low[pos - APART]) & (h <= low[pos + 1])) + 1
    ends = np.unique(np.concatenate((at, s.offsets[1:][n_bytes > 0])))
    starts = np.concatenate(([0], ends[:-1]))
    more = []
    for k in np.flatnonzero(ends - starts > LONGEST):  # no boundary for long: cut by count, at characters
        x = int(starts[k]) + LONGEST
        while x < ends[k]:
            back = 0
            while back < 3 and not whole[x - back - 1]:
                back += 1
            x -= back
            more.append(x)
            x += LONGEST
    if more:
        ends = np.unique(np.concatenate((ends, np.array(more, np.int64))))
        starts = np.concatenate(([0], ends[:-1]))
    return starts, ends, np.searchsorted(s.offsets, starts, side="right") - 1


def _placed(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Two words a chunk: start << 29 | length << 20 | length of the chunk before << 11 | of the one after << 2
    (0: none), which sorts by start; and the byte before << 8 | the byte after."""
    size = ends - starts
    before, after = np.zeros_like(size), np.zeros_like(size)
    same = owner[1:] == owner[:-1]
    before[1:][same], after[:-1][same] = size[:-1][same], size[1:][same]
    bytes_ = s.data[starts - 1].astype(np.uint64) << np.uint64(8) | s.data[ends % max(len(s.data), 1)].astype(np.uint64)
    return (starts - s.offsets[owner]) << 29 | size << 20 | before << 11 | after << 2, bytes_


def _span(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 29, (at >> 29) + (at >> 20 & LONGEST)


def _may_grow(at: np.ndarray, bytes_: np.ndarray, first_at: np.ndarray, first_bytes: np.ndarray) -> np.ndarray:
    """``at`` with two lowest bits: the bytes before, and after, are the same at the first occurrence."""
    differ = bytes_ ^ first_bytes
    left = (differ >> 8 & 255 == 0) & (at >> 11 & LONGEST > 0) & (first_at >> 11 & LONGEST > 0)
    right = (differ & 255 == 0) & (at >> 2 & LONGEST > 0) & (first_at >> 2 & LONGEST > 0)
    return at | left.astype(np.int64) << 1 | right.astype(np.int64)


_CHUNKS = "d1 long, d2 long, doc_id long, at long, first_doc long, first_at long"


def chunk_table(docs: DataFrame) -> DataFrame:
    """d1, d2 (its 16 lowest bits are the bytes beside), doc_id, at, first_doc, first_at of every chunk.

    ``first_doc`` and ``first_at`` are set where the same slice of the input holds the chunk earlier:
    it is a repeat whatever else there is and is not compared by digest; a common passage is sent once a slice.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for s in slices(batch.column("text"), SLICE):
                starts, ends, owner = chunks(s)
                d1, d2 = s.span_hashes(starts, ends), s.span_hashes(starts, ends, seed=1)
                doc, (at, beside) = ids[s.lo : s.hi][owner], _placed(starts, ends, owner, s)
                d2 = d2 >> np.uint64(40) << np.uint64(16) | beside  # 24 bits of digest
                order = np.lexsort((at, doc, d2 >> np.uint64(16), d1))
                d1, d2, doc, at = d1[order].view(np.int64), d2[order].view(np.int64), doc[order], at[order]
                known = np.zeros(len(order), dtype=bool)
                known[1:] = (d1[1:] == d1[:-1]) & (d2[1:] >> 16 == d2[:-1] >> 16)
                first = np.maximum.accumulate(np.where(known, 0, np.arange(len(order))))
                at = np.where(known, _may_grow(at, d2, at[first], d2[first]), at)
                cols = [pa.array(d1), pa.array(d2), pa.array(doc, pa.int64()), pa.array(at, pa.int64())]
                cols += [pa.array(doc[first], pa.int64(), mask=~known), pa.array(at[first], pa.int64(), mask=~known)]
                yield pa.RecordBatch.from_arrays(cols, names=["d1", "d2", "doc_id", "at", "first_doc", "first_at"])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(work, _CHUNKS)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id and ``again``: array of (at, d1, first_doc, first_at) of the chunks of a document that come earlier elsewhere.

    One exchange by digest, sorted; a stream over the sorted rows remembers the first of a digest.
    """
    names = ["doc_id", "at", "d1", "first_doc", "first_at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # d1, d2, doc_id, at of the first row of the digest that goes on
        for batch in batches:
            known = batch.column("first_doc").is_valid()
            yield batch.filter(known).select(names)
            d1, d2, doc, at = _fresh(batch)
            if not len(d1):
                continue
            if last is not None:
                d1, d2, doc, at = (np.concatenate(([x], c)) for x, c in zip(last, (d1, d2, doc, at), strict=True))
            new = np.ones(len(d1), dtype=bool)
            new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] >> 16 != d2[:-1] >> 16)
            first = np.maximum.accumulate(np.where(new, np.arange(len(d1)), 0))
            rows = np.flatnonzero(~new & ((doc != doc[first]) | (at != at[first])))
            of = first[rows]
            cols = (doc[rows], _may_grow(at[rows], d2[rows], at[of], d2[of]), d1[rows], doc[of], at[of])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
            last = tuple(int(c[first[-1]]) for c in (d1, d2, doc, at))

    # Known repeats go past the comparison, by document, to spare common digests.
    rows = chunk_table(docs).repartition(F.when(F.col("first_doc").isNull(), F.col("d1")).otherwise(F.col("doc_id")))
    found = rows.sortWithinPartitions("d1", F.shiftright("d2", 16), "doc_id", "at").mapInArrow(work, "doc_id long, at long, d1 long, first_doc long, first_at long")
    # Rows are smaller in an exchange than lists of structs.
    return found.repartition("doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("at", "d1", "first_doc", "first_at")).alias("again"))


def _fresh(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    part = batch.filter(batch.column("first_doc").is_null())
    return tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2", "doc_id", "at"))


def _asking(row: np.ndarray, at: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of chunks sorted by row and place: start and end of the run that each is in, by how much the run may
    grow at its two ends, and which chunks ask there for the bytes beside their first occurrence.

    Of the chunks within NEAR bytes of an end that point to one place the outermost asks, if the next byte agrees.
    """
    start, end = _span(at)
    reach = np.maximum.accumulate((row << 34) + end)  # rows that share a doc_id may overlap
    new = np.ones(len(row), dtype=bool)
    new[1:] = ((row[1:] << 34) + start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    run, head = np.cumsum(new) - 1, np.flatnonzero(new)
    lo, hi = start[head][run], np.maximum.reduceat(end, head)[run]
    shift, out = (first >> 29) - start, []
    for left in (True, False):
        use = np.flatnonzero(start < lo + NEAR) if left else np.flatnonzero(end > hi - NEAR)[::-1]
        o = use[np.lexsort((np.arange(len(use)), shift[use], doc[use], run[use]))]
        outer = np.ones(len(o), dtype=bool)
        outer[1:] = (run[o[1:]] != run[o[:-1]]) | (doc[o[1:]] != doc[o[:-1]]) | (shift[o[1:]] != shift[o[:-1]])
        asks = np.zeros(len(at), dtype=bool)
        asks[o[outer]] = True
        asks &= at >> int(left) & 1 > 0
        edge = np.where(start == lo, at >> 11 & LONGEST, 0) if left else np.where(end == hi, at >> 2 & LONGEST, 0)
        grows = np.where(np.maximum.reduceat(asks, head), np.maximum.reduceat(edge, head) + MARGIN, 0)[run]
        out += [grows, asks]
    return lo, hi, *out


def long_runs(again: DataFrame, least_run: int) -> DataFrame:
    """``again`` without the runs that stay below ``least_run`` even with all they may grow by."""
    fields = ["at", "d1", "first_doc", "first_at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, *cols = _flat(batch.column("again"), *fields)
            if not len(row):
                continue
            order = np.lexsort((cols[0], row))
            row, cols = row[order], [c[order] for c in cols]
            lo, hi, left, _, right, _ = _asking(row, cols[0], cols[2], cols[3])
            x, y = (row << 34) + np.maximum(lo - left, 0), (row << 34) + hi + right
            # Runs that may grow into one another count as one.
            apart = np.minimum.accumulate(x[::-1])[::-1][1:] > np.maximum.accumulate(y)[:-1]
            head = np.flatnonzero(np.append(True, apart | (row[1:] != row[:-1])))
            reach = np.maximum.reduceat(y, head) - np.minimum.reduceat(x, head)
            may = np.flatnonzero(np.repeat(reach >= least_run, np.diff(np.append(head, len(row)))))
            row, cols = row[may], [c[may] for c in cols]
            rows, offsets = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, len(row)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=fields))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), lists], names=["doc_id", "again"])

    return again.mapInArrow(work, "doc_id long, again array<struct<at: long, d1: long, first_doc: long, first_at: long>>")


def _flat(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Row number and fields of all entries of an array<struct> column (null: no entries)."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), n), *(flat.field(c).to_numpy(zero_copy_only=False) for c in names)


def edges(again: DataFrame) -> DataFrame:
    """Where runs of repeats may grow, and the bytes around earlier occurrences that they may go on with.

    ``own``: place << 11 | leftward << 10 | bytes to compare; ``place``: place in first_doc << 10 | leftward << 9 |
    length of the chunk with digest d1 that begins (leftward) or ends there.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, d1, doc, first = _flat(batch.column("again"), "at", "d1", "first_doc", "first_at")
            if not len(row):
                continue
            order = np.lexsort((at, row))
            row, at, d1, doc, first = row[order], at[order], d1[order], doc[order], first[order]
            start, end = _span(at)
            lo, hi, before, asks_left, after, asks_right = _asking(row, at, doc, first)
            for left, o in ((1, np.flatnonzero(asks_left)), (0, np.flatnonzero(asks_right))):
                pos, window = (start[o], start[o] - lo[o] + before[o]) if left else (end[o], hi[o] - end[o] + after[o])
                place = pos + (first[o] >> 29) - start[o]
                cols = (pos << 11 | left << 10 | window, doc[o], place << 10 | left << 9 | end[o] - start[o], d1[o])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[o])), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "own", "first_doc", "place", "d1"])

    return again.mapInArrow(work, "doc_id long, own long, first_doc long, place long, d1 long")


def neighbours(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id and ``beside``: array of (own, bytes) that ``edges`` asked for, each place fetched once."""
    keys = ["first_doc", "place", "d1"]
    places = asked.select(*keys, F.col("own").bitwiseAND(1023).alias("window")).repartition("first_doc").groupBy(*keys).agg(F.max("window").alias("window"))
    wanted = places.groupBy("first_doc").agg(F.collect_list(F.struct("place", "d1", "window")).alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                part = batch.slice(s.lo, s.n)
                row, place, d1, window = _flat(part.column("wanted"), "place", "d1", "window")
                pos, left, size = place >> 10, place >> 9 & 1 > 0, place & LONGEST
                n, base = np.diff(s.offsets)[row], s.offsets[row]
                start = np.where(left, pos, pos - size)
                ok = np.flatnonzero((start >= 0) & (start + size <= n))
                # Of rows that share a doc_id only those that hold the chunk there.
                ok = ok[s.span_hashes((base + start)[ok], (base + start + size)[ok]).view(np.int64) == d1[ok]]
                row, place, d1, pos, left, n, base, window = (x[ok] for x in (row, place, d1, pos, left, n, base, window))
                lo, hi = np.where(left, np.maximum(pos - window, 0), pos) + base, np.where(left, pos, np.minimum(pos + window, n)) + base
                raw = s.data.tobytes()
                found = pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("first_doc").take(pa.array(row)), pa.array(place, pa.int64()), pa.array(d1, pa.int64()), found], names=[*keys, "bytes"])

    wanted = stored(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("first_doc"), "text").join(sized_broadcast(wanted.select("first_doc"), 16), "first_doc", "left_semi")
    found = texts.join(wanted, "first_doc").mapInArrow(work, "first_doc long, place long, d1 long, bytes binary")
    return asked.join(found, keys).select("doc_id", "own", "bytes").repartition("doc_id").groupBy("doc_id").agg(F.collect_set(F.struct("own", "bytes")).alias("beside"))


def _grown(text: bytes, pos: int, leftward: bool, beside: bytes) -> tuple[int, int]:
    """The span next to ``pos`` that agrees with ``beside``, in whole characters."""
    if leftward:
        n = min(pos, len(beside))
        one, two = np.frombuffer(text[pos - n : pos], np.uint8)[::-1], np.frombuffer(beside[len(beside) - n :], np.uint8)[::-1]
    else:
        n = min(len(text) - pos, len(beside))
        one, two = np.frombuffer(text[pos : pos + n], np.uint8), np.frombuffer(beside[:n], np.uint8)
    differ = np.flatnonzero(one != two)
    same = int(differ[0]) if len(differ) else n
    lo, hi = (pos - same, pos) if leftward else (pos, pos + same)
    while lo < pos and text[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > pos and hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def cut_spans(text: bytes, spans: list[tuple[int, int]], beside: list | None, least_run: int) -> list[tuple[int, int]]:
    """The byte spans to remove: runs of repeated chunks ``spans``, grown, of at least ``least_run`` bytes."""
    if not spans:
        return []
    ends = {x for span in spans for x in span}
    grown = [_grown(text, b["own"] >> 11, b["own"] >> 10 & 1 > 0, b["bytes"]) for b in beside or () if b["own"] >> 11 in ends]
    runs: list[list[int]] = []
    for lo, hi in sorted([*spans, *grown]):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return [(lo, hi) for lo, hi in runs if hi - lo >= least_run]


def deduplicated(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``_removed`` (array of struct<start, end>: bytes cut out).

    A passage stays where it comes first, by doc_id and place. Null texts stay null and lose
    nothing, nor do rows without doc_id. Rows that share a doc_id and a text are one document and
    are cut alike. An empty table gives no rows. Texts are cut at characters, never within one.
    """
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("_removed array<struct<start:int,end:int>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for s in slices(text):
                part = batch.slice(s.lo, s.n)
                row, at, d1 = _flat(part.column("_again"), "at", "d1")
                start, end = _span(at)
                ok = np.flatnonzero(end <= np.diff(s.offsets)[row])
                row, start, end, d1 = row[ok], start[ok], end[ok], d1[ok]
                # Rows that share a doc_id share the list: each takes what it holds.
                ok = s.span_hashes(start + s.offsets[row], end + s.offsets[row]).view(np.int64) == d1
                row, start, end = row[ok], start[ok], end[ok]
                of = np.searchsorted(row, np.arange(s.n + 1))
                out, removed = part.column("text").to_pylist(), [[] for _ in range(s.n)]
                beside = part.column("_beside")
                for i in np.flatnonzero(np.diff(of)).tolist():
                    a, b = of[i], of[i + 1]
                    whole, at_, kept = s.text(i), 0, []
                    removed[i] = cut_spans(whole, list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)), beside[i].as_py(), least_run)
                    if removed[i]:
                        for x, y in removed[i]:
                            kept.append(whole[at_:x])
                            at_ = y
                        out[i] = b"".join([*kept, whole[at_:]]).decode()
                cols = [pa.array(out, text.type) if c == "text" else part.column(c) for c in names]
                spans = pa.array([[{"start": x, "end": y} for x, y in r] for r in removed], kind)
                yield pa.RecordBatch.from_arrays([*cols, spans], names=[*names, "_removed"])

    again = stored(long_runs(repeats(docs), least_run))
    beside = neighbours(docs, stored(edges(again))).select(F.col("doc_id").alias("_doc2"), F.col("beside").alias("_beside"))
    lists = again.select(F.col("doc_id").alias("_doc"), F.transform("again", lambda x: F.struct(x["at"].alias("at"), x["d1"].alias("d1"))).alias("_again"))
    both = lists.join(beside, F.col("_doc") == F.col("_doc2"), "left").drop("_doc2")
    # Documents without repeats need no join with their lists.
    ids = sized_broadcast(again.select(F.col("doc_id").alias("_doc")), 16)
    same = F.col("doc_id").cast("long") == F.col("_doc")
    cut = docs.join(ids, same, "left_semi").join(both, same).drop("_doc").mapInArrow(work, schema)
    whole = docs.join(ids, same, "left_anti").withColumn("_removed", F.array().cast(schema["_removed"].dataType))
    return cut.unionByName(whole)


def removal_digests(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (null text: empty)."""
    cut = deduplicated(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), least_run)
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate("_removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("n_removed"),
        F.size("_removed").cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
