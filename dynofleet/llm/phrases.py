"""Fingerprints of whole texts by locally consistent parsing.

A text is a sequence of names, at first its UTF-8 bytes. On each level runs of one name become one; deterministic
coin tossing then compares every name with its left neighbour (twice the lowest bit in which they differ, plus that bit) again and
again until six labels are left, which still differ from neighbour to neighbour. A phrase begins where
a label is larger than both neighbours: after two names at least and twelve at most. It is named by a hash
of the names in it, and the phrases are the next level's sequence, until one is left.

Where a phrase begins depends on a few names around it only. So equal substrings have the same phrases and names inside,
wherever they stand; only phrases at their ends differ. A text's signature is the set of names from level LOWEST on (about
seven bytes a phrase), or its last name if it has fewer levels. The fingerprint is a sketch of that set: of BINS
classes of names each keeps 16 bits of its smallest. Likeness is the part of classes that agree, of those that are not
empty in both: an estimate of the sets' Jaccard similarity, 1 for two empty texts.

``fingerprinted`` compares every document with its edited text and with the next document. Documents are dealt out by ranges of
(doc_id, text hash), so texts move once and each task meets its documents in order; the first one of every range is also sent to the
range before. No document, link or fingerprint goes to the driver: it sees bounds, and one id a range.

Null texts are empty. Documents are ordered by doc_id, nulls first, and rows of one doc_id by a hash of the text and the text, so
repeated rows follow each other; the last one is followed by the first, a single one by itself. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.textops import byte_table, mix

#: The first level whose names count, and classes of a sketch.
LOWEST, BINS = 2, 128
#: Bytes of text parsed at once, and ranges of documents at most.
SLICE, RANGES = 1 << 20, 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = byte_table(13)


def _tossed(size: int) -> np.ndarray:
    """Label of a name after a left neighbour, for all names below ``size``: twice the lowest bit that differs, plus that bit."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    apart = left ^ own
    bit = np.bitwise_count((apart & -apart) - 1)
    return np.where(apart == 0, 0, 2 * bit + (own >> np.where(apart == 0, 0, bit) & 1)).astype(np.uint8).ravel()


#: 256 names give 16 labels, those 8, and those 6.
_TABLES = [(np.uint16(8), _tossed(256)), (np.uint16(4), _tossed(16)), (np.uint16(3), _tossed(8))]


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six labels, unlike between neighbours, of names (bytes or 64-bit words) that are unlike between neighbours.

    ``first``: places where a text begins; there the left neighbour is taken to differ in bit 0.
    """

    def left(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = x[first] ^ x.dtype.type(1)
        return out

    if names.dtype == np.uint64:
        apart = left(names) ^ names
        bit = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1))
        names = (bit << 1) | ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for shift, table in _TABLES:
        names = table[(left(names).astype(np.uint16) << shift) | names]
    return names


def next_level(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of all texts, and the texts' new bounds; every text has a name at least."""
    first = bounds[:-1]
    begins = np.zeros(len(names) + 1, bool)
    begins[bounds] = True
    runs = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])) | begins[:-1])
    times = np.diff(np.append(runs, len(names)))
    own = names[runs]
    values = _FIRST[own] if own.dtype == np.uint8 else own
    more = np.flatnonzero(times > 1)
    if len(more):
        values = values.copy()
        values[more] = mix(values[more] ^ (_ODD * times[more].astype(np.uint64)))
    first = np.searchsorted(runs, first)
    bounds = np.append(first, len(runs))
    label = labels(own, first)
    high = np.zeros(len(runs), bool)
    high[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    high[bounds[1:] - 1] = False  # the last of a text
    high[first] = True
    starts = np.flatnonzero(high)
    within = np.arange(len(runs), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(runs)))).astype(np.uint64)
    phrases = mix(np.add.reduceat(mix(values + _ODD * (within + np.uint64(1))), starts))
    return phrases, np.append(np.searchsorted(starts, first), len(starts))


def signatures(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names that count, and the text of each, of several texts as flat bytes with bounds; empty texts have none."""
    owner = np.flatnonzero(np.diff(bounds))
    names, bounds = data, np.append(bounds[owner], len(data))
    found, of, level = [], [], 0
    while len(owner):
        names, bounds = next_level(names, bounds)
        level += 1
        size = np.diff(bounds)
        done = size == 1
        if level >= LOWEST:
            found.append(names)
            of.append(np.repeat(owner, size))
        elif done.any():
            found.append(names[bounds[:-1][done]])
            of.append(owner[done])
        if done.any():
            names = names[np.repeat(~done, size)]
            owner, size = owner[~done], size[~done]
            bounds = np.concatenate(([0], np.cumsum(size)))
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def sketches(texts: list[bytes]) -> np.ndarray:
    """A row of BINS 16-bit values a text, 0 where no name falls into the class."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    names, of = signatures(np.frombuffer(b"".join(texts), np.uint8), bounds)
    hashed = mix(names ^ _ODD)
    least = np.full(len(texts) * BINS, 1 << 32, np.uint64)
    np.minimum.at(least, of * BINS + (hashed % np.uint64(BINS)).astype(np.int64), hashed >> np.uint64(32))
    out = np.where(least < 1 << 32, np.maximum(least & np.uint64(0xFFFF), 1), 0).astype(np.uint16)
    return out.reshape(-1, BINS)


def written(sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: four hexadecimal digits a class."""
    whole = sketch.astype(">u2").tobytes().hex()
    return [whole[i : i + 4 * BINS] for i in range(0, len(whole), 4 * BINS)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: classes that agree, of those that are not empty in both; 1 where both are empty."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(some == 0, 1.0, same / np.maximum(some, 1))


def edited(text: str, following: str, part: int = 4) -> str:
    """``text`` with its last 1/part replaced by the first as many characters (or all) of the next one."""
    k = len(text) // part
    return text[: len(text) - k] + following[:k]


def _range_of(doc: Column, digest: Column, bounds: list[int]) -> Column:
    """Which range a document is in; ids that fill several ranges are cut by the hash of the text."""
    counted = Counter(bounds)
    ids = sorted(counted)
    times = [counted[b] - 1 for b in ids]
    before = [0]
    for t in times:
        before.append(before[-1] + 1 + t)
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(ids).bit_length(), -1, -1)))
    at = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(literal(ids), lo + s - 1) <= doc, F.lit(False)), lo + s).otherwise(lo))  # ids up to doc
    start = F.get(literal(before), at)
    hot = {b: t for b, t in zip(ids, times, strict=True) if t}
    if not hot:
        return start
    # The hash as a part of its whole range, in its own order.
    part = (digest.cast("double") + float(1 << 63)) / float(1 << 64)
    extra = F.get(F.split(F.lit(",".join(map(str, [0, *times]))), ",").cast("array<long>"), at)
    here = F.array_contains(literal(hot), doc)
    slot = F.least(F.floor(part * (extra + 1)).cast("long"), extra)
    return F.when(here, start - extra + slot).otherwise(start)


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """range, ahead, doc_id, text: documents in order within ranges, each range followed by the first one of the next (ahead = 1)."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest))
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = ", ".join(str(k / ranges) for k in range(1, ranges))
    bounds = plain.select(key.alias("k")).agg(F.expr(f"percentile_approx(k, array({parts}), {20 * ranges})").alias("b")).first().b if ranges > 1 else None
    placed = plain.withColumn("digest", F.xxhash64("text"))
    placed = placed.withColumn("range", (_range_of(key, F.col("digest"), list(bounds)) if bounds else F.lit(0)).cast("int"))
    one = F.struct(F.col("doc_id").isNotNull().alias("there"), key.alias("k"), "digest")
    heads = [(r["range"], *r.head) for r in placed.groupBy("range").agg(F.min(one).alias("head")).collect()]  # one row a range
    heads.sort()
    rows = [(heads[i - 1][0], *h) for i, h in enumerate(heads)]
    known = F.broadcast(spark.createDataFrame(rows, "to int, r int, there boolean, k long, h long"))
    is_head = (F.col("range") == F.col("r")) & (F.col("doc_id").isNotNull() == F.col("there")) & (key == F.col("k")) & (F.col("digest") == F.col("h"))
    ahead = placed.join(known, is_head).groupBy("to").agg(F.min("text").alias("text"))
    ahead = ahead.select(F.col("to").alias("range"), F.lit(1).alias("ahead"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("digest"), "text")
    both = placed.select("range", F.lit(0).alias("ahead"), "doc_id", "digest", "text").unionByName(ahead)
    dealt = both.repartitionById(max(1, heads[-1][0] + 1 if heads else 1), "range")
    return dealt.sortWithinPartitions("range", "ahead", "doc_id", "digest", "text").select("ahead", "doc_id", "text")


def fingerprinted(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spread = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = in_order(docs, min(RANGES, max(1, spread if ranges is None else ranges)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held = 0
        kind = None

        def flush() -> pa.RecordBatch:
            """All held documents but the last one, which is only a neighbour."""
            changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
            own, other = sketches([t.encode() for t in texts]), sketches(changed)
            columns = [
                pa.array(ids[: len(changed)], kind),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                pa.array(written(own[:-1])),
                pa.array(written(other)),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            kind = b.column(1).type
            for ahead, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                texts.append(text)
                held += len(text)
                if ahead:
                    yield flush()
                    ids, texts, held = [], [], 0
                    continue
                ids.append(doc)
                if held >= SLICE and len(texts) > 1:
                    yield flush()
                    ids, texts, held = ids[-1:], texts[-1:], len(text)

    of = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {of}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return stream.mapInArrow(task, schema)
