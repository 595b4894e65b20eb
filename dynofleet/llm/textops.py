"""Numpy kernels over the flat UTF-8 bytes of Arrow string columns.

A batch of texts is cut into slices of a few megabytes so that the temporary arrays stay
small whatever the size of the Arrow batch; a text is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_table(seed: int, dtype=np.uint64) -> np.ndarray:
    """256 fixed random words, the same in every task and run."""
    return np.random.default_rng(seed).integers(0, np.iinfo(dtype).max, 256, dtype=dtype, endpoint=True)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes read at once; spans beyond _LONG bytes are digested one by one.
_LANE, _LONG = 8, 1024
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _ODD)
    down = np.full(n + 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from every place on, from one running sum of powers.

    It only deals strings out, so that equal ones meet; whether they are equal is decided by other means.
    """
    up, down = _powers(max(SLICE_BYTES, 1 << int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_table(7)[data] * up[: len(data)], out=total[1:])
        return mix((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; other seeds give other, independent hashes.

    Eight bytes at a time are mixed into a state, as in a block hash. There is no algebra between
    texts and hashes (as with sums of powers) by which one could write texts that collide for any seed;
    spans beyond _LONG bytes are digested by keyed BLAKE2.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(_LANE, np.uint8)))
    words = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019) * np.uint64(2 * seed + 1))
        use, at, left = np.arange(len(size)), starts, size
        if len(size) and int(size.max()) > _LONG:
            use = np.flatnonzero(size <= _LONG)
            at, left = starts[use], size[use]
        while True:
            on = np.flatnonzero(left > 0)
            if not len(on):
                break
            if len(on) < len(use):
                use, at, left = use[on], at[on], left[on]
            lane = words[at] & _MASKS[np.minimum(left, _LANE)]
            out[use] = mix(mix(out[use] ^ lane) * _ODD + lane)
            at, left = at + _LANE, left - _LANE
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(16, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


class Slice:
    """Some whole texts: rows ``lo..hi`` of a batch, as flat bytes and offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int):
        self.data, self.offsets, self.lo = data, offsets, lo
        self.hi = lo + len(offsets) - 1
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False, apart: np.ndarray = _SPACE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes outside ``apart`` (0x20 and 0x09-0x0D): starts, ends, 64-bit hashes, and offsets by text."""
        b = self.data
        if not len(b):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), np.zeros(self.n + 1, np.int64)
        inside = ~apart[b]
        first = np.zeros(len(b) + 1, dtype=bool)  # a text starts here
        first[self.offsets] = True
        before = np.empty(len(b) + 1, dtype=bool)
        before[0], before[1:] = False, inside
        now = np.append(inside, False)
        starts = np.flatnonzero(now & (first | ~before))
        ends = np.flatnonzero(before & (first | ~now))
        hashes = hash_spans(_LOWER[b] if lower else b, starts, ends, seed)
        return starts, ends, hashes, np.searchsorted(starts, self.offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, starts, ends, seed)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column (null: empty) in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield Slice(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi
    pa.default_memory_pool().release_unused()  # workers live on from stage to stage, several an executor


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` following words and their offsets by text; a text of 1 to k-1 words gives one shingle of all of them.

    ``words``: word hashes; ``bounds``: the word offsets of the texts.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    at = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(len(out))
    size = np.minimum(np.repeat(n, count), k)
    with np.errstate(over="ignore"):
        for j in range(k):
            use = size > j
            here = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else out
            out = np.where(use, mix(out * _ODD + here + np.uint64(j + 1)), out)
    return out, out_bounds


def distinct_by_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(bounds)))
