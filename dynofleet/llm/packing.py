"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Round 0 tokenises and packs best-fit inside each partition. Bins that are nearly full leave; the
underfull ones go on as items, with their members, to the next round, in which several partitions
meet in one. Every round is a written table, so a lost executor costs a task. Rounds end when all
underfull bins fit one task, or when a round over partitions that are already full of items brings
no more; the tree never forces more items into a task than ``task_items``.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.llm.common import stored

_CUT = re.compile(r"[ \n]+")
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))
_BIN = "used int, members array<struct<doc_id:bigint,piece:int,start:bigint,length:int,ids_crc32:bigint,offset:bigint>>, open boolean"


#: Marks at the end of a word that stand alone for the tokenizer when a letter comes before them.
_TAIL = re.compile(r"(?<=[A-Za-z])[.,;:?!#*$%&]+\Z")
#: A special token, taken out before anything else is done: it keeps the words of a long string apart.
_APART, _APART_ID = "<|startoftext|>", 49406


class WordIds:
    """Distinct blank-separated words -> their ids as little-endian bytes, each tokenised once.

    The tokenizer of this vocabulary splits at white space and drops it, and none of its
    normalisers looks across a blank, so the ids of a text are those of its words in order.
    New words go to the library a few thousand at once, with a special token between them; a word
    that ends in marks after an ASCII letter is looked up without them first, as letters and marks
    are split anyway. The table is emptied when it holds ``limit`` bytes, about 200 for a word.
    """

    kept: dict[str, WordIds] = {}

    def __init__(self, path: str, limit: int = 200_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        if self.lib.token_to_id(_APART) != _APART_ID:
            raise ValueError("this vocabulary has another special token")
        self.limit, self.held = limit, 0
        self.ids: dict[str, bytes] = {"": b""}

    @classmethod
    def of_worker(cls, path: str, limit: int) -> WordIds:
        """The table of this Python worker: its later tasks find the words of the earlier ones."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        cls.kept[path].limit = limit
        return cls.kept[path]

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.ids.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + 180 * len(words)

    def _tokenise(self, words: list[str], at_once: int = 4096) -> None:
        for w in (w for w in words if _APART in w):
            self._keep([w], [np.array(self.lib.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()])
        words = [w for w in words if _APART not in w]
        for i in range(0, len(words), at_once):
            some = words[i : i + at_once]
            ids = np.array(self.lib.encode_batch_fast([_APART.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut, data = np.flatnonzero(ids == _APART_ID).tolist(), ids.tobytes()
            self._keep(some, [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cut)], [*cut, len(ids)], strict=True)])

    def add(self, words: set[str]) -> None:
        if self.held > self.limit:
            self.ids, self.held = {"": b""}, 0
        get = self.ids.get
        new = [w for w in words if get(w) is None]
        ending = [(w, m.start()) for w in new if (m := _TAIL.search(w))]
        tailed = {w for w, _ in ending}
        parts = {w for w in new if w not in tailed}
        parts.update(x for w, k in ending for x in (w[:k], w[k:]) if get(x) is None)
        self._tokenise(list(parts))
        self._keep([w for w, _ in ending], [self.ids[w[:k]] + self.ids[w[k:]] for w, k in ending])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_CUT.split(t) if "\n" in t else t.split(" ") for t in texts]
        self.add(set().union(*cut))
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in cut]


class BestFit:
    """Open bins by room left; a bit mask finds the tightest one that fits.

    Items come largest first. Equal rooms are taken last in, first out, so the outcome depends on
    the order of the items alone.
    """

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: dict[int, list[int]] = {}
        self.bins: list[list[int]] = []
        self.rooms: list[int] = []

    def place(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            room, at = self.capacity, len(self.bins)
            self.bins.append([])
            self.rooms.append(0)
        self.bins[at].append(item)
        self.rooms[at] = room = room - size
        if room:
            self.by_room.setdefault(room, []).append(at)
            self.mask |= 1 << room


def pack_items(sizes: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, largest first: (used, indices) of every bin."""
    fit = BestFit(capacity)
    for i in np.argsort(-sizes, kind="stable"):
        fit.place(int(i), int(sizes[i]))
    return [(capacity - room, items) for room, items in zip(fit.rooms, fit.bins, strict=True)]


def _bins(sizes: list[int], members: list[list], capacity: int, slack: int) -> pa.RecordBatch:
    packed = pack_items(np.array(sizes, dtype=np.int64), capacity)
    rows = []
    for _, items in packed:
        at, row = 0, []
        for doc, piece, start, length, crc, *_ in (m for i in items for m in members[i]):
            row.append((doc, piece, start, length, crc, at))
            at += length
        rows.append(row)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([used for used, _ in packed], pa.int32()),
            pa.array(rows, _MEMBERS),
            pa.array([used < capacity - slack for used, _ in packed], pa.bool_()),
        ],
        names=["used", "members", "open"],
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    end_id: int = 1,
    slack: int = 16,
    fan_in: int = 8,
    task_items: int = 50_000,
    table_bytes: int = 200_000_000,
) -> DataFrame:
    """Packs all texts; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text (null: empty) is its ids and ``end_id``. Only longer ones than ``capacity`` are cut, into
    pieces of ``capacity``; the last may be shorter. A bin with at most ``slack`` places left counts
    as full. ``task_items`` bounds the items that one task packs at once; a partition with more is
    packed in several runs, whose open bins meet again in the next round. ``table_bytes`` bounds the
    word table that a Python worker keeps, also when later stages of another kind run in it.
    Repeated rows are packed as often as they come; an empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes, members = WordIds.of_worker(tokenizer, table_bytes), [], []
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            lo = size = 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size < 1 << 20 and hi < len(texts):
                    continue
                for doc, found in zip(ids[lo:hi], words.encode(texts[lo:hi]), strict=True):
                    data, step = found + tail, 4 * capacity
                    for k in range(0, len(data), step):
                        part = data[k : k + step]
                        sizes.append(len(part) // 4)
                        members.append([(doc, k // step, k // 4, len(part) // 4, zlib.crc32(part))])
                lo, size = hi, 0
                if len(sizes) >= task_items:
                    yield _bins(sizes, members, capacity, slack)
                    sizes, members = [], []
        if sizes:
            yield _bins(sizes, members, capacity, slack)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, members = [], []
        for batch in batches:
            sizes += batch.column("used").to_pylist()
            members += [[tuple(m.values()) for m in x] for x in batch.column("members").to_pylist()]
            if len(sizes) >= task_items:
                yield _bins(sizes, members, capacity, slack)
                sizes, members = [], []
        if sizes:
            yield _bins(sizes, members, capacity, slack)

    source = docs.select(F.col("doc_id").cast("long"), "text")
    parts = max(1, source.rdd.getNumPartitions())
    bins = stored(source.mapInArrow(first, _BIN))
    done = [bins.filter("not open")]
    left = bins.filter("open")
    before = None
    while True:
        count = left.count()
        if not count:
            break
        # As many tasks as the tree says, but no fewer than keep each within its bound.
        fewest = -(-count // task_items)
        if before is not None and (parts == 1 or parts <= fewest and count > 0.98 * before):
            done.append(left)
            break
        parts, before = max(1, fewest, -(-parts // fan_in)), count
        bins = stored(left.repartition(parts).mapInArrow(again, _BIN))
        done.append(bins.filter("not open"))
        left = bins.filter("open")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    numbered = out.select("members", F.monotonically_increasing_id().alias("sequence_id"))  # before the explode
    return numbered.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32", "sequence_id", "m.offset"
    )
