"""SentencePiece encoding and decoding through a distinct-chunk table.

The model's pieces may start with white-space markers but never hold a marker after another
character, so no merge crosses the front of a marked word: segmenting a text is segmenting each
of its marked words. A task keeps a table of the distinct marked words it has seen, segments each
of them once with the library, and joins the ids back by position. There is no exchange: a global
table would shuffle every (block, word) pair twice to save the segmentation of words that other
tasks have seen too, which costs a few microseconds a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Distinct marked words -> ids, filled by the library, emptied when it holds about ``limit`` bytes."""

    kept: dict[str, ChunkTable] = {}

    def __init__(self, model: str, limit: int = 200_000_000):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        self.limit, self.held = limit, 0
        self.ids: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of_worker(cls, model: str) -> ChunkTable:
        """The table of this Python worker: its later tasks find the words of the earlier ones."""
        if model not in cls.kept:
            cls.kept[model] = cls(model)
        return cls.kept[model]

    def add(self, chunks: set[str]) -> None:
        if self.held > self.limit:
            self.ids, self.held = {}, 0
        new = [c for c in chunks if c not in self.ids]
        # The library puts a marker in front itself; one marker alone has no text that gives it.
        for c, ids in zip(new, self.lib.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1), strict=True):
            self.ids[c] = tuple(ids) if len(c) > 1 else (self.lib.piece_to_id(MARK),)
        self.held += sum(map(len, new)) + 250 * len(new)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text, exactly as the library gives them for the whole text."""
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.add(set(chain.from_iterable(cut)))
        get = self.ids.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]


def _by_size(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array<int>) of every whole text; null and empty texts have no ids.

    Repeated texts are encoded alike, other columns are ignored, an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable.of_worker(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text_").to_pylist()]
            for lo, hi in _by_size(texts):
                ids = pa.array(table.encode(texts[lo:hi]), pa.list_(pa.int32()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, "ids"])

    source = docs.select(*keep, docs[text].alias("text_"))
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(work, schema)


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` and ``text``: what the library's decode gives for each id list (null: empty text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = [lib.decode(x) if x else "" for x in batch.column("ids_").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*keep, encoded[ids].alias("ids_")).mapInArrow(work, encoded.select(*keep).schema.add("text", "string"))


def round_trip_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, only digests leave the task.

    Null and empty texts: no ids, digests of the empty string.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable.of_worker(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _by_size(texts):
                ids = table.encode(texts[lo:hi])
                back = [table.lib.decode(x) if x else "" for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(str(x)[1:-1].replace(" ", "").encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
