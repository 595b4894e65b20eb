"""Raw flash images: identity, checksums, differences.

Readings take one image per row: images are up to a megabyte, Spark bounds the bytes of an Arrow batch, and one image at a
time is read from it. Comparisons go by pages, so they shuffle what differs and not the images.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.sources.tables import dropped, written

# Sizes of the two kinds of image, segment names in the order of their table, and the
# stretches whose words the system checksum adds up (start, end).
KINDS = {524288: "P01", 1048576: "P59"}
SEGMENTS = ("EngineCal", "EngineDiag", "TransCal", "TransDiag", "Fuel", "System", "Speedo")
SYSTEM_LENGTH = {524288: 0x5FFFE, 1048576: 0xDFFFE}

SCHEMA = (
    """path string, length long, kind string, detected boolean, os_id long, os_version string, eeprom_style int,
    os_checksum struct<stored:int,calculated:int,ok:boolean>,
    segments array<struct<name:string,start:bigint,length:bigint,cal_id:bigint,version:string,stored:int,calculated:int,ok:boolean,error:string>>,
    vin string, serial string, broadcast_code string, hardware_id long, warnings array<string>, failed int, verdict string"""
)


FIELDS = (
    "path", "length", "kind", "detected", "os_id", "os_version", "eeprom_style", "os_checksum", "segments", "vin", "serial", "broadcast_code", "hardware_id", "warnings", "failed", "verdict",
)


def image_detect(content: Column) -> Column:
    """Is it an image: one of the two sizes, and a valid first segment."""
    return F.octet_length(content).isin(*KINDS) & (F.hex(F.substring(content, 0x504, 1)) == "01")


def u32(content: Column, at: int) -> Column:
    """Big-endian unsigned word at a byte offset."""
    return F.conv(F.hex(F.substring(content, at + 1, 4)), 16, 10).cast("long")


def word_sum(data: np.ndarray, *spans: tuple[int, int]) -> int:
    """Two's complement, 16 bits, of the sum of big-endian words at start, start + 2, ... below end."""
    total = 0
    for start, end in spans:
        n = max(0, -(-(end - start) // 2))
        part = data[start : start + 2 * n]
        total += int(part[: len(part) // 2 * 2].view(">u2").sum(dtype=np.int64)) + (int(part[-1]) << 8 if len(part) % 2 else 0)
    return -total & 0xFFFF


def _text(data: np.ndarray, at: int, n: int) -> str:
    return re.sub(r"[^a-zA-Z0-9]", "", bytes(data[at : at + n] & 0x7F).decode("ascii"))


def _be(data: np.ndarray, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n].tobytes(), "big")


def _eeprom(data: np.ndarray) -> tuple[int, int] | None:
    for base in (0x4000, 0x6000):
        for mark, style in ((0x88, 2001), (0x56, 1999)):
            if data[base + mark : base + mark + 2].tobytes() == b"\xa5\xa0":
                return base, style
    return None


def read_image(path: str, content: bytes) -> dict:
    """All readings of one image, as a row of SCHEMA; what can't be read is null and told in warnings."""
    data, warnings = np.frombuffer(content, np.uint8), []
    out = dict.fromkeys(FIELDS) | {"path": path, "length": len(data), "detected": False, "warnings": warnings}
    if len(data) not in KINDS:
        warnings.append(f"unexpected size of {len(data)} bytes")
        return out
    out["kind"] = KINDS[len(data)]
    if data[0x503] != 1:
        warnings.append("first system segment is not valid")
        return out
    out |= {"detected": True, "os_id": _be(data, 0x504, 4), "os_version": _text(data, 0x508, 2)}
    eeprom = _eeprom(data)
    if out["kind"] == "P01" and not eeprom:
        warnings.append("check word of the data block not found")
    if data[0x20000:0x20002].tobytes() != b"NV":
        warnings.append("marker of the second system segment is missing")
    calculated = word_sum(data, (0, 0x4FF), (0x502, 0x3FFF), (0x20000, 0x20000 + SYSTEM_LENGTH[len(data)] - 1))
    stored = _be(data, 0x500, 2)
    out["os_checksum"] = {"stored": stored, "calculated": calculated, "ok": stored == calculated}
    out["segments"] = []
    for i, name in enumerate(SEGMENTS):
        start, end = _be(data, 0x514 + 8 * i, 4), _be(data, 0x518 + 8 * i, 4)
        seg = {"name": name, "start": start, "length": end - start + 1, "cal_id": None, "version": None, "stored": None, "calculated": None, "ok": None, "error": None}
        if start >= len(data) or end >= len(data) or end <= start:
            seg["error"] = "address out of range"
            warnings.append(f"{name}: address out of range")
        else:
            mine, theirs = word_sum(data, (start + 2, end)), _be(data, start, 2)
            seg |= {"cal_id": _be(data, start + 4, 4), "version": _text(data, start + 8, 2), "stored": theirs, "calculated": mine, "ok": mine == theirs}
        out["segments"].append(seg)
    if eeprom:
        at, out["eeprom_style"] = eeprom
        out |= {"vin": _text(data, at + 33, 17), "serial": _text(data, at + 8, 12), "broadcast_code": _text(data, at + 28, 4), "hardware_id": _be(data, at + 4, 4)}
        if len(out["vin"]) != 17:
            warnings.append("vehicle number has not 17 characters")
    out["failed"] = sum(s["ok"] is False for s in out["segments"]) + (not out["os_checksum"]["ok"])
    out["verdict"] = "OK" if not out["failed"] else f"{out['failed']} FAILED"
    return out


def _arrow(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def analyze_images(images: DataFrame) -> DataFrame:
    """A row of SCHEMA for every image (path, content)."""
    schema = T.StructType.fromDDL(SCHEMA)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _arrow([read_image(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())], schema)

    return images.select("path", "content").mapInArrow(work, schema)


#: Bytes of a page, the unit in which images are compared.
PAGE = 4096
#: Positions of the filter that tells which pages may be asked for: 4 MB whatever the number of images.
FILTER_BITS = 1 << 25
_REGIONS = 3 + len(SEGMENTS)


_SPAN = pa.struct([("name", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("cal_id", pa.int64())])


def _spans(data: np.ndarray) -> list[dict]:
    """name, start, length, cal_id of the regions of a detected image; start is null where the segment table is out of range."""
    out = [{"name": n, "start": at, "length": k} for n, at, k in (("header", 0, 0x4000), ("eeprom", 0x4000, 0x4000), ("system", 0x20000, SYSTEM_LENGTH[len(data)]))]
    for i, name in enumerate(SEGMENTS):
        start, end = _be(data, 0x514 + 8 * i, 4), _be(data, 0x518 + 8 * i, 4)
        good = start < end < len(data)
        out.append({"name": name, "start": start if good else None, "length": end - start + 1, "cal_id": _be(data, start + 4, 4) if good and start + 4 < len(data) else None})
    return out


def _view(content: pa.Scalar) -> memoryview:
    """The bytes of a cell where Arrow holds them; null is empty."""
    return memoryview(content.as_buffer() if content.is_valid else b"")


def _pages(content: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """Digest and bytes of every page; an empty image has none."""
    for at in range(0, len(content), PAGE):
        page = content[at : at + PAGE]
        yield hashlib.sha256(page).digest(), page


def image_facts(images: DataFrame) -> DataFrame:
    """path, length, sha256, os_id, spans, digests (one a page) of every image: a hundredth of its bytes. Null contents count as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = _view(batch.column("content")[i])
                data = np.frombuffer(whole, np.uint8)
                known = len(data) in KINDS and data[0x503] == 1
                columns = [
                    batch.column("path").slice(i, 1), pa.array([len(data)], pa.int64()), pa.array([hashlib.sha256(whole).hexdigest()]), pa.array([_be(data, 0x504, 4) if known else None], pa.int64()),
                    pa.array([_spans(data) if known else None], pa.list_(_SPAN)), pa.array([[d for d, _ in _pages(whole)]], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "sha256", "os_id", "spans", "digests"])

    rest = "length long, sha256 string, os_id long, spans array<struct<name:string,start:bigint,length:bigint,cal_id:bigint>>, digests array<binary>"
    schema = T.StructType([images.schema["path"], *T.StructType.fromDDL(rest).fields])
    return images.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(work, schema)


def _place(digest: Column) -> Column:
    """Where a digest stands in the filter: its first four bytes."""
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % FILTER_BITS


def fetch_pages(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest, bytes of the pages in ``wanted`` (digest), each once.

    A bitmap of fixed size says on the side of the images which pages may be asked for, so the others' bytes don't leave
    their task, and a task sends a page once; what it lets through by chance ends in the join.
    """
    places = wanted.select((_place(F.col("digest")) + 1).alias("at")).select(F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in places.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():  # at most 4 MB
        bitmap[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = images.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sent = shared.value, set()
        for batch in batches:
            for content in batch.column("content"):
                found = {}
                for digest, page in _pages(_view(content)):
                    at = int.from_bytes(digest[:4], "big") % FILTER_BITS
                    if asked[at >> 3] >> (at & 7) & 1 and digest not in sent:
                        found[digest] = bytes(page)
                        sent.add(digest)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], names=["digest", "bytes"])
                if len(sent) > 200_000:  # a page sent twice does no harm
                    sent = set()

    likely = images.select(F.col("content").cast("binary").alias("content")).mapInArrow(work, "digest binary, bytes binary")
    return likely.join(wanted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("bytes").alias("bytes"))


def _page_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which bytes of two pages differ, one bit a byte, over the length of the shorter."""
    for batch in batches:
        bits = []
        for one, two in zip(batch.column("bytes_a"), batch.column("bytes_b"), strict=True):
            x, y = np.frombuffer(one.as_buffer(), np.uint8), np.frombuffer(two.as_buffer(), np.uint8)
            n = min(len(x), len(y))
            full = np.zeros(PAGE, bool)
            full[:n] = x[:n] != y[:n]
            bits.append(np.packbits(full).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("da"), batch.column("db"), pa.array(bits, pa.binary())], names=["da", "db", "bits"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differing bytes of a page, in all and in each region: differences of running counts at the region's ends."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            bits = np.frombuffer(b"".join(x.as_py() for x in part.column("bits")), np.uint8).reshape(-1, PAGE // 8)
            running = np.zeros((part.num_rows, PAGE + 1), np.int64)
            np.cumsum(np.unpackbits(bits, axis=1), axis=1, out=running[:, 1:])
            row, base = np.arange(part.num_rows), part.column("page").to_numpy() * PAGE
            counts = [running[:, -1]]
            for i in range(_REGIONS):
                start, end = (part.column(f"{side}{i}").fill_null(0).to_numpy() for side in ("from", "to"))
                counts.append(running[row, np.clip(end - base, 0, PAGE)] - running[row, np.clip(start - base, 0, PAGE)])
            names = ["total", *(f"n{i}" for i in range(_REGIONS))]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *map(pa.array, counts)], names=["a", "b", *names])


def compare_images(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Differing bytes of pairs (a, b: paths), in all and by region (only for equal sizes). A table of its own.

    a, b, sha_a, sha_b, os_a, os_b, total_changed, identical, size_mismatch, regions (name, changed, cal_id_a, cal_id_b).
    Pages are compared by digest, so of the contents only pages that differ are shuffled, each once, and two pages are
    compared once however many pairs hold them. Pairs of unknown paths give no row, repeated ones one row each; bytes that
    only the longer image has count as changed; null contents are empty. A path names one image.
    """
    facts = written(image_facts(images))
    of = lambda side: facts.select(F.col("path").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("length", "sha256", "os_id", "spans", "digests")))
    both = written(pairs.select("a", "b").groupBy("a", "b").agg(F.count("*").alias("times")).join(of("a"), "a").join(of("b"), "b"))
    # Pages of both, where their digests differ; those beyond the shorter image have no partner.
    zipped = F.transform(F.arrays_zip("digests_a", "digests_b"), lambda d, i: F.struct(i.cast("long").alias("page"), d["digests_a"].alias("da"), d["digests_b"].alias("db")))
    whole = (F.col("length_a") == F.col("length_b")) & F.col("spans_a").isNotNull()
    ends = [c for i in range(_REGIONS) for s in [F.when(whole, F.get("spans_a", F.lit(i)))] for c in (s["start"].alias(f"from{i}"), (s["start"] + s["length"]).alias(f"to{i}"))]
    changes = written(both.select("a", "b", *ends, F.explode(F.filter(zipped, lambda d: d["da"] != d["db"])).alias("d")).select("a", "b", "d.*", *(f"{side}{i}" for i in range(_REGIONS) for side in ("from", "to"))))
    wanted = changes.select(F.explode(F.array("da", "db")).alias("digest")).distinct()
    pages = written(fetch_pages(images, wanted))
    page = lambda side: pages.select(F.col("digest").alias(f"d{side}"), F.col("bytes").alias(f"bytes_{side}"))
    bits = changes.select("da", "db").distinct().join(page("a"), "da").join(page("b"), "db").mapInArrow(_page_differences, "da binary, db binary, bits binary")
    names = ["total", *(f"n{i}" for i in range(_REGIONS))]
    types = changes.schema
    counted = changes.join(bits, ["da", "db"]).drop("da", "db").mapInArrow(_counted, f"a {types['a'].dataType.simpleString()}, b {types['b'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))
    sums = counted.groupBy("a", "b").agg(*(F.sum(n).alias(n) for n in names))
    out = both.join(sums, ["a", "b"], "left")
    total = (F.coalesce("total", F.lit(0)) + F.abs(F.col("length_a") - F.col("length_b"))).cast("long")
    read = lambda side, i, field: F.get(f"spans_{side}", F.lit(i))[field]
    part = lambda i: F.named_struct(F.lit("name"), read("a", i, "name"), F.lit("changed"), F.coalesce(f"n{i}", F.lit(0)).cast("long"), F.lit("cal_id_a"), read("a", i, "cal_id"), F.lit("cal_id_b"), read("b", i, "cal_id"))
    parts = [F.when(read("a", i, "start").isNotNull(), part(i)) for i in range(_REGIONS)]
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull())
    result = out.select(
        "a", "b", F.col("sha256_a").alias("sha_a"), F.col("sha256_b").alias("sha_b"), F.col("os_id_a").alias("os_a"), F.col("os_id_b").alias("os_b"), total.alias("total_changed"), (total == 0).alias("identical"),
        (F.col("length_a") != F.col("length_b")).alias("size_mismatch"), F.when(whole, kept).alias("regions"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("once"),
    )
    result = written(result.drop("once"))
    dropped(facts, both, changes, pages)
    return result
