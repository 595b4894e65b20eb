"""Table definitions in XML, and the calibration cells that they point at in images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.functions.equations import evaluate
from dynofleet.functions.numbers import half_away

_EMBEDDED = "struct<_mmedaddress:string,_mmedtypeflags:string,_mmedelementsizebits:string,_mmedrowcount:string,_mmedcolcount:string,_mmedmajorstridebits:string,_mmedminorstridebits:string>"
_MATH = "struct<_equation:string>"
XDF = f"""XDFHEADER struct<deftitle:string,description:string,BASEOFFSET:struct<_offset:string,_subtract:string>,CATEGORY:array<struct<_index:string,_name:string>>>,
XDFTABLE array<struct<_uniqueid:string,title:string,description:string,CATEGORYMEM:array<struct<_category:string>>,
  XDFAXIS:array<struct<_id:string,EMBEDDEDDATA:{_EMBEDDED},indexcount:string,units:string,decimalpl:string,MATH:{_MATH},LABEL:array<struct<_index:string,_value:string>>>>>>,
XDFCONSTANT array<struct<_uniqueid:string,title:string,units:string,EMBEDDEDDATA:{_EMBEDDED},MATH:{_MATH}>>"""


def _int(c: Column) -> Column:
    """A decimal or 0x number of a text; null where it is none."""
    t = F.trim(c)
    return F.when(t.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("long")).otherwise(t.try_cast("long"))


def parse_definitions(files: DataFrame) -> DataFrame:
    """One row per definition file (os_id, text): the XML as a struct ``x``."""
    return files.select("os_id", F.from_xml("text", XDF, {"rowTag": "XDFFORMAT", "attributePrefix": "_"}).alias("x"))


def _address(raw: Column) -> Column:
    base = F.coalesce(_int(F.col("x.XDFHEADER.BASEOFFSET._offset")), F.lit(0))
    return F.when(F.coalesce(F.col("x.XDFHEADER.BASEOFFSET._subtract") == "1", F.lit(False)), raw - base).otherwise(raw + base)


def _cell_kind(data: str, math: str) -> list[Column]:
    flags = F.coalesce(_int(F.col(f"{data}._mmedtypeflags")), F.lit(0))
    bit = lambda n: flags.bitwiseAND(n) != 0
    return [
        _address(_int(F.col(f"{data}._mmedaddress"))).alias("address"),
        F.coalesce(_int(F.col(f"{data}._mmedelementsizebits")), F.lit(16)).cast("int").alias("bits"),
        bit(0x1).alias("signed"),
        bit(0x2).alias("lsb_first"),
        bit(0x4).alias("layout_ambiguous"),
        bit(0x10000).alias("floating"),
        F.coalesce(F.col(f"{math}._equation"), F.lit("")).alias("equation"),
    ]


def read_axes(parsed: DataFrame) -> DataFrame:
    """One row per axis (x, y, z) of every table."""
    tables = parsed.select("os_id", "x", F.posexplode("x.XDFTABLE").alias("table_no", "t"))
    names = F.map_from_entries(F.transform(F.coalesce("x.XDFHEADER.CATEGORY", F.array().cast("array<struct<_index:string,_name:string>>")), lambda c: F.struct(c["_index"], c["_name"])))
    member = lambda m: F.coalesce(F.try_element_at(names, (m["_category"].try_cast("int") - 1).cast("string")), m["_category"])
    axes = tables.select("os_id", "x", "table_no", "t", F.transform("t.CATEGORYMEM", member).alias("categories"), F.explode("t.XDFAXIS").alias("a"))
    d = "a.EMBEDDEDDATA"
    return axes.select(
        "os_id",
        F.col("t._uniqueid").alias("table_id"),
        F.trim("t.title").alias("title"),
        "table_no",
        "categories",
        F.lower("a._id").alias("axis"),
        *_cell_kind(d, "a.MATH"),
        _int(F.col(f"{d}._mmedrowcount")).alias("rows"),
        _int(F.col(f"{d}._mmedcolcount")).alias("cols"),
        (_int(F.col(f"{d}._mmedmajorstridebits")) / 8).cast("long").alias("major_stride"),
        (_int(F.col(f"{d}._mmedminorstridebits")) / 8).cast("long").alias("minor_stride"),
        _int(F.col("a.indexcount")).alias("index_count"),
        F.trim("a.units").alias("units"),
        F.coalesce(_int(F.col("a.decimalpl")), F.lit(2)).cast("int").alias("decimals"),
        F.filter(F.transform("a.LABEL", lambda v: v["_value"]), lambda v: v != "").alias("labels"),
    )


def read_constants(parsed: DataFrame) -> DataFrame:
    """One row per constant: os_id, id, title, units and how it is stored."""
    rows = parsed.select("os_id", "x", F.explode("x.XDFCONSTANT").alias("c"))
    return rows.select("os_id", F.col("c._uniqueid").alias("id"), F.trim("c.title").alias("title"), F.trim("c.units").alias("units"), *_cell_kind("c.EMBEDDEDDATA", "c.MATH"))


def _places(axes: DataFrame) -> DataFrame:
    """Every element that a definition points at: table, axis, r, c, byte offset and how to read it."""
    size = axes.groupBy("os_id", "table_id").agg(
        F.max(F.when(F.col("axis") == "z", F.col("rows"))).alias("zr"), F.max(F.when(F.col("axis") == "z", F.col("cols"))).alias("zc"),
        F.max(F.when(F.col("axis") == "y", F.col("index_count"))).alias("yi"), F.max(F.when(F.col("axis") == "x", F.col("index_count"))).alias("xi"),
    )
    one = F.lit(1).cast("long")
    size = size.select("os_id", "table_id", F.coalesce("zr", "yi", one).alias("n_rows"), F.coalesce("zc", "xi", one).alias("n_cols"))
    all_ = axes.join(size, ["os_id", "table_id"]).filter("address is not null")
    z, x = F.col("axis") == "z", F.col("axis") == "x"
    rows = F.when(z, F.col("n_rows")).when(x, one).otherwise(F.coalesce("index_count", "n_rows"))
    cols = F.when(z, F.col("n_cols")).when(x, F.coalesce("index_count", "n_cols")).otherwise(one)
    step = F.col("bits") / 8
    down = F.when(z, F.coalesce(F.nullif("major_stride", F.lit(0)), F.col("n_cols") * step)).otherwise(step)
    right = F.when(z, F.coalesce(F.nullif("minor_stride", F.lit(0)), step)).otherwise(step)
    grid = all_.withColumns({"down": down, "right": right, "nr": rows, "nc": cols}).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("r"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)).alias("c"))
    return grid.withColumn("offset", (F.col("address") + F.col("r") * F.col("down") + F.col("c") * F.col("right")).cast("long"))


def raw_value(content: Column, offset: Column, bits: Column, signed: Column, lsb_first: Column) -> Column:
    """The stored number at an offset; null outside of the image."""
    size = (bits / 8).cast("int")
    part = F.substr(content, (offset + 1).cast("int"), size)
    digits = F.hex(part)
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")
    value = F.conv(F.when(lsb_first, turned).otherwise(digits), 16, 10).cast("long")
    inside = (offset >= 0) & (offset + size <= F.octet_length(content))
    half, full = F.pow(F.lit(2.0), bits - 1).cast("long"), F.pow(F.lit(2.0), bits).cast("long")
    return F.when(inside, F.when(signed & (value >= half), value - full).otherwise(value))


def read_elements(images: DataFrame, axes: DataFrame) -> DataFrame:
    """image_id, os_id, table_id, axis, r, c, raw, value of every element. images: image_id, os_id, content.

    The image meets the list of its elements in one row, so its bytes are shuffled once, and a numpy
    gather reads and scales them. Floating cells are null. Equations go with the elements and run there, each over all
    of its elements at once, so plans don't grow with them.
    """
    out = T.StructType.fromDDL("image_id string, os_id long, table_id string, axis string, r long, c long, raw long, v double, decimals int")
    e = _places(axes)
    lists = e.groupBy("os_id").agg(F.collect_list(F.struct("table_id", "axis", "r", "c", "offset", "bits", "signed", "lsb_first", "floating", "equation", F.col("decimals").cast("int").alias("decimals"))).alias("elements"))
    joined = images.select(F.col("image_id").cast("string"), F.col("os_id").cast("long"), "content").join(lists, "os_id").select("image_id", "os_id", "content", "elements")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("content")[i].as_buffer(), np.uint8).astype(np.int64)
                els = batch.column("elements")[i].values
                get = lambda n, els=els: els.field(n).to_numpy(zero_copy_only=False)
                at, size, low = get("offset"), get("bits") // 8, get("lsb_first").astype(bool)
                good = (at >= 0) & (at + size <= len(data)) & ~get("floating").astype(bool)
                value = np.zeros(len(at), np.int64)
                for k in range(4):
                    use = good & (k < size)
                    value[use] = value[use] | data[at[use] + k] << np.where(low[use], 8 * k, 8 * (size[use] - 1 - k))
                bits = get("bits")
                value -= np.where(get("signed").astype(bool) & (value >= 1 << (bits - 1)), 1 << bits, 0)
                n = len(at)
                scaled, how = np.zeros(n), els.field("equation").dictionary_encode()
                which = how.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for k, text in [(-1, None), *enumerate(how.dictionary.to_pylist())]:
                    use = np.flatnonzero(good & (which == k))
                    scaled[use] = evaluate(text, value[use].astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("image_id")[i].as_py()] * n), pa.array([batch.column("os_id")[i].as_py()] * n, pa.int64()), els.field("table_id"), els.field("axis"), els.field("r"), els.field("c"), pa.array(value, mask=~good), pa.array(scaled, mask=~good), els.field("decimals")],
                    names=out.names,
                )

    raw = joined.mapInArrow(work, out)
    rounded = F.lit(None).cast("double")
    for d in range(7):
        rounded = F.when(F.col("decimals") == d, half_away(F.col("v"), d)).otherwise(rounded)
    return raw.select("image_id", "os_id", "table_id", "axis", "r", "c", "raw", F.coalesce(rounded, "v").alias("value"))


def read_cells(images: DataFrame, axes: DataFrame) -> DataFrame:
    """image_id, table_id, r, c, raw, value, x_label, y_label: cells with their axis values or static labels."""
    return labelled_cells(read_elements(images, axes), axes)


def labelled_cells(e: DataFrame, axes: DataFrame) -> DataFrame:
    """The same from the elements that ``read_elements`` gives; they are read three times."""
    z = e.filter("axis = 'z'").drop("axis")
    at = lambda axis, key: e.filter(F.col("axis") == axis).select("image_id", "table_id", F.col(key), F.col("value").cast("string").alias(f"{axis}_read"))
    static = lambda axis, key: axes.filter((F.col("axis") == axis) & (F.size("labels") > 0)).select("os_id", "table_id", F.posexplode("labels").alias("k", f"{axis}_text")).select("os_id", "table_id", F.col("k").cast("long").alias(key), f"{axis}_text")
    out = z.join(at("x", "c"), ["image_id", "table_id", "c"], "left").join(at("y", "r"), ["image_id", "table_id", "r"], "left")
    out = out.join(static("x", "c"), ["os_id", "table_id", "c"], "left").join(static("y", "r"), ["os_id", "table_id", "r"], "left")
    return out.select("image_id", "table_id", "r", "c", "raw", "value", F.coalesce("x_text", "x_read").alias("x_label"), F.coalesce("y_text", "y_read").alias("y_label"))


def cell_diff(cells: DataFrame, pairs: DataFrame, examples: int = 5) -> DataFrame:
    """a, b, table_id, cells, changed, max_delta, avg_delta, examples of image pairs (a, b).

    Null cells count as unchanged. max_delta is the signed one of the largest size, the first in row
    order among equals; examples are the first changed cells in row order.
    """
    side = lambda name, v: cells.select(F.col("image_id").alias(name), "table_id", "r", "c", F.col("value").alias(v), *(("x_label", "y_label") if name == "a" else ()))
    both = pairs.select("a", "b").join(side("a", "va"), "a").join(side("b", "vb"), ["b", "table_id", "r", "c"])
    moved = F.coalesce(F.col("va") != F.col("vb"), F.lit(False))
    both = both.withColumn("delta", F.when(moved, F.col("vb") - F.col("va")))
    w = Window.partitionBy("a", "b", "table_id").orderBy(F.when(moved, 0).otherwise(1), "r", "c")
    both = both.withColumn("k", F.row_number().over(w))
    first = F.when(moved & (F.col("k") <= examples), F.struct("k", "r", "c", F.coalesce("x_label", F.col("c").cast("string")).alias("x"), F.coalesce("y_label", F.col("r").cast("string")).alias("y"), F.col("va").alias("from"), F.col("vb").alias("to"), half_away(F.col("delta"), 4).alias("delta")))
    out = both.groupBy("a", "b", "table_id").agg(
        F.count("*").alias("cells"),
        F.count("delta").alias("changed"),
        F.max_by("delta", F.when(F.col("delta").isNotNull(), F.struct(F.abs("delta"), -F.col("r"), -F.col("c")))).alias("m"),
        (F.sum(F.col("delta").cast("decimal(18,6)")).cast("double") / F.count("delta")).alias("avg"),
        F.sort_array(F.collect_list(first)).alias("examples"),
    )
    return out.select("a", "b", "table_id", "cells", "changed", F.coalesce(half_away(F.col("m"), 4), F.lit(0.0)).alias("max_delta"), F.coalesce(half_away(F.col("avg"), 4), F.lit(0.0)).alias("avg_delta"), "examples")


def top_changed_tables(diff: DataFrame, most: int = 200) -> DataFrame:
    """The tables of a pair with most changed cells."""
    w = Window.partitionBy("a", "b").orderBy(F.desc("changed"), "table_id")
    return diff.filter("changed > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def definition_match(images: DataFrame, definitions: DataFrame) -> DataFrame:
    """Images with the definition of their system: the last name in order."""
    best = definitions.groupBy("os_id").agg(F.max("name").alias("definition"))
    return images.join(best, "os_id", "left")
