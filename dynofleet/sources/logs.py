"""Datalog text files: plain (one header row) and sectioned (preamble, then sparse rows).

The order of a log is its line order: ``read_text_logs`` reads files whole, ``sources.splits`` in ranges with line numbers. Result: ``log_channel`` (log_id, ordinal,
parameter_id, name, unit_text, header, format) and ``log_sample`` (log_id, row_no, ordinal,
value_num, value_str), both long, so any list of channels fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dynofleet.operators import ranges
from dynofleet.sources.tables import written

# What marks a sectioned file, and its sections.
SECTIONED = r"(?i)^HP Tuners CSV Log File"
INFO, DATA = "[Channel Information]", "[Channel Data]"
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def is_sectioned(first_line: str) -> bool:
    return re.match(SECTIONED, first_line) is not None


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_id (file path) and text of every file under ``path``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log_id"), F.col("value").alias("text"))


def log_lines(logs: DataFrame) -> DataFrame:
    """log_id, line_no (from 0), line."""
    return logs.select("log_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "line"))


def split_fields(line: Column) -> Column:
    """Fields between commas, trimmed, one quote taken off each end; quoted commas are not known."""
    return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def number_of(cell: Column) -> Column:
    """The number that a cell begins with, else null."""
    return F.regexp_extract(cell, NUMBER, 1).try_cast("double")


def rejoin_names(fields: Column, width: Column) -> Column:
    """Fields of a names row that is wider than the data: joined again while brackets are open, the rest folded into the last."""
    depth = lambda s: F.length(s) - F.length(F.regexp_replace(s, r"[(\[]", "")) - F.length(s) + F.length(F.regexp_replace(s, r"[)\]]", ""))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, f: Column) -> Column:
        text = F.when(acc["open"].isNull(), f).otherwise(F.concat(acc["open"], F.lit(","), f))
        level = acc["depth"] + depth(f)
        done = level <= 0
        return F.struct(
            F.when(done, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"),
            F.when(done, F.lit(None).cast("string")).otherwise(text).alias("open"),
            F.when(done, 0).otherwise(level).alias("depth"),
        )

    joined = F.aggregate(fields, start, step, lambda acc: F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["open"]))))
    folded = F.concat(F.slice(joined, 1, width - 1), F.array(F.array_join(F.slice(joined, width, F.size(joined)), ",")))
    return F.when((width < 1) | (F.size(fields) <= width), fields).otherwise(F.when(F.size(joined) > width, folded).otherwise(joined))


def merge_units(name: Column, unit: Column) -> Column:
    """``name [unit]``, unless there is no unit or the name holds a bracket already."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    return F.when((u != "") & ~name.contains("["), F.concat(name, F.lit(" ["), u, F.lit("]"))).otherwise(name)


def _frames(lines: DataFrame) -> DataFrame:
    """One row per log: format, names, units, ids, and ``begin``, the last line before its data."""
    text = F.trim("line")
    marks = lines.groupBy("log_id").agg(
        F.min(F.when(text == DATA, F.col("line_no"))).alias("data"),
        F.min(F.when(text == INFO, F.col("line_no"))).alias("info"),
        F.bool_or(((F.col("line_no") == 0) & text.rlike(SECTIONED)) | ((F.col("line_no") < 40) & (text == DATA))).alias("sectioned"),
    )
    near = lines.join(marks, "log_id").filter(text != "")
    block = near.filter("sectioned and line_no > coalesce(info, -1) and line_no < data")
    rows = lambda df, n: df.groupBy("log_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias(n))
    first = near.filter("sectioned and line_no > data").filter(~text.startswith("[")).groupBy("log_id").agg(F.min_by("line", "line_no").alias("first"))
    head = rows(block, "block").join(first, "log_id", "left")
    b = F.transform(F.slice(F.reverse("block"), 1, 3), split_fields)  # from the last row up
    n = F.size("block")
    ids, names, units = F.when(n >= 3, F.get(b, F.lit(2))), F.when(n == 1, F.get(b, F.lit(0))).otherwise(F.get(b, F.lit(1))), F.when(n >= 2, F.get(b, F.lit(0)))
    shifted = ids.isNotNull() & F.exists(ids, lambda v: ~v.rlike(r"^\d*$"))  # no ids row: names and units stand one row higher
    sect = head.select(
        "log_id",
        F.lit("sectioned").alias("format"),
        F.when(shifted, F.lit(None)).otherwise(ids).alias("ids"),
        F.when(shifted, ids).otherwise(names).alias("names"),
        F.when(shifted, names).otherwise(units).alias("units"),
        "first",
        F.lit(None).cast("long").alias("begin"),
    )
    width = F.coalesce(F.size(split_fields(F.col("first"))), F.size("ids"), F.size("units"), F.lit(0))
    sect = sect.withColumn("names", rejoin_names(F.col("names"), F.when(F.col("first").isNull(), F.coalesce(F.size("ids"), F.size("units"), F.lit(0))).otherwise(width))).drop("first")
    w = Window.partitionBy("log_id").orderBy("line_no")
    top = near.filter("not sectioned").withColumn("k", F.row_number().over(w)).filter("k <= 2")
    top = top.groupBy("log_id").agg(F.max(F.when(F.col("k") == 1, F.col("line"))).alias("h"), F.max(F.when(F.col("k") == 2, F.col("line"))).alias("u"), F.min("line_no").alias("at"), F.max("line_no").alias("units_at"))
    second = split_fields(F.col("u"))
    units_row = F.size(F.filter(second, lambda c: number_of(c).isNotNull())) <= F.size(second) / 2
    plain = top.filter("u is not null").select("log_id", F.lit("plain").alias("format"), F.lit(None).cast("array<string>").alias("ids"), split_fields(F.col("h")).alias("names"), F.when(units_row, second).alias("units"), F.when(units_row, F.col("units_at")).otherwise(F.col("at")).cast("long").alias("begin"))
    both = marks.join(sect.unionByName(plain), "log_id")
    return both.withColumn("begin", F.coalesce("begin", "data"))


def parse_logs(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log_channel, log_sample) of text logs (log_id, text), each held whole in one row."""
    return parse_lines(log_lines(logs))


def parse_lines(lines: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(log_channel, log_sample) of the lines of logs (log_id, line_no from 0, line), so that no log is held whole.

    ``heads``: the first lines of every log, at least up to its first data line; without them all lines are searched for
    what they say. Logs without data rows have no samples. Blank cells of sectioned logs are null; a cell that is no number is kept as text.
    """
    channels, rows = parse_rows(lines, heads)
    return channels, cells_of(rows)


def channels_of(heads: DataFrame) -> DataFrame:
    """log_channel of the first lines of every log (log_id, line_no, line), at least up to its first data line; samples are not read."""
    return _channels(_frames(heads))


def _channels(frames: DataFrame) -> DataFrame:
    named = frames.select("log_id", "format", "ids", "units", F.posexplode("names").alias("ordinal", "name"))
    unit = F.get("units", F.col("ordinal"))
    header = F.when(F.col("format") == "sectioned", merge_units(F.col("name"), unit)).otherwise(F.col("name"))
    return named.select("log_id", "ordinal", F.get("ids", F.col("ordinal")).alias("parameter_id"), "name", unit.alias("unit_text"), header.alias("header"), "format")


def parse_rows(lines: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same with one row a data line: log_id, row_no, values, words (by ordinal), filled (cells that hold either)."""
    frames = _frames(lines if heads is None else heads)
    channels = _channels(frames)
    begin = written(frames.select("log_id", (F.col("format") == "sectioned").alias("sectioned"), F.col("begin").cast("long").alias("begin")))  # one row a log, joined to all lines
    body = lines.join(begin, "log_id").filter((F.trim("line") != "") & (F.col("line_no") > F.col("begin")))
    data = body.filter(~F.col("sectioned") | ~F.trim("line").startswith("["))
    # Data lines that follow each other are numbered by their line; only logs with other lines between them need a window.
    found = data.groupBy("log_id").agg(F.count("*").alias("n"), (F.max("line_no") - F.first("begin")).alias("last"))
    broken = written(found.filter("n <> last").select("log_id"))
    columns = ["log_id", "row_no", "sectioned", "line"]
    by_line = lambda df: df.withColumn("row_no", (F.col("line_no") - F.col("begin")).cast("long")).select(columns)
    if broken.isEmpty():
        rows = by_line(data)
    else:
        counted = ranges.numbered(data.join(broken, "log_id", "left_semi").select("log_id", "line_no", "sectioned", "line"), "row_no")
        rows = by_line(data.join(broken, "log_id", "left_anti")).union(counted.select(columns))
    schema = T.StructType([rows.schema["log_id"], rows.schema["row_no"], *T.StructType.fromDDL("values array<double>, words array<string>, filled int").fields])
    return channels, rows.mapInArrow(_read_cells, schema)


def cells_of(rows: DataFrame) -> DataFrame:
    """log_sample of what ``parse_rows`` gives."""
    cells = rows.select("log_id", "row_no", F.posexplode(F.arrays_zip("values", "words")).alias("ordinal", "c"))
    return cells.select("log_id", "row_no", "ordinal", F.col("c.values").alias("value_num"), F.col("c.words").alias("value_str"))


# Numbers that Arrow casts as they stand; a quote at an end of a cell, which may have a line break behind it.
_SIMPLE = r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$"
_QUOTE = re.compile('^"|"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\\Z)')
_NUMBER = re.compile(NUMBER, re.ASCII)


def _numbers(cells: pa.Array) -> pa.Array:
    """``number_of`` for a column of cells; what isn't written simply is read one distinct cell at a time."""
    simple = pc.match_substring_regex(cells, _SIMPLE)
    values = pc.cast(pc.if_else(simple, cells, None), pa.float64())
    odd = pc.filter(cells, pc.and_(pc.invert(simple), pc.not_equal(cells, ""))).unique()
    found = [(c, float(m[1])) for c in odd.to_pylist() if (m := _NUMBER.match(c))]
    if not found:
        return values
    at = pc.index_in(cells, pa.array([c for c, _ in found], pa.string()))
    return pc.coalesce(values, pc.take(pa.array([v for _, v in found], pa.float64()), at))


def _read_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields between commas, trimmed and without quotes (``split_fields``), as numbers and words."""
    for batch in batches:
        fields = pc.split_pattern(batch.column("line").cast(pa.string()), ",")
        cells = pc.utf8_trim(fields.flatten(), " ")
        quoted = pc.match_substring(cells, '"')
        if pc.any(quoted).as_py():
            known = pc.filter(cells, quoted).unique()
            at = pc.index_in(cells, known)
            cells = pc.coalesce(pc.take(pa.array([_QUOTE.sub("", c) for c in known.to_pylist()], pa.string()), at), cells)
        values = _numbers(cells)
        sizes = pc.list_value_length(fields)
        blank = pc.and_(pc.take(batch.column("sectioned"), pc.list_parent_indices(fields)), pc.equal(cells, ""))
        words = pc.if_else(pc.or_(pc.is_valid(values), blank), pa.scalar(None, pa.string()), cells)
        offsets = np.concatenate(([0], np.cumsum(sizes.to_numpy()))).astype(np.int32)
        running = np.concatenate(([0], np.cumsum(pc.or_(pc.is_valid(values), pc.is_valid(words)).to_numpy(zero_copy_only=False))))
        filled = pa.array((running[offsets[1:]] - running[offsets[:-1]]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (values, words)]
        yield pa.RecordBatch.from_arrays([batch.column("log_id"), batch.column("row_no"), *lists, filled], names=["log_id", "row_no", "values", "words", "filled"])


def to_timed(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """Long samples with a time for ``operators.align``: log_id, row_no, t, channel (ordinal as text), value."""
    at = channels.filter(F.col("header").rlike("(?i)^(offset|time)")).groupBy("log_id").agg(F.min("ordinal").alias("time_at"))
    timed = samples.join(at, "log_id")
    t = timed.filter("ordinal = time_at").select("log_id", "row_no", F.col("value_num").alias("t"))
    return timed.filter("ordinal <> time_at and value_num is not null").join(t, ["log_id", "row_no"], "left").select("log_id", "row_no", "t", F.col("ordinal").cast("string").alias("channel"), F.col("value_num").alias("value"))
