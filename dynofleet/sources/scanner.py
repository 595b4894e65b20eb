"""Scanner configuration files in XML, the channel dictionary they give, and decoded expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LABELLED = "struct<Label:string,ParameterID:string,Unit:string,Decimals:string,Maximum:string,HighValue:string,MiddleValue:string,LowValue:string,ColumnParameterID:string,ColumnUnit:string>"
_USER = "struct<_DeviceManufacturer:string,_DeviceName:string,_CANBus:string,_ParameterOffset:string,_ParameterSize:string,_dataType:string,_scalingPerBit:string,_unit:string>"
# Root element -> kind, with the part of it that is read.
KINDS = {
    "channels": ("Channels", f"Channel array<struct<_ParameterID:string,_Interval:string,_TransformID:string,_Address:string,UserParameter:{_USER}>>"),
    "charts": ("Charts", f"Chart array<struct<Series:array<{_LABELLED}>>>"),
    "graphs": ("Graphs", f"Table array<{_LABELLED}>"),
    "layout": ("DocumentContents", f"Content array<struct<_ID:string,_Name:string,_Text:string,Table:array<{_LABELLED}>,Chart:array<struct<Series:array<{_LABELLED}>>>,Series:array<{_LABELLED}>>>"),
    "math": ("MathParameter", "_Name string, _Abbreviation string, _Notes string, _Expression string, _Unit string, _Decimals string"),
}
REFERENCE = r"\[(\d+)(?:\.(\d+))?\]"


def file_kind(name: Column, text: Column) -> Column:
    """channels, charts, graphs, layout or math, by the root element, else by the file name; null for others."""
    root = F.lower(F.regexp_extract(text, r"<([A-Za-z]+)[\s>]", 1))
    by_root = F.try_element_at(F.create_map(*(F.lit(x) for k, (r, _) in KINDS.items() for x in (r.lower(), k))), root)
    f = F.lower(name)
    by_name = F.lit(None).cast("string")
    for mark, kind in reversed([(".channels", "channels"), (".charts", "charts"), (".graphs", "graphs"), (".layout", "layout"), (".mathparameter", "math")]):
        by_name = F.when(f.contains(mark), kind).otherwise(by_name)
    return F.coalesce(by_root, by_name)


def interval_ms(text: Column) -> Column:
    """HH:MM:SS.f as milliseconds."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    return F.floor((part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + 0.5).cast("long")


def read_scanner(files: DataFrame) -> DataFrame:
    """name, kind, channels, entries, math, charts, series, tables, panes: one row a scanner file, of whatever kind, in one scan.

    files: name, text. Every file is parsed once, by its own kind; lists that a kind doesn't have are empty, counts 0, math null.
    Files of no kind give no row; what can't be parsed, or is null, counts as empty.
    """
    kind = F.col("kind")
    one = files.select("name", "text", file_kind(F.col("name"), F.col("text")).alias("kind")).filter("kind is not null")
    own = {k: F.from_xml(F.when(kind == k, F.col("text")), schema, {"rowTag": root, "attributePrefix": "_"}).alias(k) for k, (root, schema) in KINDS.items()}
    x = one.select("name", "kind", *own.values())
    empty = F.array().cast(f"array<{_LABELLED}>")
    # A chart without a series is an empty list: null would take the series of all others with it.
    series = lambda charts: F.coalesce(F.flatten(F.transform(charts, lambda c: F.coalesce(c["Series"], empty))), empty)
    panes = F.transform("layout.Content", lambda c: F.concat(F.coalesce(c["Table"], empty), series(c["Chart"]), F.coalesce(c["Series"], empty)))
    entries = F.coalesce(F.when(kind == "charts", series(F.col("charts.Chart"))).when(kind == "graphs", F.col("graphs.Table")).when(kind == "layout", F.flatten(panes)), empty)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    total = lambda f: F.aggregate(F.coalesce(F.transform("layout.Content", f), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, k: n + k)
    return x.select(
        "name", "kind", F.coalesce("channels.Channel", F.array().cast("array<struct<_ParameterID:string,_Interval:string,_TransformID:string,_Address:string,UserParameter:" + _USER + ">>")).alias("channels"),
        entries.alias("entries"), "math",
        size("charts.Chart").alias("charts"),
        F.when(kind == "layout", total(lambda c: size(series(c["Chart"])) + size(c["Series"]))).otherwise(size(series(F.col("charts.Chart")))).alias("series"),
        F.when(kind == "layout", total(lambda c: size(c["Table"]))).otherwise(size("graphs.Table")).alias("tables"),
        size("layout.Content").alias("panes"),
    )


def read_channels(files: DataFrame) -> DataFrame:
    """name, parameter_id, interval_ms, transform_id, address, user_device of every listed channel. files: name, text."""
    return channels_of(read_scanner(files))


def channels_of(scanned: DataFrame) -> DataFrame:
    """The channels in what ``read_scanner`` gives."""
    rows = scanned.select("name", F.posexplode("channels").alias("ordinal", "c"))
    return rows.select("name", "ordinal", F.col("c._ParameterID").alias("parameter_id"), interval_ms(F.col("c._Interval")).alias("interval_ms"), F.col("c._TransformID").alias("transform_id"), F.col("c._Address").alias("address"), F.col("c.UserParameter").alias("user_device"))


def rate_summary(channels: DataFrame) -> DataFrame:
    """Channels by logging interval of every file."""
    return channels.filter("interval_ms is not null").groupBy("name", "interval_ms").agg(F.count("*").alias("channels"))


def labelled_entries(files: DataFrame) -> DataFrame:
    """source, seq, parameter_id, label, unit_id, decimals, maximum, high, middle, low, column_parameter_id, column_unit_id
    of everything that charts, graphs and layouts label."""
    return entries_of(read_scanner(files))


def entries_of(scanned: DataFrame) -> DataFrame:
    """The labelled entries in what ``read_scanner`` gives."""
    rows = scanned.select("name", F.posexplode("entries").alias("seq", "e"))
    own = lambda c: F.nullif(F.trim(F.col(f"e.{c}")), F.lit(""))
    number = lambda c: own(c).try_cast("double")
    limits = [number(c).alias(n) for c, n in (("Maximum", "maximum"), ("HighValue", "high"), ("MiddleValue", "middle"), ("LowValue", "low"))]
    return rows.select(
        F.col("name").alias("source"), "seq", F.trim("e.ParameterID").alias("parameter_id"), F.trim("e.Label").alias("label"), own("Unit").alias("unit_id"),
        own("Decimals").try_cast("int").alias("decimals"), *limits, own("ColumnParameterID").alias("column_parameter_id"), own("ColumnUnit").alias("column_unit_id"),
    )


def config_counts(files: DataFrame) -> DataFrame:
    """name, kind, charts, series, tables, panes of every file of charts, graphs or a layout."""
    return read_scanner(files).filter("kind in ('charts', 'graphs', 'layout')").select("name", "kind", "charts", "series", "tables", "panes")


def read_math(files: DataFrame) -> DataFrame:
    """name, title, expression, unit_id of math parameters; line breaks of an expression are blanks."""
    return math_of(read_scanner(files))


def math_of(scanned: DataFrame) -> DataFrame:
    """The math parameters in what ``read_scanner`` gives."""
    m = scanned.filter("kind = 'math'")
    return m.select("name", F.col("math._Name").alias("title"), F.trim(F.regexp_replace(F.coalesce("math._Expression", F.lit("")), r"\r?\n+", " ")).alias("expression"), F.col("math._Unit").alias("unit_id"))


def build_dictionary(entries: DataFrame) -> DataFrame:
    """parameter_id, label, unit_ids, sources: the longest label (the first among equals), units and sources as first seen.

    entries: source, seq, parameter_id, label, unit_id; the order is that of source, then seq.
    Entries without id or label don't count.
    """
    seen = entries.filter("parameter_id <> '' and label <> ''")
    place = F.struct("source", "seq")
    # The longest label, then the smallest place: place is turned into a rank first, as max_by takes the largest.
    best = F.min_by("label", F.struct((-F.char_length("label")).alias("n"), place.alias("at")))
    in_order = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("source", "seq", F.col(c).alias("v"))))), lambda s: s["v"]))
    out = seen.withColumn("src", F.col("source")).groupBy("parameter_id")
    return out.agg(best.alias("label"), in_order("unit_id").alias("unit_ids"), in_order("src").alias("sources"))


def dictionary_override(generated: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual entries (parameter_id, label) replace generated ones and add their own."""
    both = generated.join(manual.select("parameter_id", F.col("label").alias("manual")), "parameter_id", "full")
    return both.select("parameter_id", F.coalesce("manual", "label").alias("label"), "unit_ids", "sources", F.col("manual").isNotNull().alias("is_manual"))


def decode_channels(channels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Channels with their label, and whether they are known."""
    out = channels.join(dictionary.select("parameter_id", "label"), "parameter_id", "left")
    return out.withColumn("known", F.col("label").isNotNull())


def math_references(math: DataFrame) -> DataFrame:
    """name, parameter_id: distinct ids that an expression refers to."""
    ids = F.array_distinct(F.regexp_extract_all("expression", F.lit(REFERENCE), F.lit(1)))
    return math.select("name", F.explode(ids).alias("parameter_id"))


def decode_expression(math: DataFrame, dictionary: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """name, decoded, unknown: known references as [label] or [label unit], others as they are.

    The unit is only told where it is known, is no question mark, and isn't a word of the label.
    units: unit_id, symbol.
    """
    tokens = math.select("name", "expression", F.explode_outer(F.array_distinct(F.regexp_extract_all("expression", F.lit(REFERENCE), F.lit(0)))).alias("token"))
    tokens = tokens.select("*", F.regexp_extract("token", REFERENCE, 1).alias("parameter_id"), F.regexp_extract("token", REFERENCE, 2).alias("unit_id"))
    named = tokens.join(dictionary.select("parameter_id", "label"), "parameter_id", "left")
    named = named.join(units, "unit_id", "left") if units is not None else named.withColumn("symbol", F.lit(None).cast("string"))
    word = F.concat(F.lit(r"(?i)\b\Q"), F.col("symbol"), F.lit(r"\E\b"))
    useful = F.col("symbol").isNotNull() & (F.col("symbol") != "?") & ~F.rlike(F.col("label"), word)
    text = F.concat(F.lit("["), F.trim("label"), F.when(useful, F.concat(F.lit(" "), F.col("symbol"))).otherwise(""), F.lit("]"))
    lists = named.groupBy("name", "expression").agg(
        F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("token", text.alias("text"))))).alias("swaps"),
        F.sort_array(F.collect_set(F.when(F.col("label").isNull() & F.col("token").isNotNull(), F.col("parameter_id")))).alias("unknown"),
    )
    return lists.select("name", F.aggregate("swaps", F.col("expression"), lambda acc, s: F.replace(acc, s["token"], s["text"])).alias("decoded"), "unknown")
