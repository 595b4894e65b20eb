"""Redaction of log text: vehicle numbers, notes, location columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dynofleet.sources import splits
from dynofleet.sources.files import listed_files
from dynofleet.sources.logs import channels_of, log_lines, parse_logs
from dynofleet.sources.tables import dropped

# A vehicle number (17 characters of its alphabet, a digit and a letter among them), the
# notes line, and channels that tell a place.
VIN = r"\b(?=[A-HJ-NPR-Z0-9]{17}\b)(?=[^\s]*\d)(?=[^\s]*[A-HJ-NPR-Z])[A-HJ-NPR-Z0-9]{17}\b"
NOTES = r"(?m)^(\s*Notes:)[ \t]*\S.*$"
PLACES = r"(?i)\b(gps|latitude|longitude|\blat\b|\blon\b|\blng\b|altitude|geo)\b"


def scrub_vins(text: Column) -> Column:
    """Vehicle numbers replaced by <VIN>."""
    return F.regexp_replace(text, VIN, "<VIN>")


def vins_in(text: Column) -> Column:
    """Distinct vehicle numbers of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(VIN), F.lit(0)))


def scrub_notes(text: Column) -> Column:
    """The free text behind ``Notes:`` blanked; the line stays."""
    return F.regexp_replace(text, NOTES, "$1")


def location_columns(channels: DataFrame) -> DataFrame:
    """log_id, width (columns of the log), drop (ordinals that tell a place) of logs that have any."""
    at = F.when(F.col("header").rlike(PLACES), F.col("ordinal"))
    return channels.groupBy("log_id").agg(F.count("*").alias("width"), F.collect_list(at).alias("drop")).filter(F.size("drop") > 0)


def without_places(line: Column) -> Column:
    """A line without its log's place columns (``width``, ``drop``); it is only cut if it has as many fields as the log has columns."""
    fields = F.split(line, ",")
    kept = F.array_join(F.filter(fields, lambda c, i: ~F.array_contains(F.col("drop"), i)), ",")
    return F.when(F.size(fields) == F.col("width"), kept).otherwise(line)


def scrub_location(lines: DataFrame, channels: DataFrame) -> DataFrame:
    """Lines with place columns taken out."""
    cut = lines.join(location_columns(channels), "log_id", "left")
    rest = [c for c in lines.columns if c not in ("log_id", "line_no", "line")]
    return cut.select("log_id", "line_no", without_places(F.col("line")).alias("line"), *rest)


def cleaned(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", scrub_notes(scrub_vins(F.col("line"))))


def scrub_lines(lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The lines of logs (log_id, line_no, line, and others) with everything redacted, one by one: no log is held whole.

    Vehicle numbers and notes never cross a line. ``heads``: as for ``logs.parse_lines``, so that channels come from them alone.
    """
    return scrub_location(cleaned(lines), channels_of(lines if heads is None else heads))


def scrub_logs(logs: DataFrame) -> DataFrame:
    """log_id, text: logs (log_id, text) with everything redacted and otherwise unchanged, line order kept."""
    lines = logs.select("log_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return scrub_lines(lines, log_lines(logs)).groupBy("log_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def write_scrubbed(spark: SparkSession, source: str, target: str, part_bytes: int = splits.PART) -> None:
    """Every log file under ``source`` redacted into the same place under ``target``, byte for byte the same elsewhere."""
    listed = listed_files(spark, source)
    heads = splits.read_heads(spark, source, listed)
    splits.rewrite_logs(listed, source, target, lambda lines: cleaned(lines).withColumn("line", without_places(F.col("line"))), location_columns(channels_of(heads)), part_bytes)
    dropped(listed, heads)


def scrub_check(logs: DataFrame) -> DataFrame:
    """log_id, vins, notes, places: what is left to redact in a log, and ``clean``."""
    channels, _ = parse_logs(logs)
    places = channels.groupBy("log_id").agg(F.count_if(F.col("header").rlike(PLACES)).alias("places"))
    text = logs.select("log_id", F.size(vins_in(F.col("text"))).alias("vins"), F.size(F.regexp_extract_all("text", F.lit(NOTES), F.lit(0))).alias("notes"))
    out = text.join(places, "log_id", "left").select("log_id", "vins", "notes", F.coalesce("places", F.lit(0)).alias("places"))
    return out.withColumn("clean", (F.col("vins") == 0) & (F.col("notes") == 0) & (F.col("places") == 0))


