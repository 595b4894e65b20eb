"""A vehicle's history: one timeline of what happened, its gaps, and checks on files.

files: vehicle, kind (stock, tune, datalog, session), name. flashes: vehicle, date, rev, adapter, notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.sources.files import date_in, flash_detail, log_revision_of, revision_of

VIN_FORM = "^[A-HJ-NPR-Z0-9]{17}$"


def parse_names(files: DataFrame) -> DataFrame:
    """Adds date and rev, as the file names state them."""
    rev = F.when(F.col("kind") == "tune", revision_of(F.col("name"))).when(F.col("kind") == "datalog", log_revision_of(F.col("name")))
    return files.withColumns({"date": date_in(F.col("name")), "rev": rev})


def timeline(files: DataFrame, flashes: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """vehicle, date, type, rev, title, detail, seq: newest first in each vehicle.

    The files of one revision are one event. Equal dates keep the order of kinds, then of names.
    ``goals``: vehicle, name, goal of sessions.
    """
    named = parse_names(files)
    none = F.lit(None).cast("string")
    base = named.filter("kind = 'stock'").select("vehicle", "date", F.lit("baseline").alias("type"), none.alias("rev"), F.lit("Baseline archived").alias("title"), F.col("name").alias("detail"), "name")
    revs = named.filter("kind = 'tune' and rev is not null").groupBy("vehicle", "rev").agg(F.sort_array(F.collect_list("name")).alias("names"), F.min_by("date", "name").alias("date"))
    rev = revs.select("vehicle", "date", F.lit("revision").alias("type"), "rev", F.concat("rev", F.lit(" checked in")).alias("title"), F.array_join("names", ", ").alias("detail"), F.get("names", F.lit(0)).alias("name"))
    logs = named.filter("kind = 'datalog'").select("vehicle", "date", F.lit("datalog").alias("type"), "rev", F.lit("Datalog captured").alias("title"), F.col("name").alias("detail"), "name")
    sessions = named.filter("kind = 'session'")
    sessions = sessions.join(goals, ["vehicle", "name"], "left") if goals is not None else sessions.withColumn("goal", none)
    sess = sessions.select("vehicle", "date", F.lit("session").alias("type"), none.alias("rev"), F.lit("Session logged").alias("title"), F.coalesce("goal", "name").alias("detail"), "name")
    flash = flashes.select("vehicle", "date", F.lit("flash").alias("type"), "rev", F.concat(F.lit("Flashed "), "rev").alias("title"), flash_detail(F.col("adapter"), F.col("notes")).alias("detail"), F.concat_ws("|", "date", "rev", "adapter", "notes").alias("name"))
    out = base.unionByName(rev).unionByName(logs).unionByName(sess).unionByName(flash)
    order = F.array_position(F.array(*map(F.lit, ("baseline", "revision", "datalog", "session", "flash"))), F.col("type"))
    w = Window.partitionBy("vehicle").orderBy(F.desc("date"), order, "name")
    return out.withColumn("seq", F.row_number().over(w)).drop("name")


def timeline_counts(events: DataFrame) -> DataFrame:
    """vehicle, a count per type, and the revisions that were flashed."""
    kinds = [F.count_if(F.col("type") == k).alias(k) for k in ("baseline", "revision", "datalog", "session", "flash")]
    return events.groupBy("vehicle").agg(*kinds, F.sort_array(F.collect_set(F.when(F.col("type") == "flash", F.col("rev")))).alias("flashed"))


def revisions_never_flashed(revisions: DataFrame, flashes: DataFrame) -> DataFrame:
    """Checked-in revisions (vehicle, rev) that no flash names."""
    return revisions.select("vehicle", "rev").filter("rev is not null").distinct().join(flashes.select("vehicle", "rev"), ["vehicle", "rev"], "left_anti")


def revisions_without_logs(revisions: DataFrame, logs: DataFrame) -> DataFrame:
    """Checked-in revisions that no datalog names."""
    return revisions.select("vehicle", "rev").filter("rev is not null").distinct().join(logs.select("vehicle", "rev"), ["vehicle", "rev"], "left_anti")


def orphan_log_revs(revisions: DataFrame, logs: DataFrame) -> DataFrame:
    """Revisions that datalogs name and nobody checked in."""
    return logs.select("vehicle", "rev").filter("rev is not null").distinct().join(revisions.select("vehicle", "rev"), ["vehicle", "rev"], "left_anti")


def next_revision(revisions: DataFrame) -> DataFrame:
    """vehicle, next: v and the highest number so far plus one, in three digits or more."""
    n = F.regexp_extract("rev", r"^v(\d{3})", 1).try_cast("int")
    return revisions.groupBy("vehicle").agg(F.format_string("v%03d", F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


def duplicate_images(images: DataFrame) -> DataFrame:
    """vehicle, sha256, names of equal files of a vehicle. Ships digests, not contents: images has sha256."""
    return images.groupBy("vehicle", "sha256").agg(F.sort_array(F.collect_list("name")).alias("names")).filter(F.size("names") > 1)


def vin_check(images: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds verdict: match, mismatch, or unknown where either number isn't a vehicle number."""
    both = images.join(profiles.select("vehicle", F.col("vin").alias("expected")), "vehicle", "left")
    good = lambda c: F.coalesce(F.col(c).rlike(VIN_FORM), F.lit(False))
    return both.withColumn("verdict", F.when(~good("vin") | ~good("expected"), "unknown").when(F.col("vin") == F.col("expected"), "match").otherwise("mismatch"))
