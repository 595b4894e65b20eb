"""Summaries for people: channels of a log, and what a submitted log holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.functions.numbers import exact_mean, half_away
from dynofleet.functions.units import convert, detect_unit, quantity_of
from dynofleet.operators.analysis import Analysis


def channel_summary(samples: DataFrame, places: int = 4) -> DataFrame:
    """log_id, channel, n, lo, hi, mean of the numbers of every channel."""
    v = F.col("value")
    return samples.groupBy("log_id", "channel").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), half_away(exact_mean(v), places).alias("mean"))


def write_readings(readings: dict[str, DataFrame], path: str, by: str = "log_date") -> None:
    """One Parquet table per reading under ``path``, partitioned by ``by`` where a reading has it: only its own partitions are replaced."""
    for name, df in readings.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(by) if by in df.columns else writer).parquet(f"{path}/{name}")


def log_summary(channels: DataFrame, samples: DataFrame, preferences: dict[str, str] | None = None, first: int = 40) -> DataFrame:
    """log_id, ordinal, header, n, unit, native_unit, converted, lo, hi, mean, non_numeric, rows, duration.

    The first ``first`` channels of every log, in the preferred unit of their quantity where they state one that can be
    converted (to 3 places then). rows: log rows with a sample; duration: seconds that the first time channel spans.
    """
    w = Window.partitionBy("log_id").orderBy("ordinal")
    named = channels.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= first).select("log_id", "ordinal", "header")
    v = F.col("value_num")
    stats = samples.groupBy("log_id", "ordinal").agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), exact_mean(v).alias("mean"))
    native = detect_unit(F.col("header"))
    preferred = F.create_map(*(F.lit(x) for p in (preferences or {}).items() for x in p)) if preferences else F.lit(None).cast("map<string,string>")
    out = named.join(stats, ["log_id", "ordinal"], "left").withColumn("native_unit", native)
    out = out.withColumn("unit", F.coalesce(F.try_element_at(preferred, quantity_of(F.col("native_unit"))), F.col("native_unit")))
    changed = F.coalesce(F.col("native_unit") != F.col("unit"), F.lit(False))
    shown = lambda c: F.when(changed, half_away(convert(F.col(c), F.col("native_unit"), F.col("unit")), 3)).otherwise(F.col(c)).alias(c)
    at = channels.filter(F.col("header").rlike("(?i)time|offset")).groupBy("log_id").agg(F.min("ordinal").alias("ordinal"))
    spans = stats.join(at, ["log_id", "ordinal"]).select("log_id", half_away(F.col("hi") - F.col("lo"), 1).alias("duration"))
    rows = samples.groupBy("log_id").agg(F.countDistinct("row_no").alias("rows"))
    n = F.coalesce("n", F.lit(0))
    out = out.select("log_id", "ordinal", "header", n.cast("long").alias("n"), "unit", "native_unit", changed.alias("converted"), shown("lo"), shown("hi"), shown("mean"), (n == 0).alias("non_numeric"))
    return out.join(rows, "log_id", "left").join(spans, "log_id", "left")


def quality_summary(tally: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """One row for a fleet: logs, rows, rows kept, logs without any, and of their time reports sessions and corrupt stamps."""
    facts = [F.count("*").alias("logs"), F.sum("total").alias("total_rows"), F.sum("kept").alias("kept_rows"), F.count_if(F.col("kept") == 0).alias("unusable_logs")]
    if times is None:
        return tally.agg(*facts)
    both = tally.join(times.select("log_id", "sessions", "dropped"), "log_id", "left")
    return both.agg(*facts, F.sum("sessions").cast("long").alias("sessions"), F.sum("dropped").cast("long").alias("corrupt_stamps"))


def submission_report(channels: DataFrame, a: Analysis) -> DataFrame:
    """One row a log: what was made of it. format, rows, kept, found (roles), missing, silent (dead headers), empty (headers without a number),
    wideband, wideband_scale, loop_samples, loop_error_pct, full_bins (with enough rows), warnings; of interval logs from_rows, to_rows,
    duration, sessions, dropped.
    """
    sorted_list = lambda c: F.sort_array(F.collect_set(c))
    kind = channels.groupBy("log_id").agg(F.first("format").alias("format"))
    found = a.settings.select("log_id", F.sort_array(F.coalesce("roles", F.array().cast("array<string>"))).alias("found"), "wideband", "wideband_scale")
    missing = a.missing.groupBy("log_id").agg(sorted_list("role").alias("missing"))
    silent = a.silent.groupBy("log_id").agg(sorted_list("header").alias("silent"))
    empty = a.empty.groupBy("log_id").agg(sorted_list("header").alias("empty"))
    loop = a.closed_loop.select("log_id", F.col("samples").alias("loop_samples"), F.col("error_pct").alias("loop_error_pct"))
    bins = a.bins.groupBy("log_id").agg(F.count_if("enough_data").alias("full_bins"))
    out = kind.join(a.tally.select("log_id", F.col("total").alias("rows"), "kept"), "log_id", "left").join(found, "log_id", "left")
    for part in (missing, silent, empty, loop, bins, a.warnings, a.resampled.drop("boundaries")):
        out = out.join(part, "log_id", "left")
    return out


def report_text(report: DataFrame, step_ms: int = 100) -> DataFrame:
    """log_id, text: a row of ``submission_report`` in markdown; facts that a log doesn't have are left out."""
    words = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    c = F.col
    facts = {
        "format": c("format"),
        "resampled": F.when(c("to_rows").isNotNull(), F.format_string(f"%d to %d rows every {step_ms} ms", "from_rows", "to_rows")),
        "duration": F.when(c("duration").isNotNull(), F.concat(c("duration").cast("string"), F.lit(" s"))),
        "sessions": F.when(c("sessions") > 1, c("sessions")),
        "corrupt stamps dropped": F.when(c("dropped") > 0, c("dropped")),
        "rows usable": F.format_string("%d of %d", F.coalesce("kept", F.lit(0).cast("long")), F.coalesce("rows", F.lit(0).cast("long"))),
        "channels detected": words("found"),
        "not found": words("missing"),
        "logged but empty": words("silent"),
        "wideband": F.when(c("wideband").isNotNull(), F.concat("wideband", F.lit(" ("), F.coalesce("wideband_scale", F.lit("scale unknown")), F.lit(")"))),
        "closed loop": F.when(c("loop_samples").isNotNull(), F.format_string("%s %% over %d samples", c("loop_error_pct").cast("string"), c("loop_samples"))),
        "bins with enough samples": F.when(c("full_bins") > 0, c("full_bins")),
        "warnings": F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")),
    }
    return report.select("log_id", as_markdown(c("log_id").cast("string"), facts).alias("text"))


def side_by_side(logs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row per log: the per-log result tables side by side (each has log_id once), absent ones null."""
    out = logs.select("log_id").distinct()
    for df in parts.values():
        out = out.join(df, "log_id", "left")
    return out


def as_markdown(title: Column, facts: dict[str, Column]) -> Column:
    """A short markdown summary: a heading and one line per fact; facts that are null are left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"- {name}: "), c.cast("string"))) for name, c in facts.items()]
    return F.concat_ws("\n", F.concat(F.lit("## "), title), *lines)
