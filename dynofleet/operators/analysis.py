"""From parsed logs to readings: one call that composes roles, units, time, guards, bins, mixture and knock.

Every log of the table is judged by its own channels and units: what a log has, its warm-up limit and
the scales of its mixtures stand in one row a log, which is joined by log_id. Interval logs, in which most cells are blank,
are put on a grid first: their rows hold a channel or two each, and no guard or bin would see two channels together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.functions.units import detect_scale
from dynofleet.operators import align, knock, mixture, trims
from dynofleet.operators import channels as ch
from dynofleet.sources.logs import cells_of
from dynofleet.sources.tables import dropped, written

_KNOWN = ("lambda", "eq", "afr")
#: The time of an interval log is its first channel of this name.
OFFSET = "(?i)^offset"


@dataclass(frozen=True)
class Analysis:
    """What ``analyze`` gives; every table has log_id. ``rows``: the dense log that all readings read.

    ``tables``: what was written on the way; all readings read them, so delete them (``done``) only when those are taken.
    """

    settings: DataFrame
    rows: DataFrame
    classified: DataFrame
    tally: DataFrame
    bins: DataFrame
    heatmap: DataFrame
    warnings: DataFrame
    missing: DataFrame
    silent: DataFrame
    empty: DataFrame
    wot: DataFrame
    wot_summary: DataFrame
    closed_loop: DataFrame
    knock_map: DataFrame
    spark_map: DataFrame
    knock_events: DataFrame
    spark_summary: DataFrame
    resampled: DataFrame
    tables: tuple[DataFrame, ...]

    def take(self, name: str) -> DataFrame:
        """One reading as a table of its own; everything else goes."""
        out = written(getattr(self, name))
        self.done()
        return out

    def done(self) -> None:
        dropped(*self.tables)


def log_settings(channels: DataFrame, used: DataFrame, log: DataFrame, f: trims.Filters = trims.Filters()) -> DataFrame:
    """One row a log: roles (live ones), min_ect (in the log's unit; null: no guard), commanded and wideband (headers), pe_scale,
    wideband_scale, commanded_scale, closed_loop_inferred.

    ``pe_scale`` is set only where neither an enrichment nor a closed-loop flag is live and the scale of the
    commanded mixture is known.
    """
    roles = used.groupBy("log_id").agg(F.collect_set("role").alias("roles"), *(F.max(F.when(F.col("role") == r, F.col("header"))).alias(n) for r, n in (("commanded_afr", "commanded"), ("wideband_afr", "wideband"))))
    out = channels.select("log_id").distinct().join(roles, "log_id", "left")
    out = out.join(ch.ect_threshold(used, f.min_ect).withColumnRenamed("threshold", "min_ect"), "log_id", "left") if f.min_ect is not None else out.withColumn("min_ect", F.lit(None).cast("double"))
    out = out.join(mixture.scale_samples(log), "log_id", "left")
    scale = lambda header, median: detect_scale(F.col(header), F.col(median))["scale"]
    there = lambda role: F.coalesce(F.array_contains("roles", role), F.lit(False))
    proxy = scale("commanded", "early_median")
    commanded = F.when(there("commanded_afr"), scale("commanded", "commanded_median"))
    return out.select(
        "log_id",
        "roles",
        "min_ect",
        "commanded",
        "wideband",
        F.when(~there("pe") & ~there("closed_loop") & there("commanded_afr") & proxy.isin(*_KNOWN), proxy).alias("pe_scale"),
        F.when(there("wideband_afr"), scale("wideband", "wideband_median")).alias("wideband_scale"),
        commanded.alias("commanded_scale"),
        (~there("closed_loop") & F.coalesce(commanded.isin(*_KNOWN), F.lit(False))).alias("closed_loop_inferred"),
    )


def interval_logs(channels: DataFrame, samples: DataFrame) -> DataFrame:
    """log_id, time_at of the sectioned logs that are sparse and have a time: those that need a grid."""
    at = channels.filter((F.col("format") == "sectioned") & F.col("header").rlike(OFFSET)).groupBy("log_id").agg(F.min("ordinal").alias("time_at"))
    sparse = ch.log_density(channels, samples).filter("sparse").select("log_id")
    return at.join(sparse, "log_id")


def on_grid(channels: DataFrame, samples: DataFrame, step_ms: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """(samples of dense logs, samples of interval logs on a grid, report, tables written on the way).

    Of an interval log restarts and corrupt stamps are settled on its rows, then numbers and words (flags) of every channel
    stand on a grid of ``step_ms`` until they expire; row_no is the place on the grid from 1, and a grid row on which nothing stands has one
    sample of no channel. ``report``: log_id, from_rows, to_rows, duration, sessions, dropped, boundaries of these logs.
    ``samples``: log_sample, or what ``logs.parse_rows`` gives; those of dense logs stay in the same form.
    """
    which = written(interval_logs(channels, samples))  # one row a log, read four times
    dense = samples.join(which, "log_id", "left_anti")
    own = samples.join(which.select("log_id"), "log_id", "left_semi")
    interval = (cells_of(own) if "values" in samples.columns else own).join(which, "log_id")
    clock = interval.filter("ordinal = time_at").select("log_id", "row_no", F.col("value_num").alias("t"))
    rows = interval.select("log_id", "row_no").distinct().join(clock, ["log_id", "row_no"], "left")
    times = written(align.normalize_time(rows))
    cells = interval.filter("ordinal <> time_at and (value_num is not null or value_str is not null)").join(times, ["log_id", "row_no"])
    held = align.resample_hold(cells.select("log_id", "row_no", "t", F.col("ordinal").alias("channel"), "value_num", "value_str").unionByName(_clock(times)), step_ms, values=("value_num", "value_str"))
    filler = align.grid_rows(times, step_ms).select("log_id", F.col("k") + 1, F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    stand = held.filter("channel >= 0").select("log_id", (F.col("k") + 1).alias("row_no"), F.col("channel").alias("ordinal"), "value_num", "value_str")
    report = align.resample_report(times, step_ms).drop("from_rows").join(rows.groupBy("log_id").agg(F.count("*").alias("from_rows")), "log_id").join(align.time_report(rows).drop("blank"), "log_id")
    return dense, stand.union(filler), report.select("log_id", "from_rows", "to_rows", "duration", "sessions", "dropped", "boundaries"), (which, times)


def _clock(times: DataFrame) -> DataFrame:
    """The first and last time of a log as samples of channel -1, so that its grid spans all of its rows."""
    ends = times.groupBy("log_id").agg(F.min_by(F.struct("row_no", "t"), "t").alias("a"), F.max_by(F.struct("row_no", "t"), "t").alias("b")).select("log_id", F.explode(F.array("a", "b")).alias("x"))
    return ends.select("log_id", "x.row_no", "x.t", F.lit(-1).alias("channel"), F.lit(0.0).alias("value_num"), F.lit(None).cast("string").alias("value_str"))


def analyze(channels: DataFrame, samples: DataFrame, f: trims.Filters = trims.Filters(), fuel: str = "gasoline", overrides: DataFrame | None = None, step_ms: int = 100) -> Analysis:
    """All readings of parsed logs (log_channel, and log_sample or what ``logs.parse_rows`` gives); interval logs are put on a grid of ``step_ms`` before.

    Maps have manifold pressure as their second axis, or load in logs without it. The dense log is written once, as a table.
    """
    parsed = [df for df in (channels, samples) if not hasattr(df, "_written_at")]
    if parsed:  # read many times
        channels, samples = written(channels), written(samples)
        parsed = [channels, samples]
    roles = ch.role_candidates(channels).select("log_id", "ordinal")
    wanted = roles.unionByName(overrides.select("log_id", "ordinal")) if overrides is not None else roles
    dense, grid, resampled, made = on_grid(channels, samples, step_ms)
    arrays = "values" in samples.columns
    if not arrays:
        grid = dense.select(*grid.columns).union(grid)
    # Only channels that may play a role go on, and the rows themselves.
    grid = written(grid.join(wanted.distinct().withColumn("role_", F.lit(True)), ["log_id", "ordinal"], "left").withColumn("ordinal", F.when(F.col("role_"), F.col("ordinal"))).withColumns({c: F.when(F.col("role_"), F.col(c)) for c in ("value_num", "value_str")}).drop("role_"))
    # Columns with a number, once for all who ask: of the logs as they came, and with the interval logs' as they stand on the grid.
    seen = lambda df: written(df.withColumn("value_num", F.lit(1.0)))
    raw = seen(ch.live_cells(samples) if arrays else ch.live_columns(samples))
    live = ch.live_columns(grid)
    live = seen(raw.join(made[0], "log_id", "left_anti").select("log_id", "ordinal").unionByName(live) if arrays else live)
    used = written(ch.live_channels(channels, live, overrides))
    log = ch.wide_log(used, grid)
    log = written(ch.wide_rows(used, dense).unionByName(log) if arrays else log)
    settings = written(log_settings(channels, used, log, f))
    has = lambda role: F.coalesce(F.array_contains("roles", role), F.lit(False))
    axis = settings.select("log_id", has("map").alias("has_map"))
    loaded = log.join(axis, "log_id").withColumn("y_axis", F.when(F.col("has_map"), F.col("map")).otherwise(F.col("load"))).drop("has_map")
    classified = trims.classify_rows(loaded, f, settings=settings)
    kept = trims.kept_rows(classified)
    mixed = mixture.as_lambda(log, fuel, settings=settings)
    silent = ch.silent_channels(channels, live)
    events = knock.knock_events(loaded, y="y_axis")
    return Analysis(
        settings=settings,
        rows=log,
        classified=classified.drop("y_axis"),
        tally=trims.rejection_tally(classified),
        bins=trims.axis_bins(kept),
        heatmap=trims.trim_heatmap(kept, y="y_axis"),
        warnings=ch.log_warnings(used, silent, channels, settings),
        missing=ch.missing_roles(channels, live),
        silent=silent,
        empty=ch.empty_channels(channels, raw),
        wot=mixture.wot_bins(mixed, fuel),
        wot_summary=mixture.wot_summary(mixed),
        closed_loop=mixture.closed_loop_check(mixed, fuel, settings=settings),
        knock_map=knock.knock_map(loaded, y="y_axis"),
        spark_map=knock.spark_map(loaded, y="y_axis"),
        knock_events=events,
        spark_summary=knock.spark_summary(log, events),
        resampled=written(resampled),
        tables=(*parsed, *made, grid, raw, live, used, log, settings),
    )
