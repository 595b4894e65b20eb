"""Fuel trims of dense logs: one verdict per row, then bins over what is kept.

A dense log has log_id, row_no and one column a role, null where the channel is missing:
rpm, maf_hz, ltft, stft, ect, tps, map, load, pe, closed_loop, ... Which channels a log has at all is
told by its settings, or for a table of logs that are all alike by ``has``; guards on other roles don't apply.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dynofleet.functions.numbers import exact_mean, half_away, step_down
from dynofleet.operators import ranges

REASONS = ("notRunning", "cold", "openLoop", "powerEnrich", "transient", "noTrimData")


@dataclass(frozen=True)
class Filters:
    """Thresholds of the row verdict; ``min_ect`` is in the log's own unit, None: no warm-up guard."""

    min_ect: float | None = 160.0
    max_tps_delta: float = 2.0
    max_rpm_delta: float = 200.0
    min_rpm: float = 500.0
    closed_loop: bool = True
    exclude_pe: bool = True


def sample_deltas(log: DataFrame) -> DataFrame:
    """Adds d_tps and d_rpm against the row before (null counts as 0); null in the first row of a log."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    delta = lambda c: F.when(F.col("near_").isNotNull(), F.abs(zero(c) - zero(f"near_.{c}")))
    return ranges.lagged(log, ["tps", "rpm"]).withColumns({"d_tps": delta("tps"), "d_rpm": delta("rpm")}).drop("near_", ranges.RANGE)


def derived_trims(log: DataFrame) -> DataFrame:
    """Adds total = ltft + stft, a missing one being 0; null where both are."""
    none = F.col("ltft").isNull() & F.col("stft").isNull()
    return log.withColumn("total", F.when(~none, F.coalesce("ltft", F.lit(0.0)) + F.coalesce("stft", F.lit(0.0))))


def rich(commanded: Column, scale: Column | str) -> Column:
    """Is the commanded mixture richer than stoichiometric; scale: eq, lambda or afr (of gasoline)."""
    scale = F.lit(scale) if isinstance(scale, str) else scale
    return F.when(scale == "eq", commanded > 1.02).when(scale == "afr", commanded / 14.7 < 0.98).when(scale == "lambda", commanded < 0.98)


def classify_rows(log: DataFrame, f: Filters = Filters(), has: set[str] | None = None, pe_proxy: str | None = None, settings: DataFrame | None = None) -> DataFrame:
    """Adds ``reason``: the first guard that a row fails, in fixed order, or null: kept; and ``total``.

    ``settings``: one row a log (log_id, roles, min_ect, pe_scale), as ``analysis.log_settings`` gives it. Each log is then
    judged by the channels it has and in its own unit; ``has``, ``pe_proxy`` and ``f.min_ect`` say the same for a
    table whose logs are all alike. ``pe_proxy``, ``pe_scale``: scale of the commanded mixture, which stands for
    a power-enrichment flag where neither that flag nor a closed-loop flag exists.
    """
    if settings is None:
        has = set(log.columns) if has is None else has
        there = lambda role: F.lit(role in has)
        coldest = F.lit(f.min_ect).cast("double")
        scale = F.lit(pe_proxy if "pe" not in has and "closed_loop" not in has else None).cast("string")
    else:
        log = log.join(settings.select("log_id", F.col("roles").alias("has_roles"), F.col("min_ect").alias("own_min_ect"), "pe_scale"), "log_id", "left")
        there = lambda role: F.coalesce(F.array_contains("has_roles", role), F.lit(False))
        coldest, scale = F.col("own_min_ect"), F.col("pe_scale")
    out = derived_trims(sample_deltas(log))
    column = lambda c, kind: F.col(c) if c in log.columns else F.lit(None).cast(kind)
    reason = F.when(F.lit(False), "")
    if f.exclude_pe:
        reason = reason.when(rich(column("commanded_afr", "double"), scale), "powerEnrich")
    reason = reason.when(F.col("rpm") < f.min_rpm, "notRunning")
    reason = reason.when(there("ect") & (column("ect", "double") < coldest), "cold")
    if f.closed_loop:
        reason = reason.when(there("closed_loop") & ~F.coalesce(column("closed_loop", "boolean"), F.lit(False)), "openLoop")
    if f.exclude_pe:
        reason = reason.when(there("pe") & F.coalesce(column("pe", "boolean"), F.lit(False)), "powerEnrich")
    reason = reason.when((F.col("d_tps") > f.max_tps_delta) | (F.col("d_rpm") > f.max_rpm_delta), "transient")
    out = out.withColumn("reason", reason.when(F.col("total").isNull(), "noTrimData"))
    return out if settings is None else out.drop("has_roles", "own_min_ect", "pe_scale")


def kept_rows(classified: DataFrame) -> DataFrame:
    """Rows without a reason to go; a missing trim of a kept row is 0."""
    return classified.filter("reason is null").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ltft", "stft")})


def rejection_tally(classified: DataFrame) -> DataFrame:
    """log_id, a count for every reason, kept and total."""
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    return classified.groupBy("log_id").agg(*counts, F.count_if(F.col("reason").isNull()).alias("kept"), F.count("*").alias("total"))


def axis_bins(kept: DataFrame, axis: str = "maf_hz", width: float = 500.0, enough: int = 20) -> DataFrame:
    """Mean trims by bins of an axis, the suggested change and the multiplier; ``enough_data`` from ``enough`` rows."""
    mean = lambda c: exact_mean(F.col(c))
    binned = kept.filter(F.col(axis).isNotNull()).withColumn("bin_from", step_down(F.col(axis), width))
    out = binned.groupBy("log_id", "bin_from").agg(F.count("*").alias("n"), mean("ltft").alias("l"), mean("stft").alias("s"), mean("total").alias("t"))
    return out.select(
        "log_id",
        "bin_from",
        (F.col("bin_from") + float(width)).alias("bin_to"),
        "n",
        half_away(F.col("l"), 2).alias("avg_ltft"),
        half_away(F.col("s"), 2).alias("avg_stft"),
        half_away(F.col("t"), 2).alias("avg_total"),
        half_away(F.col("t"), 1).alias("suggested_pct"),
        half_away((100 + F.col("t")) / 100, 4).alias("multiplier"),
        (F.col("n") >= enough).alias("enough_data"),
    )


def trim_heatmap(kept: DataFrame, x: str = "rpm", y: str = "map", x_width: float = 500.0, y_width: float = 10.0, enough: int = 5) -> DataFrame:
    """Mean total trim over a grid of two axes."""
    cells = kept.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("log_id", step_down(F.col(x), x_width).alias("x"), step_down(F.col(y), y_width).alias("y"))
    return cells.agg(F.count("*").alias("n"), half_away(exact_mean(F.col("total")), 2).alias("avg_total")).withColumn("enough_data", F.col("n") >= enough)


def formula_columns(log: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Adds stored formulas, given as SQL expressions over the roles of a log."""
    return log.withColumns({name: F.expr(text) for name, text in formulas.items()})


# The stored formulas that the library ships with (ipw: injector pulse width in ms).
FORMULAS = {
    "duty_cycle": "ipw * rpm / 1200",
    "total_trim": "ltft + stft",
    "maf_multiplier": "(100 + ltft + stft) / 100",
    "afr_error": "(wideband_afr - commanded_afr) / commanded_afr * 100",
}
