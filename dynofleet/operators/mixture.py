"""Wideband readings of dense logs: full throttle by rpm, the worst point, the closed-loop check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.functions.numbers import exact_mean, half_away, step_down
from dynofleet.functions.units import STOICH, to_lambda


def scale_sample(log: DataFrame, channel: str, first: int = 400) -> DataFrame:
    """log_id, median: the upper median of the first ``first`` values that are not null."""
    w = Window.partitionBy("log_id").orderBy("row_no")
    head = log.filter(F.col(channel).isNotNull()).select("log_id", F.col(channel).alias("v"), F.row_number().over(w).alias("k")).filter(F.col("k") <= first)
    return head.groupBy("log_id").agg(F.expr("percentile_disc(0.5) within group (order by v desc)").alias("median"))


def scale_samples(log: DataFrame, first: int = 400) -> DataFrame:
    """log_id, commanded_median, wideband_median of the first ``first`` values, early_median of commanded values in the first ``first`` rows.

    The medians of ``scale_sample`` for both mixtures; every task keeps no more than ``first`` rows of a log before they are shuffled.
    """
    w = Window.partitionBy("log_id").orderBy("row_no")
    rows = log.select("log_id", "row_no", F.col("commanded_afr").alias("v")).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= first)
    early = rows.groupBy("log_id").agg(F.expr("percentile_disc(0.5) within group (order by v desc) filter (where v is not null)").alias("early_median"))
    out = early
    for channel, name in (("commanded_afr", "commanded_median"), ("wideband_afr", "wideband_median")):
        out = out.join(scale_sample(log, channel, first).withColumnRenamed("median", name), "log_id", "left")
    return out


def as_lambda(log: DataFrame, fuel: str = "gasoline", wideband_scale: str = "afr", commanded_scale: str = "afr", settings: DataFrame | None = None) -> DataFrame:
    """Adds wb and cmd, measured and commanded lambda.

    ``settings``: one row a log with wideband_scale and commanded_scale, as ``analysis.log_settings`` gives it.
    """
    s, wb, cmd = STOICH[fuel], F.lit(wideband_scale), F.lit(commanded_scale)
    if settings is not None:
        log = log.join(settings.select("log_id", F.col("wideband_scale").alias("own_wb"), F.col("commanded_scale").alias("own_cmd")), "log_id", "left")
        wb, cmd = F.col("own_wb"), F.col("own_cmd")
    out = log.withColumns({"wb": to_lambda(F.col("wideband_afr"), wb, s), "cmd": to_lambda(F.col("commanded_afr"), cmd, s)})
    return out if settings is None else out.drop("own_wb", "own_cmd")


def _at_wot(wot_tps: float) -> F.Column:
    return F.col("wb").isNotNull() & F.col("rpm").isNotNull() & (F.coalesce("pe", F.lit(False)) | F.coalesce(F.col("tps") >= wot_tps, F.lit(False)))


def wot_bins(log: DataFrame, fuel: str = "gasoline", lean_limit: float = 1.0, wot_tps: float = 80.0, width: float = 500.0) -> DataFrame:
    """By rpm bin at full throttle or in enrichment: measured and commanded mixture, error, leanest, lean flag."""
    s = STOICH[fuel]
    cells = log.filter(_at_wot(wot_tps)).groupBy("log_id", step_down(F.col("rpm"), width).alias("rpm_from"))
    both = cells.agg(F.count("*").alias("n"), exact_mean(F.col("wb")).alias("w"), exact_mean(F.col("cmd")).alias("c"), F.max("wb").alias("top"))
    return both.select(
        "log_id",
        "rpm_from",
        "n",
        half_away(F.col("w"), 3).alias("avg_lambda"),
        half_away(F.col("w") * s, 2).alias("avg_afr"),
        half_away(F.col("c"), 3).alias("commanded_lambda"),
        half_away(F.col("c") * s, 2).alias("commanded_afr"),
        half_away((F.col("w") / F.col("c") - 1) * 100, 1).alias("error_pct"),
        half_away(F.col("top"), 3).alias("leanest_lambda"),
        (F.col("w") > lean_limit).alias("lean"),
    )


def wot_summary(log: DataFrame, lean_limit: float = 1.0, wot_tps: float = 80.0) -> DataFrame:
    """Samples at full throttle, lean ones, and the leanest sample (the first of equal ones)."""
    worst = F.max_by(F.struct("wb", "rpm", "tps", "cmd"), F.struct("wb", -F.col("row_no")))
    out = log.filter(_at_wot(wot_tps)).groupBy("log_id").agg(F.count("*").alias("wot_samples"), F.count_if(F.col("wb") > lean_limit).alias("lean_samples"), worst.alias("m"))
    return out.select("log_id", "wot_samples", "lean_samples", half_away(F.col("m.wb"), 3).alias("worst_lambda"), F.col("m.rpm").alias("worst_rpm"), F.col("m.tps").alias("worst_tps"), half_away(F.col("m.cmd"), 3).alias("worst_commanded"))


def closed_loop_check(log: DataFrame, fuel: str = "gasoline", least: int = 20, inferred: bool = False, settings: DataFrame | None = None) -> DataFrame:
    """Mean measured and commanded mixture in closed loop and their error; logs with ``least`` such rows.

    ``inferred``: no closed-loop channel exists; commanding lambda within 1 % of 1 stands for it.
    ``settings``: one row a log with closed_loop_inferred, which says so for each.
    """
    s, near = STOICH[fuel], F.abs(F.col("cmd") - 1) <= 0.01
    flag = F.coalesce("closed_loop", F.lit(False)) if "closed_loop" in log.columns else F.lit(False)
    closed = near if inferred else flag
    if settings is not None:
        log = log.join(settings.select("log_id", "closed_loop_inferred"), "log_id", "left")
        closed = F.when(F.col("closed_loop_inferred"), near).otherwise(flag)
    rows = log.filter(closed & ~F.coalesce("pe", F.lit(False)) & F.col("wb").isNotNull() & F.col("cmd").isNotNull())
    out = rows.groupBy("log_id").agg(F.count("*").alias("samples"), exact_mean(F.col("wb")).alias("w"), exact_mean(F.col("cmd")).alias("c")).filter(F.col("samples") >= least)
    return out.select(
        "log_id",
        "samples",
        half_away(F.col("w"), 3).alias("measured_lambda"),
        half_away(F.col("c"), 3).alias("commanded_lambda"),
        half_away(F.col("w") * s, 2).alias("measured_afr"),
        half_away(F.col("c") * s, 2).alias("commanded_afr"),
        half_away((F.col("w") / F.col("c") - 1) * 100, 1).alias("error_pct"),
    )
