"""Knock and spark of dense logs, over all running rows: maps, events, the worst sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dynofleet.functions.numbers import exact_mean, half_away, step_down
from dynofleet.operators import ranges

LEAST = 0.1


def running(log: DataFrame, min_rpm: float = 500.0) -> DataFrame:
    """Rows of a running engine; an unknown speed counts as running."""
    return log.filter(F.coalesce(F.col("rpm") >= min_rpm, F.lit(True)))


def _cells(log: DataFrame, y: str, x_width: float, y_width: float) -> DataFrame:
    return log.filter(F.col("rpm").isNotNull() & F.col(y).isNotNull()).withColumns({"x": step_down(F.col("rpm"), x_width), "y": step_down(F.col(y), y_width)})


def knock_map(log: DataFrame, y: str = "map", least: float = LEAST, x_width: float = 500.0, y_width: float = 10.0) -> DataFrame:
    """By rpm and load cell: samples, the largest retard (never the mean), and samples that knock."""
    kr = F.col("knock_retard")
    cells = _cells(running(log).filter(kr.isNotNull()), y, x_width, y_width).groupBy("log_id", "x", "y")
    return cells.agg(F.count("*").alias("n"), half_away(F.greatest(F.lit(0.0), F.max(kr)), 2).alias("max_kr"), F.count_if(kr >= least).alias("hits"))


def spark_map(log: DataFrame, y: str = "map", x_width: float = 500.0, y_width: float = 10.0) -> DataFrame:
    """By the same cells: mean and largest spark advance."""
    cells = _cells(running(log).filter(F.col("spark").isNotNull()), y, x_width, y_width).groupBy("log_id", "x", "y")
    return cells.agg(F.count("*").alias("n"), half_away(exact_mean(F.col("spark")), 1).alias("avg_advance"), half_away(F.max("spark"), 1).alias("max_advance"))


def knock_events(log: DataFrame, y: str = "map", least: float = LEAST, min_rpm: float = 500.0) -> DataFrame:
    """Runs of following rows that knock; a row that is not running, without retard or below ``least`` ends one.

    Of an event: its first row number, samples, peak; rpm, load, iat and spark at the first peak;
    ect and tps at the first row; the rpm range; ``suspect_false`` under light throttle.
    """
    hit = F.coalesce(F.col("rpm") >= min_rpm, F.lit(True)) & F.coalesce(F.col("knock_retard") >= least, F.lit(False))
    # Rows that don't knock so far: the same for all rows of a run, also where it goes on in the next range of rows.
    islands = ranges.running_count(log.withColumn("hit", hit), ~F.col("hit"), "island").filter("hit")
    peak = F.max_by(F.struct(F.col("knock_retard").alias("kr"), "rpm", F.col(y).alias("load"), "iat", "spark"), F.struct("knock_retard", -F.col("row_no")))
    head = F.min_by(F.struct("ect", "tps"), "row_no")
    out = islands.groupBy("log_id", "island").agg(
        F.min("row_no").alias("start_row"), F.count("*").alias("samples"), peak.alias("p"), head.alias("h"), F.min("rpm").alias("rpm_min"), F.max("rpm").alias("rpm_max")
    )
    return out.select(
        "log_id",
        "start_row",
        "samples",
        half_away(F.col("p.kr"), 2).alias("peak_kr"),
        F.col("p.rpm").alias("rpm"),
        "rpm_min",
        "rpm_max",
        half_away(F.col("p.load"), 1).alias("load"),
        half_away(F.col("p.iat"), 1).alias("iat"),
        half_away(F.col("h.ect"), 1).alias("ect"),
        half_away(F.col("h.tps"), 1).alias("tps"),
        half_away(F.col("p.spark"), 1).alias("spark_at_peak"),
        F.coalesce(F.col("h.tps") < 25, F.lit(False)).alias("suspect_false"),
    )


def top_knock_events(events: DataFrame, most: int = 25) -> DataFrame:
    """The hardest events of every log, the earlier one first among equals."""
    w = Window.partitionBy("log_id").orderBy(F.desc("peak_kr"), "start_row")
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def spark_summary(log: DataFrame, events: DataFrame, least: float = LEAST) -> DataFrame:
    """Running samples, samples that knock, events, and the worst sample (the first of equal ones)."""
    hit = F.coalesce(F.col("knock_retard") >= least, F.lit(False))
    worst = F.max_by(F.struct(F.col("knock_retard").alias("kr"), "rpm"), F.when(hit, F.struct("knock_retard", -F.col("row_no"))))
    rows = running(log).groupBy("log_id").agg(F.count("*").alias("running_samples"), F.count_if(hit).alias("knock_samples"), worst.alias("m"))
    n = events.groupBy("log_id").agg(F.count("*").alias("n"))
    return rows.join(n, "log_id", "left").select("log_id", "running_samples", "knock_samples", F.coalesce("n", F.lit(0)).alias("event_count"), half_away(F.col("m.kr"), 2).alias("worst_kr"), F.col("m.rpm").alias("worst_rpm"))
