"""Sparse logs on a common time line: restarts and corrupt stamps, then a grid with values that expire.

Samples are long: log_id, row_no, t (seconds), channel, value. The order within a log is row_no. A log of any length
spreads over tasks: windows run over ranges of rows, and only one row for each stretch of steady time is walked in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dynofleet.functions.numbers import half_away
from dynofleet.operators import ranges
from dynofleet.operators.medians import upper_medians
from dynofleet.sources.tables import written


def time_blocks(samples: DataFrame) -> DataFrame:
    """Adds median, limit, timed, range_ and block: a block ends where time goes back or jumps by more than the limit.

    Rows without a time are left out. Inside a block time never goes back, so a block is kept or
    dropped as a whole; one that goes on in the next range of rows counts there as another one, with the same outcome. Rows
    and steps are written as a table, as they are read for the median, the blocks and the result.
    """
    timed = samples.filter(F.col("t").isNotNull() & ~F.isnan("t"))
    timed = written(ranges.lagged(timed, ["t"]).withColumn("step", F.col("t") - F.col("near_.t")).drop("near_"))
    counts = timed.groupBy("log_id").agg(F.count("*").alias("timed"))
    stats = counts.join(upper_medians(timed, ["log_id"], "step"), "log_id", "left")
    stats = stats.withColumn("median", F.coalesce("median", F.lit(0.1))).withColumn("limit", F.greatest(F.lit(60.0), F.col("median") * 1000))
    cut = (F.col("step") < 0) | (F.col("step") > F.col("limit"))
    return timed.join(stats, "log_id").withColumn("block", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(ranges.by_range()))


def _walked(marked: DataFrame) -> DataFrame:
    """log_id, range_, block, n, timed, kept, offset, restart, mark of every block: one stream a log that remembers the last accepted time.

    With P the last time accepted: first - P over the limit: dropped. first before P: a new session, which follows P by the
    median; ``mark`` is where it begins.
    """
    keys = ["log_id", ranges.RANGE, "block"]
    ends = marked.groupBy(*keys).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("median", "limit", "timed")))
    stream = ends.repartition("log_id").sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, p, offset = None, None, 0.0
        for b in batches:
            kept, offsets, restarts, marks = [], [], [], []
            columns = (b.column(c).to_pylist() for c in ("log_id", "first", "last", "median", "limit"))
            for k, first, last, median, limit in zip(*columns, strict=True):
                if k != log:
                    log, p, offset = k, None, 0.0
                jump = 0.0 if p is None else first - p
                restart = jump < 0
                if restart:
                    offset = offset + p + median - first
                kept.append(not jump > limit)
                offsets.append(offset)
                restarts.append(restart)
                marks.append(first + offset)
                if kept[-1]:
                    p = last
            new = (pa.array(kept, pa.bool_()), pa.array(offsets, pa.float64()), pa.array(restarts, pa.bool_()), pa.array(marks, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, "n", "timed")), *new], [*keys, "n", "timed", "kept", "offset", "restart", "mark"])

    kind = ends.schema["log_id"].dataType.simpleString()
    return stream.mapInArrow(walk, f"log_id {kind}, range_ long, block long, n long, timed long, kept boolean, offset double, restart boolean, mark double")


def normalize_time(samples: DataFrame) -> DataFrame:
    """Samples with t rebased: corrupt stamps dropped, sessions one after the other, 3 places.

    Logs of fewer than three timed rows keep theirs.
    """
    marked = time_blocks(samples)
    kept = _walked(marked).filter("kept").select("log_id", ranges.RANGE, "block", "offset")
    short = F.col("timed") < 3
    named = marked.join(kept, ["log_id", ranges.RANGE, "block"], "left").filter(short | F.col("offset").isNotNull())
    t = F.when(short, F.col("t")).otherwise(half_away(F.col("t") + F.col("offset"), 3))
    return named.withColumn("t", t).select(*samples.columns)


def time_report(samples: DataFrame) -> DataFrame:
    """log_id, sessions, dropped, blank, boundaries: what ``normalize_time`` did to a log."""
    blank = samples.groupBy("log_id").agg(F.count_if(F.col("t").isNull() | F.isnan("t")).alias("blank"))
    w = _walked(time_blocks(samples)).withColumn("long", F.col("timed") >= 3)
    restart = F.col("long") & F.col("restart")
    marks = F.array_compact(F.transform(F.sort_array(F.collect_list(F.when(restart, F.struct(ranges.RANGE, "block", half_away(F.col("mark"), 3).alias("at"))))), lambda x: x["at"]))
    out = w.groupBy("log_id").agg((F.count_if(restart) + 1).cast("int").alias("sessions"), F.sum(F.when(F.col("long") & ~F.col("kept"), F.col("n")).otherwise(0)).alias("dropped"), marks.alias("boundaries"))
    return blank.join(out, "log_id", "left").select("log_id", F.coalesce("sessions", F.lit(1)).alias("sessions"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), "blank", "boundaries")


def update_intervals(samples: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """log_id, channel, interval: upper median of the positive gaps between a channel's own samples, null without."""
    own = ["log_id", "channel"]
    there = samples.filter(" or ".join(f"`{v}` is not null" for v in values)).select(*own, "row_no", "t")
    gaps = ranges.lagged(there, ["t"], own).withColumn("gap", F.col("t") - F.col("near_.t"))
    return there.select(*own).distinct().join(upper_medians(gaps, own, "gap", "interval"), own, "left")


def hold_limits(intervals: DataFrame, factor: float = 3.0, least: float = 1.0, unknown: float = 5.0) -> DataFrame:
    """Adds hold: how long a value of the channel may stand, in seconds."""
    return intervals.withColumn("hold", F.coalesce(F.greatest(F.lit(least), F.col("interval") * factor), F.lit(unknown)))


def resample_hold(samples: DataFrame, step_ms: int = 100, factor: float = 3.0, least: float = 1.0, unknown: float = 5.0, values: Sequence[str] = ("value",)) -> DataFrame:
    """log_id, k, t, channel and ``values``: every channel on a grid of ``step_ms``, held until it expires.

    Grid row k stands at t0 + k steps, the last one at the end of the log, and sees samples up to the
    end of its own step. Times count in whole milliseconds, so steps add up exactly. Rows where a
    channel has no value or it has expired are left out. ``values`` may be several columns of any type (a number and a
    word, say): a sample is a row with one of them, and they are held together.
    """
    own = ["log_id", "channel"]
    ms = F.floor(F.col("t") * 1000 + 0.5).cast("long")
    samples = written(samples.select("log_id", "row_no", "t", "channel", *values))  # read for spans, intervals and values
    timed = samples.filter("t is not null").select("log_id", "row_no", ms.alias("ms"), "channel", *values)
    span = timed.groupBy("log_id").agg(F.min("ms").alias("t0"), F.max("ms").alias("t1")).withColumn("n", F.floor((F.col("t1") - F.col("t0")) / step_ms).cast("long"))
    bucket = F.least(F.floor((F.col("ms") - F.col("t0")) / step_ms).cast("long"), F.col("n"))
    filled = timed.filter(" or ".join(f"`{v}` is not null" for v in values)).join(span, "log_id").groupBy(*own, bucket.alias("from"))
    last = filled.agg(F.max_by(F.struct(*values, "ms"), "row_no").alias("s"), *(F.first(c).alias(c) for c in ("t0", "t1", "n")))
    holds = hold_limits(update_intervals(samples, values), factor, least, unknown).select(*own, F.floor(F.col("hold") * 1000 + 0.5).cast("long").alias("hold"))
    # A sample stands up to the next one, or as long as it holds: only those rows of the grid are made.
    next_ = F.coalesce(F.col("near_.from") - 1, F.col("n"))
    stands = F.floor((F.col("s.ms") + F.col("hold") - F.col("t0")) / step_ms).cast("long")
    rows = ranges.led(last, [], own, "from").join(holds, own).withColumn("to", F.least(next_, stands, F.col("n"))).filter(F.col("to") >= F.col("from"))
    grid = rows.select(*own, "s", "hold", "t0", "t1", "n", F.explode(F.sequence("from", "to")).alias("k"))
    label = F.when(F.col("k") == F.col("n"), F.col("t1")).otherwise(F.col("t0") + F.col("k") * step_ms)
    out = grid.withColumn("label", label).filter(F.col("label") - F.col("s.ms") <= F.col("hold"))
    return out.select("log_id", "k", (F.col("label") / 1000).alias("t"), "channel", *(F.col(f"s.{v}").alias(v) for v in values))


def grid_rows(samples: DataFrame, step_ms: int = 100) -> DataFrame:
    """log_id, k of all rows of the grids, also of those on which nothing stands; a long grid is made in many tasks."""
    ms = F.floor(F.col("t") * 1000 + 0.5).cast("long")
    n = F.floor((F.max(ms) - F.min(ms)) / step_ms).cast("long")
    spans = samples.filter("t is not null").groupBy("log_id").agg(n.alias("n"))
    part = F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / ranges.ROWS))).alias("part")
    parts = spans.select("log_id", "n", part).repartition("log_id", "part")
    first = F.col("part") * ranges.ROWS
    return parts.select("log_id", F.explode(F.sequence(first, F.least(first + ranges.ROWS - 1, F.col("n")))).alias("k"))


def resample_report(samples: DataFrame, step_ms: int = 100) -> DataFrame:
    """log_id, from_rows, to_rows, duration: rows in, grid rows out, seconds covered."""
    ms = F.floor(F.col("t") * 1000 + 0.5).cast("long")
    span = samples.groupBy("log_id").agg(F.count("*").alias("from_rows"), F.min(ms).alias("a"), F.max(ms).alias("b"))
    return span.select("log_id", "from_rows", (F.floor((F.col("b") - F.col("a")) / step_ms) + 1).cast("long").alias("to_rows"), half_away((F.col("b") - F.col("a")) / 1000, 2).alias("duration"))
