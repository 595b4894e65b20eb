"""Queries over the sparse stand-in log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dynofleet.operators import align
from dynofleet.plans.standins import SPARSE_SQL, half_away_sql as half, sparse_log

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE {SPARSE_SQL} {sql}"
        return f

    return keep


HOUR = 3_600_000
_INTERVALS = """, own AS (SELECT log_id, channel, t - lag(t) OVER (PARTITION BY log_id, channel ORDER BY row_no) AS g FROM normal WHERE value IS NOT NULL),
iv AS (SELECT log_id, channel, percentile_disc(0.5) WITHIN GROUP (ORDER BY g DESC) FILTER (WHERE g > 0) AS interval FROM own GROUP BY log_id, channel),
hold AS (SELECT *, coalesce(greatest(1, interval * 3), 5) AS hold FROM iv)"""


@query("normalize_time", "SELECT log_id, row_no, t, channel, value FROM normal")
def _(spark, d):
    return align.normalize_time(sparse_log(spark, d))


@query("time_report", "SELECT log_id, CAST(max(sessions) AS INTEGER) AS sessions, CAST(max(dropped) AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS blank, coalesce(string_agg(CAST(CAST(sign(t + off) * floor(abs(t + off) * CAST(1000 AS DOUBLE) + 0.5) / CAST(1000 AS DOUBLE) AS DECIMAL(18,3)) AS VARCHAR), '|' ORDER BY row_no) FILTER (begins), '') AS boundaries FROM (SELECT *, sessions > lag(sessions) OVER (PARTITION BY log_id ORDER BY row_no) AS begins FROM walk) GROUP BY log_id")
def _(spark, d):
    marks = F.array_join(F.transform("boundaries", lambda x: x.cast("decimal(18,3)").cast("string")), "|")
    return align.time_report(sparse_log(spark, d)).withColumn("boundaries", marks)


@query("update_intervals", f"{_INTERVALS} SELECT log_id, channel, {half('interval', 3)} AS interval FROM iv")
def _(spark, d):
    from dynofleet.functions.numbers import half_away

    return align.update_intervals(align.normalize_time(sparse_log(spark, d))).withColumn("interval", half_away(F.col("interval"), 3))


@query("hold_limits", f"{_INTERVALS} SELECT log_id, channel, {half('interval', 3)} AS interval, {half('hold', 3)} AS hold FROM hold")
def _(spark, d):
    from dynofleet.functions.numbers import half_away

    out = align.hold_limits(align.update_intervals(align.normalize_time(sparse_log(spark, d))))
    return out.withColumns({c: half_away(F.col(c), 3) for c in ("interval", "hold")})


@query(
    "resample_hold",
    f"""{_INTERVALS}, ms AS (SELECT log_id, row_no, CAST(floor(t * 1000 + 0.5) AS BIGINT) AS ms, channel, value FROM normal),
    span AS (SELECT log_id, min(ms) AS t0, max(ms) AS t1, (max(ms) - min(ms)) // {HOUR} AS n FROM ms GROUP BY log_id),
    last AS (SELECT m.log_id, m.channel, least((m.ms - t0) // {HOUR}, n) AS a, max_by(m.value, m.row_no) AS value, max_by(m.ms, m.row_no) AS ms, any_value(t0) AS t0, any_value(t1) AS t1, any_value(n) AS n
      FROM ms m JOIN span s ON s.log_id = m.log_id WHERE m.value IS NOT NULL GROUP BY 1, 2, 3),
    stands AS (SELECT l.*, CAST(floor(h.hold * 1000 + 0.5) AS BIGINT) AS hold, coalesce(lead(a) OVER (PARTITION BY l.log_id, l.channel ORDER BY a) - 1, n) AS z FROM last l JOIN hold h ON h.log_id = l.log_id AND h.channel = l.channel),
    grid AS (SELECT *, unnest(range(a, z + 1)) AS k FROM stands), named AS (SELECT *, CASE WHEN k = n THEN t1 ELSE t0 + k * {HOUR} END AS label FROM grid)
    SELECT log_id, k, label / 1000 AS t, channel, value FROM named WHERE label - ms <= hold""",
)
def _(spark, d):
    return align.resample_hold(align.normalize_time(sparse_log(spark, d)), step_ms=HOUR)


@query(
    "resample_report",
    f"""SELECT log_id, count(*) AS from_rows, CAST((max(ms) - min(ms)) // {HOUR} + 1 AS BIGINT) AS to_rows, {half('((max(ms) - min(ms)) / 1000)', 2)} AS duration
    FROM (SELECT log_id, CAST(floor(t * 1000 + 0.5) AS BIGINT) AS ms FROM normal) GROUP BY log_id""",
)
def _(spark, d):
    return align.resample_report(align.normalize_time(sparse_log(spark, d)), step_ms=HOUR)


@query(
    "channel_summary",
    f"""SELECT log_id, channel, count(*) AS n, min(value) AS lo, max(value) AS hi, {half('(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value))', 4)} AS mean FROM sparse GROUP BY log_id, channel""",
)
def _(spark, d):
    from dynofleet.operators.report import channel_summary

    return channel_summary(sparse_log(spark, d))
