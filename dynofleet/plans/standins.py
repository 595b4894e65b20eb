"""The shared tables as engine data. They hold none: each mapping is ours, one place for all queries.

lineitem plays dense logs (one per supplier), events sparse logs (one per user), text tables play
log text and images, orders and customers play revisions and vehicles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dynofleet.operators.trims import Filters

#: Neighbouring rows of the stand-in are unrelated, so the steady-state guard is wide.
WIDE = Filters(max_tps_delta=50.0, max_rpm_delta=2500.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id = supplier; rows in order of ship date, order, line and part."""
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    part = F.col("l_partkey")
    mod = lambda n: (part % n).cast("double")
    trims = part % 17 != 0
    return rows.select(
        F.col("l_suppkey").alias("log_id"),
        F.row_number().over(w).cast("long").alias("row_no"),
        (F.col("l_quantity") * 100).alias("rpm"),
        F.floor(F.col("l_extendedprice") / 10).cast("double").alias("maf_hz"),
        F.when(trims, (F.col("l_discount") - 0.05) * 100).alias("ltft"),
        F.when(trims, (F.col("l_tax") - 0.04) * 100).alias("stft"),
        (F.lit(120.0) + mod(100)).alias("ect"),
        (F.lit(60.0) + mod(80)).alias("iat"),
        mod(100).alias("tps"),
        (F.lit(20.0) + mod(80)).alias("map"),
        (F.col("l_returnflag") == "R").alias("pe"),
        (F.col("l_linestatus") == "O").alias("closed_loop"),
        F.greatest(F.lit(0.0), mod(50) - 44).alias("knock_retard"),
        (F.lit(10.0) + mod(30)).alias("spark"),
        (F.lit(14.7) - F.col("l_discount") * 20).alias("commanded_afr"),
        (F.lit(14.7) - F.col("l_discount") * 20 + (F.col("l_tax") - 0.04) * 10).alias("wideband_afr"),
        (F.col("l_quantity") / 5).alias("ipw"),
    )


#: The same mapping for the SQL side.
DENSE_SQL = """
log AS (SELECT l_suppkey AS log_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS row_no,
  l_quantity * 100 AS rpm, floor(l_extendedprice / 10) AS maf_hz,
  CASE WHEN l_partkey % 17 <> 0 THEN (l_discount - CAST(0.05 AS DOUBLE)) * 100 END AS ltft,
  CASE WHEN l_partkey % 17 <> 0 THEN (l_tax - CAST(0.04 AS DOUBLE)) * 100 END AS stft,
  CAST(120 + l_partkey % 100 AS DOUBLE) AS ect, CAST(60 + l_partkey % 80 AS DOUBLE) AS iat,
  CAST(l_partkey % 100 AS DOUBLE) AS tps, CAST(20 + l_partkey % 80 AS DOUBLE) AS map,
  l_returnflag = 'R' AS pe, l_linestatus = 'O' AS closed_loop,
  CAST(greatest(0, l_partkey % 50 - 44) AS DOUBLE) AS knock_retard, CAST(10 + l_partkey % 30 AS DOUBLE) AS spark,
  CAST(14.7 AS DOUBLE) - l_discount * 20 AS commanded_afr,
  CAST(14.7 AS DOUBLE) - l_discount * 20 + (l_tax - CAST(0.04 AS DOUBLE)) * 10 AS wideband_afr,
  l_quantity / 5 AS ipw
  FROM lineitem),
classified AS (SELECT *, CASE WHEN ltft IS NULL AND stft IS NULL THEN NULL ELSE coalesce(ltft, 0) + coalesce(stft, 0) END AS total,
  CASE WHEN rpm < 500 THEN 'notRunning' WHEN ect < 160 THEN 'cold' WHEN NOT closed_loop THEN 'openLoop' WHEN pe THEN 'powerEnrich'
    WHEN d_tps > 50 OR d_rpm > 2500 THEN 'transient' WHEN ltft IS NULL AND stft IS NULL THEN 'noTrimData' END AS reason
  FROM (SELECT *, abs(tps - lag(tps) OVER w) AS d_tps, abs(rpm - lag(rpm) OVER w) AS d_rpm FROM log WINDOW w AS (PARTITION BY log_id ORDER BY row_no))),
kept AS (SELECT * FROM classified WHERE reason IS NULL),
mix AS (SELECT *, wideband_afr / CAST(14.7 AS DOUBLE) AS wb, commanded_afr / CAST(14.7 AS DOUBLE) AS cmd FROM log)
"""


def half_away_sql(x: str, places: int = 0) -> str:
    scale = f"CAST(1{'0' * places} AS DOUBLE)"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale} + 0.0)"


def mean_sql(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / count({x}))"


def step_sql(x: str, width: int) -> str:
    return f"(floor({x} / CAST({width} AS DOUBLE)) * CAST({width} AS DOUBLE))"


def sparse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id = user; samples in order of time; channels are event types.

    Restarts and corrupt stamps are put in by formula: time begins anew with every 20th row of a
    log, and every 37th row is 10^9 s late.
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    session = Window.partitionBy("user_id", F.floor((F.col("row_no") - 1) / 20))
    rows = e.select("user_id", F.row_number().over(w).cast("long").alias("row_no"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("raw"), "event_type", "value")
    late = F.when(F.col("row_no") % 37 == 0, 1e9).otherwise(0.0)
    return rows.select(F.col("user_id").alias("log_id"), "row_no", (F.col("raw") - F.min("raw").over(session) + late).alias("t"), F.col("event_type").alias("channel"), "value")


SPARSE_SQL = """
numbered AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_no, epoch_us(ts) / 1000000 AS raw, event_type AS channel, value FROM events),
sparse AS (SELECT log_id, row_no, raw - min(raw) OVER (PARTITION BY log_id, (row_no - 1) // 20) + CASE WHEN row_no % 37 = 0 THEN CAST(1000000000 AS DOUBLE) ELSE 0 END AS t, channel, value FROM numbered),
gaps AS (SELECT log_id, t - lag(t) OVER (PARTITION BY log_id ORDER BY row_no) AS g FROM sparse),
med AS (SELECT log_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY g DESC) AS m FROM gaps WHERE g > 0 GROUP BY log_id),
walk AS (SELECT s.log_id, s.row_no, s.t AS p, CAST(0 AS DOUBLE) AS off, 1 AS sessions, 0 AS dropped, TRUE AS ok, s.t FROM sparse s WHERE row_no = 1
  UNION ALL
  SELECT s.log_id, s.row_no, CASE WHEN s.t - w.p > greatest(60, m.m * 1000) THEN w.p ELSE s.t END,
    CASE WHEN s.t < w.p THEN w.off + w.p + m.m - s.t ELSE w.off END,
    CASE WHEN s.t < w.p THEN w.sessions + 1 ELSE w.sessions END,
    CASE WHEN s.t - w.p > greatest(60, m.m * 1000) THEN w.dropped + 1 ELSE w.dropped END,
    NOT s.t - w.p > greatest(60, m.m * 1000), s.t
  FROM walk w JOIN sparse s ON s.log_id = w.log_id AND s.row_no = w.row_no + 1 JOIN med m ON m.log_id = w.log_id),
normal AS (SELECT w.log_id, w.row_no, sign(w.t + w.off) * floor(abs(w.t + w.off) * CAST(1000 AS DOUBLE) + 0.5) / CAST(1000 AS DOUBLE) + 0.0 AS t, s.channel, s.value FROM walk w JOIN sparse s USING (log_id, row_no) WHERE w.ok)
"""
