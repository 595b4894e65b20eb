"""Queries over the dense stand-in log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dynofleet.operators import knock, mixture, trims
from dynofleet.plans.standins import DENSE_SQL, WIDE, dense_log, half_away_sql as half, mean_sql as mean, step_sql as step

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {DENSE_SQL} {sql}"
        return f

    return keep


def classified(spark, d):
    return trims.classify_rows(dense_log(spark, d), WIDE)


def kept(spark, d):
    return trims.kept_rows(classified(spark, d))


def mix(spark, d):
    return mixture.as_lambda(dense_log(spark, d))


@query("sample_deltas", "SELECT log_id, row_no, d_tps, d_rpm FROM classified")
def _(spark, d):
    return trims.sample_deltas(dense_log(spark, d)).select("log_id", "row_no", "d_tps", "d_rpm")


@query("classify_rows", "SELECT log_id, row_no, coalesce(reason, 'kept') AS reason FROM classified")
def _(spark, d):
    return classified(spark, d).select("log_id", "row_no", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("derived_trims", f"SELECT log_id, row_no, {half('total', 4)} AS total FROM classified WHERE total IS NOT NULL")
def _(spark, d):
    from dynofleet.functions.numbers import half_away

    return trims.derived_trims(dense_log(spark, d)).filter("total is not null").select("log_id", "row_no", half_away(F.col("total"), 4).alias("total"))


_REASONS = ", ".join(f"count(*) FILTER (reason = '{r}') AS \"{r}\"" for r in trims.REASONS)


@query("rejection_tally", f"SELECT log_id, {_REASONS}, count(*) FILTER (reason IS NULL) AS kept, count(*) AS total FROM classified GROUP BY log_id")
def _(spark, d):
    return trims.rejection_tally(classified(spark, d))


@query("quality_summary", "SELECT count(*) AS logs, sum(n) AS total_rows, sum(k) AS kept_rows, count(*) FILTER (k = 0) AS unusable_logs FROM (SELECT log_id, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (reason IS NULL) AS k FROM classified GROUP BY log_id)")
def _(spark, d):
    from dynofleet.operators.report import quality_summary

    return quality_summary(trims.rejection_tally(classified(spark, d)))


def _bins_sql(axis: str, width: int) -> str:
    return f"""SELECT log_id, bin_from, bin_from + {width} AS bin_to, n, {half('l', 2)} AS avg_ltft, {half('s', 2)} AS avg_stft, {half('t', 2)} AS avg_total,
      {half('t', 1)} AS suggested_pct, {half('((100 + t) / 100)', 4)} AS multiplier, n >= 20 AS enough_data
      FROM (SELECT log_id, {step(axis, width)} AS bin_from, count(*) AS n, {mean('ltft')} AS l, {mean('stft')} AS s, {mean('total')} AS t FROM kept GROUP BY ALL)"""


@query("maf_bins", _bins_sql("maf_hz", 500))
def _(spark, d):
    return trims.axis_bins(kept(spark, d))


@query("axis_bins", _bins_sql("rpm", 1000))
def _(spark, d):
    return trims.axis_bins(kept(spark, d), "rpm", 1000.0)


@query("trim_heatmap", f"SELECT log_id, {step('rpm', 500)} AS x, {step('map', 10)} AS y, count(*) AS n, {half(mean('total'), 2)} AS avg_total, count(*) >= 5 AS enough_data FROM kept GROUP BY ALL")
def _(spark, d):
    return trims.trim_heatmap(kept(spark, d))


@query(
    "formula_columns",
    f"""SELECT log_id, row_no, {half('(ipw * rpm / 1200)', 3)} AS duty_cycle, {half('(ltft + stft)', 3)} AS total_trim, {half('((100 + ltft + stft) / 100)', 3)} AS maf_multiplier,
    {half('((wideband_afr - commanded_afr) / commanded_afr * 100)', 3)} AS afr_error FROM log""",
)
def _(spark, d):
    from dynofleet.functions.numbers import half_away

    out = trims.formula_columns(dense_log(spark, d), trims.FORMULAS)
    return out.select("log_id", "row_no", *(half_away(F.col(c), 3).alias(c) for c in trims.FORMULAS))


@query("pe_proxy", "SELECT log_id, count(*) AS n, count(*) FILTER (commanded_afr / CAST(14.7 AS DOUBLE) < CAST(0.98 AS DOUBLE)) AS rich FROM log GROUP BY log_id")
def _(spark, d):
    log = dense_log(spark, d)
    seen = trims.classify_rows(log, WIDE, set(log.columns) - {"pe", "closed_loop"}, "afr")
    return seen.groupBy("log_id").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "powerEnrich").alias("rich"))


@query(
    "detect_scale",
    """, first AS (SELECT log_id, wideband_afr AS v, row_number() OVER (PARTITION BY log_id ORDER BY row_no) AS k FROM log),
    m AS (SELECT log_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS median FROM first WHERE k <= 400 GROUP BY log_id)
    SELECT log_id, median, CASE WHEN median > 5 THEN 'afr' ELSE 'ratio-ambiguous' END AS scale FROM m""",
)
def _(spark, d):
    from dynofleet.functions.units import detect_scale

    m = mixture.scale_sample(dense_log(spark, d), "wideband_afr")
    return m.select("log_id", "median", detect_scale(F.lit("MPVI2.1 -> AEM 30"), F.col("median"))["scale"].alias("scale"))


@query("to_lambda", f"SELECT log_id, row_no, {half('wb', 6)} AS wb, {half('cmd', 6)} AS cmd FROM mix")
def _(spark, d):
    from dynofleet.functions.numbers import half_away

    return mix(spark, d).select("log_id", "row_no", half_away(F.col("wb"), 6).alias("wb"), half_away(F.col("cmd"), 6).alias("cmd"))


_WOT = "wb IS NOT NULL AND rpm IS NOT NULL AND (pe OR tps >= 80)"


@query(
    "wot_bins",
    f"""SELECT log_id, rpm_from, n, {half('w', 3)} AS avg_lambda, {half('(w * CAST(14.7 AS DOUBLE))', 2)} AS avg_afr, {half('c', 3)} AS commanded_lambda, {half('(c * CAST(14.7 AS DOUBLE))', 2)} AS commanded_afr,
    {half('((w / c - 1) * 100)', 1)} AS error_pct, {half('top', 3)} AS leanest_lambda, w > 1.0 AS lean
    FROM (SELECT log_id, {step('rpm', 500)} AS rpm_from, count(*) AS n, {mean('wb')} AS w, {mean('cmd')} AS c, max(wb) AS top FROM mix WHERE {_WOT} GROUP BY ALL)""",
)
def _(spark, d):
    return mixture.wot_bins(mix(spark, d))


@query(
    "wot_summary",
    f""", r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY wb DESC, row_no) AS k, count(*) OVER (PARTITION BY log_id) AS n, count(*) FILTER (wb > 1.0) OVER (PARTITION BY log_id) AS lean FROM mix WHERE {_WOT})
    SELECT log_id, n AS wot_samples, lean AS lean_samples, {half('wb', 3)} AS worst_lambda, rpm AS worst_rpm, tps AS worst_tps, {half('cmd', 3)} AS worst_commanded FROM r WHERE k = 1""",
)
def _(spark, d):
    return mixture.wot_summary(mix(spark, d))


@query(
    "closed_loop_check",
    f"""SELECT log_id, n AS samples, {half('w', 3)} AS measured_lambda, {half('c', 3)} AS commanded_lambda, {half('(w * CAST(14.7 AS DOUBLE))', 2)} AS measured_afr, {half('(c * CAST(14.7 AS DOUBLE))', 2)} AS commanded_afr, {half('((w / c - 1) * 100)', 1)} AS error_pct
    FROM (SELECT log_id, count(*) AS n, {mean('wb')} AS w, {mean('cmd')} AS c FROM mix WHERE closed_loop AND NOT pe GROUP BY log_id HAVING count(*) >= 20)""",
)
def _(spark, d):
    return mixture.closed_loop_check(mix(spark, d))


@query("knock_map", f"SELECT log_id, {step('rpm', 500)} AS x, {step('map', 10)} AS y, count(*) AS n, {half('max(knock_retard)', 2)} AS max_kr, count(*) FILTER (knock_retard >= 0.1) AS hits FROM log WHERE rpm >= 500 GROUP BY log_id, 2, 3")
def _(spark, d):
    return knock.knock_map(dense_log(spark, d))


@query("spark_map", f"SELECT log_id, {step('rpm', 500)} AS x, {step('map', 10)} AS y, count(*) AS n, {half(mean('spark'), 1)} AS avg_advance, {half('max(spark)', 1)} AS max_advance FROM log WHERE rpm >= 500 GROUP BY log_id, 2, 3")
def _(spark, d):
    return knock.spark_map(dense_log(spark, d))


_EVENTS = f""", marked AS (SELECT *, rpm >= 500 AND knock_retard >= 0.1 AS hit FROM log),
isles AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY row_no) AS isle FROM marked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY log_id, isle ORDER BY knock_retard DESC, row_no) AS by_kr, row_number() OVER (PARTITION BY log_id, isle ORDER BY row_no) AS by_row FROM isles WHERE hit),
events_found AS (SELECT log_id, min(row_no) AS start_row, count(*) AS samples, {half('max(knock_retard)', 2)} AS peak_kr, max(rpm) FILTER (by_kr = 1) AS rpm, min(rpm) AS rpm_min, max(rpm) AS rpm_max,
  max(map) FILTER (by_kr = 1) AS load, max(iat) FILTER (by_kr = 1) AS iat, max(ect) FILTER (by_row = 1) AS ect, max(tps) FILTER (by_row = 1) AS tps, max(spark) FILTER (by_kr = 1) AS spark_at_peak, max(tps) FILTER (by_row = 1) < 25 AS suspect_false
  FROM ranked GROUP BY log_id, isle)"""


@query("knock_events", f"{_EVENTS} SELECT * FROM events_found")
def _(spark, d):
    return knock.knock_events(dense_log(spark, d))


@query("top_knock_events", f"{_EVENTS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY peak_kr DESC, start_row) AS INTEGER) AS rank FROM events_found) WHERE rank <= 25")
def _(spark, d):
    return knock.top_knock_events(knock.knock_events(dense_log(spark, d)))


@query(
    "spark_summary",
    f"""{_EVENTS}, worst AS (SELECT log_id, knock_retard, rpm, row_number() OVER (PARTITION BY log_id ORDER BY knock_retard DESC, row_no) AS k FROM marked WHERE hit)
    SELECT r.log_id, r.n AS running_samples, r.h AS knock_samples, coalesce(e.n, 0) AS event_count, {half('w.knock_retard', 2)} AS worst_kr, w.rpm AS worst_rpm
    FROM (SELECT log_id, count(*) AS n, count(*) FILTER (hit) AS h FROM marked WHERE rpm >= 500 GROUP BY log_id) r LEFT JOIN (SELECT log_id, count(*) AS n FROM events_found GROUP BY log_id) e USING (log_id) LEFT JOIN worst w ON w.log_id = r.log_id AND w.k = 1""",
)
def _(spark, d):
    log = dense_log(spark, d)
    return knock.spark_summary(log, knock.knock_events(log))
