"""Readings of dense logs, with answers known by construction."""

import pytest
from pyspark.sql import functions as F

from dynofleet.functions import units
from dynofleet.functions.equations import compile_equation
from dynofleet.operators import knock, mixture, trims

COLUMNS = "log_id string, row_no long, t double, rpm double, maf_hz double, ltft double, stft double, ect double, iat double, tps double, map double, pe boolean, closed_loop boolean, knock_retard double, spark double, commanded_afr double, wideband_afr double"


def log(spark, rows):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    full = [("log", i, i * 0.1, *(r.get(n) for n in names[3:])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


CRUISE = dict(rpm=1800.0, maf_hz=2200.0, ltft=6.0, stft=2.0, ect=95.0, tps=15.0, closed_loop=True, pe=False)


def test_warm_celsius_log_is_kept(spark):
    rows = trims.classify_rows(log(spark, [CRUISE] * 50), trims.Filters(min_ect=71.1))
    got = trims.rejection_tally(rows).first()
    assert (got.kept, got.total, got.cold) == (50, 50, 0)
    b = trims.axis_bins(trims.kept_rows(rows)).first()
    assert (b.bin_from, b.bin_to, b.n, b.avg_total, b.suggested_pct, b.multiplier, b.enough_data) == (2000.0, 2500.0, 50, 8.0, 8.0, 1.08, True)


def test_cold_log_is_rejected(spark):
    got = trims.rejection_tally(trims.classify_rows(log(spark, [CRUISE | {"ect": 40.0}] * 50), trims.Filters(min_ect=71.1))).first()
    assert (got.kept, got.cold) == (0, 50)


def test_guards_apply_in_order_and_only_where_a_channel_exists(spark):
    rows = [CRUISE, CRUISE | {"rpm": 400.0, "ect": 0.0}, CRUISE | {"closed_loop": False, "pe": True, "rpm": 400.0 + 500}, CRUISE | {"pe": True}, CRUISE | {"tps": 40.0}, CRUISE | {"ltft": None, "stft": None, "tps": 40.0}]
    table = log(spark, rows)
    got = [r.reason for r in trims.classify_rows(table, trims.Filters(min_ect=71.1)).orderBy("row_no").collect()]
    assert got == [None, "notRunning", "openLoop", "powerEnrich", "transient", "noTrimData"]
    loose = trims.classify_rows(table, trims.Filters(min_ect=None), {"rpm", "ltft", "stft", "tps"})
    assert loose.filter("reason = 'openLoop' or reason = 'powerEnrich' or reason = 'cold'").count() == 0


def test_pe_proxy(spark):
    rows = [CRUISE | {"commanded_afr": 12.5}, CRUISE | {"commanded_afr": 14.7}]
    got = trims.classify_rows(log(spark, rows), trims.Filters(), {"rpm", "tps", "ltft", "stft"}, "afr")
    assert [r.reason for r in got.orderBy("row_no").collect()] == ["powerEnrich", None]


def test_wideband_finds_the_lean_end(spark):
    cruise = CRUISE | {"commanded_afr": 14.7, "wideband_afr": 14.7}
    wot = CRUISE | {"tps": 95.0, "closed_loop": False, "pe": True, "commanded_afr": 12.5}
    rows = [cruise] * 40 + [wot | {"rpm": 3000.0, "wideband_afr": 12.5}] * 20 + [wot | {"rpm": 5500.0, "wideband_afr": 15.4}] * 20
    mix = mixture.as_lambda(log(spark, rows))
    one, two = mixture.wot_bins(mix).orderBy("rpm_from").collect()
    assert (one.error_pct, one.lean, two.lean) == (0.0, False, True)
    assert two.error_pct > 20
    s = mixture.wot_summary(mix).first()
    assert (s.wot_samples, s.lean_samples, s.worst_rpm) == (40, 20, 5500.0)
    c = mixture.closed_loop_check(mix).first()
    assert (c.samples, c.error_pct) == (40, 0.0)
    e85 = mixture.as_lambda(log(spark, rows), "e85").agg(F.max("wb")).first()[0]
    assert e85 == pytest.approx(15.4 / 9.765)


def test_knock_events(spark):
    base = dict(rpm=1500.0, map=40.0, spark=28.0, tps=15.0, iat=100.0, ect=200.0, knock_retard=0.0)
    load = base | {"rpm": 4500.0, "map": 95.0, "spark": 18.0, "tps": 90.0, "iat": 140.0}
    run = [load | {"knock_retard": k, "iat": i} for k, i in ((2.0, 141.0), (4.5, 143.0), (3.0, 144.0))]
    rows = [base] * 40 + [load] * 20 + run + [load] * 10 + [base | {"knock_retard": 1.5, "tps": 8.0}] + [load] * 5 + [load | {"knock_retard": 2.5}]
    table = log(spark, rows)
    events = knock.knock_events(table)
    first, blip, last = events.orderBy("start_row").collect()
    assert (first.samples, first.peak_kr, first.rpm, first.iat, first.suspect_false) == (3, 4.5, 4500.0, 143.0, False)
    assert blip.suspect_false and not last.suspect_false
    s = knock.spark_summary(table, events).first()
    assert (s.event_count, s.knock_samples, s.worst_kr, s.worst_rpm) == (3, 5, 4.5, 4500.0)
    cell = knock.knock_map(table).filter("x = 4500 and y = 90").first()
    assert cell.max_kr == 4.5
    assert knock.spark_map(table).filter("x = 1500").first().avg_advance == 28.0
    assert [e.peak_kr for e in knock.top_knock_events(events, 2).orderBy("rank").collect()] == [4.5, 2.5]


@pytest.mark.parametrize(
    ("value", "unit", "to", "want"),
    [(160.0, "°F", "°C", 71.1111), (100.0, "°C", "°F", 212.0), (1.0, "psi", "kPa", 6.894757293168361), (101.325, "kPa", "psi", 14.6959), (1.0, "lb/min", "g/s", 7.559873), (60.0, "mph", "km/h", 96.56064), (1.0, "bar", "kPa", 100.0)],
)
def test_conversions_and_round_trips(spark, value, unit, to, want):
    row = spark.range(1).select(units.convert(F.lit(value), F.lit(unit), F.lit(to)).alias("a")).select("a", units.convert(F.col("a"), F.lit(to), F.lit(unit)).alias("b")).first()
    assert row.a == pytest.approx(want, abs=1e-4) and row.b == pytest.approx(value)


def test_deltas_errors_and_blank_units(spark):
    one = spark.range(1)
    assert one.select(units.convert_delta(F.lit(10.0), F.lit("°F"), F.lit("°C"))).first()[0] == pytest.approx(5.5556, abs=1e-4)
    assert one.select(units.convert(F.lit(10.0), F.lit("°F"), F.lit("°C"))).first()[0] == pytest.approx(-12.2222, abs=1e-4)
    assert one.select(units.convert(F.lit(5.0), F.lit(""), F.lit("kPa"))).first()[0] == 5.0
    with pytest.raises(Exception, match="cannot convert"):
        one.select(units.convert(F.lit(5.0), F.lit("°F"), F.lit("kPa"))).collect()


def test_units_from_headers(spark):
    want = {"ECT (F)": "°F", "MAF Frequency (Hz)": "Hz", "Bank": None, "X [λ]": "λ", "Boost (psig)": "psi", "Odd (furlong)": "furlong", "a (kPa) b (V)": "V", "Airflow (lb/min)": "lb/min"}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: r.u for r in df.select("h", units.detect_unit(F.col("h")).alias("u")).collect()} == want
    shown = spark.range(1).select(units.format_value(F.lit(12.50), F.lit("kPa")), units.format_value(F.lit(100.0), F.lit(None).cast("string"), 0), units.format_value(F.lit(None).cast("double"), F.lit("s"))).first()
    assert tuple(shown) == ("12.5 kPa", "100", "—")


def test_mixture_scale(spark):
    cases = [("WB EQ Ratio 1 [λ]", None, ("lambda", "unit", True)), ("AEM 30", 14.6, ("afr", "magnitude", False)), ("AEM 30", 0.99, ("ratio-ambiguous", "magnitude", False)), ("Commanded EQ", 1.0, ("eq", "name", False)), ("x", None, (None, "no numeric samples", False))]
    df = spark.createDataFrame([(i, h, m) for i, (h, m, _) in enumerate(cases)], "i int, h string, m double")
    got = {r.i: tuple(r.s) for r in df.select("i", units.detect_scale(F.col("h"), F.col("m")).alias("s")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


@pytest.mark.parametrize(("text", "x", "want"), [("X*0.0078125", 128, 1), ("(X-128)*0.5", 138, 5), ("X/4+10", 40, 20), ("-X+5", 2, 3), ("", 7, 7), ("X^2", 3, 9), ("1/X", 0, 0), ("2*-X", 3, -6), ("-X^2", 3, -9)])
def test_equations(spark, text, x, want):
    assert spark.range(1).select(compile_equation(text, F.lit(float(x)))).first()[0] == pytest.approx(want)


def test_bad_equations():
    for text in ("X+", "(X", "X $ 2", "2 X"):
        with pytest.raises(ValueError, match="equation"):
            compile_equation(text, F.lit(1.0))
