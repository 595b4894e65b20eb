"""The whole analysis on logs that differ in channels and units: each is judged by its own."""

from dynofleet.operators.analysis import analyze
from dynofleet.operators.trims import Filters
from dynofleet.sources.logs import parse_logs

F95C = "95"


def log(header: str, rows: list[str]) -> str:
    return "\n".join([header, *rows])


def logs_of(spark):
    steady = range(30)
    base = "Engine Speed (RPM),MAF Frequency (Hz),LTFT Bank 1 (%),LTFT Bank 2 (%),STFT Bank 1 (%),TPS (%),MAP (kPa)"
    values = "1500,2100,2,4,1,20,50"
    texts = {
        "celsius": log(f"{base},Engine Coolant Temp (degC),Closed Loop", [f"{values},{F95C},1" for _ in steady]),
        "no_flag": log(f"{base},ECT (F)", [f"{values},200" for _ in steady]),
        "cold": log(f"{base},ECT (F),Closed Loop", [f"{values},{100 if i < 10 else 200},1" for i in steady]),
        "no_unit": log(f"{base},Coolant", [f"{values},20" for _ in steady]),
        "words": log(f"{base},ECT (F),Closed Loop,Power Enrich", [f"{values},200,{'Active' if i % 2 else 1},{' On' if i < 5 else 0}" for i in steady]),
        "mixture": log(f"{base},ECT (F),Wideband AFR,Commanded AFR", [f"{values},200,14.8,{12.0 if i < 8 else 14.7}" for i in steady]),
        "lambda": log(f"{base},ECT (F),Wideband [\u03bb],Commanded Lambda", [f"{values},200,1.01,{0.85 if i < 8 else 1.0}" for i in steady]),
        "dead": log(f"{base},ECT (F),Closed Loop", [f"{values},200," for _ in steady]),
        "load": log("Engine Speed (RPM),LTFT Bank 1 (%),TPS (%),Cylinder Airmass (g),ECT (F)", ["1500,2,20,0.5,200" for _ in steady]),
    }
    return analyze(*parse_logs(spark.createDataFrame(list(texts.items()), "log_id string, text string")), Filters())


def test_each_log_is_judged_by_its_own_channels_and_units(spark):
    a = logs_of(spark)
    tally = {r.log_id: r.asDict() for r in a.tally.collect()}
    kept = {k: v["kept"] for k, v in tally.items()}
    assert kept == {"celsius": 30, "no_flag": 30, "cold": 20, "no_unit": 30, "words": 25, "mixture": 22, "lambda": 22, "dead": 30, "load": 30}
    assert tally["cold"]["cold"] == 10 and tally["words"]["powerEnrich"] == 5 and tally["mixture"]["powerEnrich"] == tally["lambda"]["powerEnrich"] == 8
    settings = {r.log_id: r for r in a.settings.collect()}
    assert settings["celsius"].min_ect == 71.1 and settings["cold"].min_ect == 160.0 and settings["no_unit"].min_ect is None
    assert (settings["mixture"].pe_scale, settings["lambda"].pe_scale, settings["words"].pe_scale) == ("afr", "lambda", None)
    bins = {r.log_id: r for r in a.bins.collect()}
    assert (bins["celsius"].n, bins["celsius"].avg_ltft, bins["celsius"].avg_total) == (30, 3.0, 4.0), "banks are averaged"
    assert "load" not in bins, "it has no airflow frequency"
    assert {r.log_id: r.y for r in a.heatmap.collect()} == {k: 0.0 if k == "load" else 50.0 for k in kept}


def test_readings_and_warnings(spark):
    a = logs_of(spark)
    closed = {r.log_id: r for r in a.closed_loop.collect()}
    assert set(closed) == {"mixture", "lambda"}, "commanding stoichiometric stands for closed loop"
    assert closed["mixture"].samples == 22 and closed["mixture"].measured_afr == 14.8 and closed["lambda"].measured_lambda == 1.01
    warnings = {r.log_id: r.warnings for r in a.warnings.collect()}
    assert warnings["celsius"] == [] and len(warnings["no_unit"]) == 1 and "states no unit" in warnings["no_unit"][0]
    assert any("Closed Loop" in w and "no samples" in w for w in warnings["dead"])
    assert any("Commanded AFR" in w and "enrichment" in w for w in warnings["mixture"])
    missing = {(r.log_id, r.role) for r in a.missing.collect()}
    assert ("dead", "closed_loop") in missing and ("celsius", "closed_loop") not in missing and ("load", "maf_hz") in missing


HEAD = "HP Tuners CSV Log File\nVersion: 1.0\n\n[Channel Information]\n{ids}\n{names}\n{units}\n\n[Channel Data]\n"


def sectioned(rows: list[str], names="Offset,Engine RPM (SAE),Short Term Fuel Trim Bank 1 (SAE),Mass Airflow Sensor,Engine Coolant Temp (SAE)", units="s,rpm,%,Hz,°F", ids="0,12,6,2301,5") -> str:
    return HEAD.format(ids=ids, names=names, units=units) + "\n".join(rows)


def interval_logs(spark, step_ms: int = 100):
    in_turn = [f"{i / 10:.1f}," + ",".join(v if i % 4 == k else "" for k, v in enumerate((str(1500 + i % 3), "-5", "3200", "190"))) for i in range(400)]
    flagged = "Offset,Engine RPM (SAE),Short Term Fuel Trim Bank 1 (SAE),Mass Airflow Sensor,Engine Coolant Temp (SAE),Fuel System #1 Status (SAE)"
    silent = [f"{i / 10:.1f},{800 + i % 3},-5,3200,190," for i in range(60)]
    words = [f"{i / 10:.1f},{1500 if i % 2 else ''},{'' if i % 2 else -5},{'' if i % 2 else 3200},{190 if i % 2 else ''},{('1' if i == 0 else 'On' if i < 40 else 'Off') if i % 2 == 0 else ''}" for i in range(80)]
    twice = [f"{i / 10:.1f},{800 + i},-5,3200,190" for i in range(50)] + ["16778.048,900,-5,3200,190"] + [f"{i / 10:.1f},{900 + i},-6,3300," for i in range(50)] + ["9.0,,,,", "9.1,,,,190"]
    texts = {
        "turns": sectioned(in_turn),
        "silent": sectioned(silent, flagged, "s,rpm,%,Hz,°F,", "0,12,6,2301,5,3"),
        "words": sectioned(words, flagged, "s,rpm,%,Hz,°F,", "0,12,6,2301,5,3"),
        "twice": sectioned(twice + ["" for _ in range(3)] + [f"{9.2 + i / 10:.1f},,-6,,"[:99] for i in range(60)]),
        "dense": log("Engine Speed (RPM),MAF Frequency (Hz),LTFT Bank 1 (%),STFT Bank 1 (%),TPS (%),MAP (kPa),ECT (F),Closed Loop", ["1500,2100,2,1,20,50,200,1" for _ in range(30)]),
    }
    return analyze(*parse_logs(spark.createDataFrame(list(texts.items()), "log_id string, text string")), Filters(), step_ms=step_ms)


def test_interval_logs_are_put_on_a_grid(spark):
    a = interval_logs(spark)
    tally = {r.log_id: r.asDict() for r in a.tally.collect()}
    assert tally["turns"]["total"] == 400 and tally["turns"]["kept"] > 380, "400 rows of one channel each give bins"
    bins = {r.log_id: r for r in a.bins.collect()}
    assert bins["turns"].bin_from == 3000 and bins["turns"].avg_stft == -5.0 and bins["turns"].enough_data
    assert tally["silent"]["kept"] > 0 and tally["silent"]["openLoop"] == 0
    assert ("silent", "closed_loop") in {(r.log_id, r.role) for r in a.silent.collect()}
    assert any("no samples" in w for r in a.warnings.filter("log_id = 'silent'").collect() for w in r.warnings)
    assert 30 <= tally["words"]["openLoop"] <= 40 and 30 <= tally["words"]["kept"] <= 41, "words are held like numbers"
    assert tally["dense"]["kept"] == tally["dense"]["total"] == 30
    report = {r.log_id: r for r in a.resampled.collect()}
    assert set(report) == {"turns", "silent", "words", "twice"}
    assert (report["twice"].sessions, report["twice"].dropped, len(report["twice"].boundaries)) == (2, 1, 1)
    assert (report["turns"].from_rows, report["turns"].to_rows, report["turns"].duration) == (400, 400, 39.9)
    empty = {(r.log_id, r.header) for r in a.empty.collect()}
    assert ("silent", "Fuel System #1 Status (SAE)") in empty and not any(e[0] == "turns" for e in empty)


def test_the_report_tells_what_was_done(spark):
    from dynofleet.operators.report import report_text, submission_report
    from dynofleet.sources.tables import shared_folder

    a = interval_logs(spark)
    channels, _ = parse_logs(spark.createDataFrame([("turns", sectioned(["0.0,1,,,", "0.1,,1,,", "0.2,,,1,"])), ("twice", sectioned(["0,1,1,1,1"])), ("dense", log("Engine Speed (RPM)", ["1500"]))], "log_id string, text string"))
    texts = {r.log_id: r.text for r in report_text(submission_report(channels, a)).collect()}
    assert "- resampled: 400 to 400 rows every 100 ms" in texts["turns"] and "sessions" not in texts["turns"]
    assert "- sessions: 2" in texts["twice"] and "- corrupt stamps dropped: 1" in texts["twice"]
    assert "resampled" not in texts["dense"] and "- rows usable: 30 of 30" in texts["dense"]
    before = len(list(__import__("pathlib").Path(shared_folder(spark).removeprefix("file://")).glob("table-*")))
    taken = a.take("tally")
    after = len(list(__import__("pathlib").Path(shared_folder(spark).removeprefix("file://")).glob("table-*")))
    assert taken.count() == 5 and after < before, "what was written on the way is gone"


def test_rows_in_arrays_give_what_samples_give(spark):
    """Dense logs are never taken apart into cells; the analysis of both forms is the same, odd cells are read as the built-ins read them."""
    from pyspark.sql import functions as F

    from dynofleet.sources import logs

    odd = ["1", " -2.50 ", '"3"', '"', "", "+4", "5.", ".5", "1e3", "-1.5E-2x", "7 rpm", "nan", "Infinity", "0x10", "٣", "1_0", "--1", '""6""', "12345678901234567890.125", "1d", "\t8", "Off", '9"\r', "1e400"]
    body = [",".join(odd[i:] + odd[:i]) for i in range(len(odd))] + ["", "1,2"]
    plain = "\n".join([",".join(["Time", "Engine RPM", "LTFT Bank 1", "LTFT Bank 2", "STFT", "MAF Hz", "ECT (F)"] + [f"c{i}" for i in range(len(odd) - 7)]), *body])
    sect = "HP Tuners CSV Log File\n\n[Channel Information]\n1,2\nOffset,Engine RPM\ns,rpm\n\n[Channel Data]\n0,900\n0.1,\n0.2,\n0.3,\n"
    texts = spark.createDataFrame([("p", plain), ("s", sect)], "log_id string, text string")
    lines = logs.log_lines(texts)
    channels, rows = logs.parse_rows(lines)
    samples = logs.cells_of(rows)
    value = logs.number_of(F.col("cell"))
    cut = lines.filter("log_id = 'p' and line_no > 0 and trim(line) <> ''").select(F.posexplode(logs.split_fields(F.col("line"))).alias("ordinal", "cell"))
    wanted = sorted(map(tuple, cut.select("ordinal", value, F.when(value.isNull(), F.col("cell"))).collect()), key=str)
    assert sorted(map(tuple, samples.filter("log_id = 'p'").select("ordinal", "value_num", "value_str").collect()), key=str) == wanted
    mild = [x for x in odd if x not in ("12345678901234567890.125", "1e400")]  # trims are summed as decimals
    mild_text = plain.split("\n")[0] + "\n" + "\n".join(",".join(mild[i:] + mild[:i]) for i in range(len(mild)))
    channels, rows = logs.parse_rows(logs.log_lines(spark.createDataFrame([("p", mild_text), ("s", sect)], "log_id string, text string")))
    samples = logs.cells_of(rows)
    one, two = analyze(channels, rows), analyze(channels, samples)
    for name in ("rows", "tally", "empty", "missing", "resampled", "warnings"):
        a, b = (sorted(map(str, getattr(x, name).select(*getattr(one, name).columns).collect())) for x in (one, two))
        assert a == b, name
    assert one.rows.filter("log_id = 'p'").count() == len(mild)


def test_rows_are_numbered_without_a_window_unless_other_lines_stand_between(spark):
    from dynofleet.sources import logs

    even = "Time,RPM\n1,2\n2,3\n3,4\n"
    lines = lambda texts: logs.log_lines(spark.createDataFrame(texts, "log_id string, text string"))
    numbers = lambda rows: sorted((r.log_id, r.row_no, r["values"][0]) for r in rows.collect())
    _, rows = logs.parse_rows(lines([("a", even)]))
    assert numbers(rows) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)]
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    broken = "HP Tuners CSV Log File\n[Channel Information]\nOffset,RPM\n[Channel Data]\n1,2\n\n[x]\n2,3\n3,4\n"
    _, rows = logs.parse_rows(lines([("a", even), ("b", broken), ("c", "\nTime,RPM\n\n5,6\n\n7,8")]))
    assert numbers(rows) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 3.0), ("c", 1, 5.0), ("c", 2, 7.0)]
