"""Log files, images, definitions, scanner files, records and redaction."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dynofleet.operators import align, channels, history, scrub
from dynofleet.sources import definitions, files, images, logs, scanner

HEAD = "HP Tuners CSV Log File\nVersion: 1.0\n\n[Log Information]\nCreation Time: x\nNotes: seen 1ZZTEST99Z1234567\n\n[Channel Information]\n"


def sectioned(ids, names, units, rows):
    return HEAD + "\n".join(x for x in (ids, names, units) if x is not None) + "\n\n[Channel Data]\n" + "\n".join(rows) + "\n"


NAMES = "Offset,Engine RPM (SAE),Short Term Fuel Trim Bank 1 (SAE),Mass Airflow Sensor,Engine Coolant Temp (SAE)"


def parsed(spark, text):
    c, s = logs.parse_logs(spark.createDataFrame([("log", text)], "log_id string, text string"))
    return c.orderBy("ordinal"), s


def test_sectioned_log(spark):
    text = sectioned("0,12,6,2301,5", NAMES, "s,rpm,%,Hz,°F", ["0.0,800,,2200,", "0.1,,1.5,,180"])
    c, s = parsed(spark, text)
    rows = c.collect()
    assert [r.parameter_id for r in rows][1] == "12" and rows[4].header == "Engine Coolant Temp (SAE) [°F]"
    assert s.select("row_no").distinct().count() == 2
    roles = {r.role: r.ordinals for r in channels.detect_roles(c).collect()}
    assert roles["maf_hz"] == [3] and roles["ect"] == [4] and roles["stft"] == [2]
    assert channels.log_density(c, s).first().sparse
    used = channels.live_channels(c, s)
    assert channels.ect_threshold(used).first().threshold == 160.0
    assert channels.wide_log(used, s).filter("row_no = 2").first().stft == 1.5


def test_missing_ids_row_and_comma_names(spark):
    c, s = parsed(spark, sectioned(None, "Offset,MPVI2.1 -> AEM 30-(03x0,2340,5130),Engine Speed", "s,,rpm", ["0,14.6,900"]))
    assert [r.header for r in c.collect()] == ["Offset [s]", "MPVI2.1 -> AEM 30-(03x0,2340,5130)", "Engine Speed [rpm]"]
    assert s.filter("ordinal = 1").first().value_num == 14.6
    assert "wideband_afr" in {r.role for r in channels.detect_roles(c).collect()}


def test_plain_log_with_units_row(spark):
    c, s = parsed(spark, "Time,RPM,State\ns,rpm,\n0,900,idle\n0.1,950,run\n\n")
    assert [r.header for r in c.collect()] == ["Time", "RPM", "State"]
    assert {(r.row_no, r.value_num) for r in s.filter("ordinal = 1").collect()} == {(1, 900.0), (2, 950.0)}
    assert {r.value_str for r in s.filter("ordinal = 2").collect()} == {"idle", "run"}
    c, s = parsed(spark, "Time (s),ECT\n0,95\n1,96")
    assert s.filter("ordinal = 1").count() == 2
    used = channels.live_channels(c, s)
    assert channels.ect_threshold(used).first().threshold is None
    words = channels.log_warnings(used, channels.silent_channels(c, s), c).first().warnings
    assert any("no unit" in w for w in words)


def test_live_channel_wins_over_a_dead_one(spark):
    rows = [f"{i / 10},,14.6" for i in range(60)]
    c, s = parsed(spark, sectioned("0,1,2", "Offset,UEGO,AEM", "s,,", rows))
    used = {r.role: r.header for r in channels.live_channels(c, s).collect()}
    assert used["wideband_afr"] == "AEM"
    silent = channels.silent_channels(c, s).first()
    assert (silent.header, silent.superseded) == ("UEGO", "AEM")
    assert {r.header for r in channels.empty_channels(c, s).collect()} == {"UEGO"}
    assert "rpm" in {r.role for r in channels.missing_roles(c, s).collect()}


def test_restart_and_corrupt_stamp(spark):
    rows = [f"{i / 10},{900 + i}" for i in range(50)] + ["16778.048,1"] + [f"{i / 10},{950 + i}" for i in range(50)]
    c, s = parsed(spark, sectioned("0,1", "Offset,Engine RPM", "s,rpm", rows))
    timed = logs.to_timed(c, s)
    r = align.time_report(timed).first()
    assert (r.dropped, r.sessions) == (1, 2)
    out = align.normalize_time(timed)
    times = [x.t for x in out.orderBy("row_no").collect()]
    assert len(times) == 100 and times == sorted(times)
    assert align.resample_hold(out).count() > 90


def test_redaction(spark):
    text = sectioned("0,1,2,3", "Offset,RPM 1ZZTEST99Z1234567,GPS Latitude,GPS Longitude", "s,rpm,deg,deg", ["0,900,1,2", "1,901,1,2"])
    df = spark.createDataFrame([("a", text), ("b", "Time,RPM\n0,1\nAAAAAAAAAAAAAAAAA 12345678901234567890 1ZZTEST99Z123456")], "log_id string, text string")
    check = {r.log_id: r for r in scrub.scrub_check(df).collect()}
    assert check["a"].vins == 1 and check["a"].notes == 1 and check["a"].places == 2 and check["b"].clean
    out = scrub.scrub_logs(df)
    clean = {r.log_id: r.text for r in out.collect()}
    assert "1ZZTEST99Z1234567" not in clean["a"] and "Notes:\n" in clean["a"] and "GPS" not in clean["a"] and "0,900\n" in clean["a"]
    assert clean["b"] == df.filter("log_id = 'b'").first().text
    assert all(r.clean for r in scrub.scrub_check(out).collect())


def flash_image() -> np.ndarray:
    b = np.zeros(524288, np.uint8)

    def put(at, data):
        b[at : at + len(data)] = np.frombuffer(data, np.uint8)

    put(0x503, b"\x01")
    put(0x504, (12212156).to_bytes(4, "big"))
    put(0x508, b"AA")
    put(0x20000, b"NV")
    put(0x4088, b"\xa5\xa0")
    put(0x4021, b"TESTVIN1234567890")
    put(0x4008, b"SERIAL123456")
    put(0x401C, b"CODE")
    put(0x4004, (12200411).to_bytes(4, "big"))
    for s in range(7):
        start = 0x30000 + s * 0x2000
        put(0x514 + 8 * s, start.to_bytes(4, "big") + (start + 0xFFF).to_bytes(4, "big"))
        put(start + 4, (90000000 + s).to_bytes(4, "big") + b"Z" + str(s).encode())
        put(start + 0x100, bytes(range(50)))
        put(start, images.word_sum(b, (start + 2, start + 0xFFF)).to_bytes(2, "big"))
    put(0x500, images.word_sum(b, (0, 0x4FF), (0x502, 0x3FFF), (0x20000, 0x20000 + 0x5FFFE - 1)).to_bytes(2, "big"))
    return b


def test_images(spark, tmp_path):
    good = flash_image()
    bad = good.copy()
    bad[0x30100] ^= 0xFF
    for name, data in (("a.bin", good.tobytes()), ("b.bin", bad.tobytes()), ("c.bin", b"\x07" * 1000), ("d.hpt", b"x")):
        (tmp_path / name).write_bytes(data)
    raw = files.read_images(spark, str(tmp_path))
    assert raw.count() == 3
    got = {r.path[-5:]: r for r in images.analyze_images(raw).collect()}
    a, b = got["a.bin"], got["b.bin"]
    assert (a.kind, a.os_id, a.os_version, a.vin, a.serial, a.broadcast_code, a.hardware_id, a.verdict) == ("P01", 12212156, "AA", "TESTVIN1234567890", "SERIAL123456", "CODE", 12200411, "OK")
    assert len(a.segments) == 7 and all(s.ok for s in a.segments) and a.segments[2].cal_id == 90000002
    assert not b.segments[0].ok and b.verdict.endswith("FAILED")
    assert not got["c.bin"].detected
    assert {r.path[-5:]: r.d for r in raw.select("path", images.image_detect(F.col("content")).alias("d")).collect()} == {"a.bin": True, "b.bin": True, "c.bin": False}
    assert raw.filter("path like '%a.bin'").select(images.u32(F.col("content"), 0x504)).first()[0] == 12212156
    paths = sorted(r.path for r in raw.collect())
    d = images.compare_images(spark.createDataFrame([(paths[0], paths[1])], "a string, b string"), raw).first()
    assert d.total_changed == 1 and {r.name: r.changed for r in d.regions}["EngineCal"] == 1
    inventory = files.file_inventory(spark, str(tmp_path)).collect()
    assert [r.name for r in inventory] == ["d.hpt", "c.bin", "b.bin", "a.bin"] and len(inventory[0].sha256) == 64


XDF = """<XDFFORMAT version="1.60"><XDFHEADER><deftitle>t</deftitle><BASEOFFSET offset="0" subtract="0"/><CATEGORY index="0x0" name="Fuel"/><CATEGORY index="1" name="Air"/></XDFHEADER>
<XDFTABLE uniqueid="0x1"><title>MAF</title><CATEGORYMEM index="0" category="2"/>
<XDFAXIS id="x"><EMBEDDEDDATA mmedaddress="0x2000" mmedelementsizebits="16"/><indexcount>3</indexcount><decimalpl>0</decimalpl><MATH equation="X*10"><VAR id="X"/></MATH></XDFAXIS>
<XDFAXIS id="y"><indexcount>2</indexcount><LABEL index="0" value="bank1"/><LABEL index="1" value="bank2"/></XDFAXIS>
<XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x1000" mmedelementsizebits="16" mmedrowcount="2" mmedcolcount="3"/><units>g/s</units><decimalpl>2</decimalpl><MATH equation="X*0.1"><VAR id="X"/></MATH></XDFAXIS></XDFTABLE>
<XDFTABLE uniqueid="0x2"><title>Small</title><XDFAXIS id="z"><EMBEDDEDDATA mmedtypeflags="0x03" mmedaddress="0x3000" mmedelementsizebits="16" mmedrowcount="1" mmedcolcount="2"/><MATH equation="X*0.1"/></XDFAXIS></XDFTABLE>
<XDFCONSTANT uniqueid="0x9"><title>Limit</title><units>rpm</units><EMBEDDEDDATA mmedaddress="0x10" mmedelementsizebits="8"/><MATH equation="X"/></XDFCONSTANT></XDFFORMAT>"""


def test_definitions(spark):
    parsed_ = definitions.parse_definitions(spark.createDataFrame([(7, XDF)], "os_id long, text string"))
    axes = definitions.read_axes(parsed_).cache()
    z = axes.filter("axis = 'z' and table_id = '0x1'").first()
    assert (z.title, z.categories, z.address, z.bits, z.rows, z.cols) == ("MAF", ["Air"], 0x1000, 16, 2, 3)
    flags = axes.filter("table_id = '0x2'").first()
    assert flags.signed and flags.lsb_first and not flags.floating
    c = definitions.read_constants(parsed_).first()
    assert (c.id, c.title, c.units, c.address, c.bits) == ("0x9", "Limit", "rpm", 16, 8)

    def image(values):
        b = bytearray(0x4000)
        for i, v in enumerate(values):
            b[0x1000 + 2 * i : 0x1002 + 2 * i] = v.to_bytes(2, "big")
        for i, v in enumerate((10, 20, 30)):
            b[0x2000 + 2 * i : 0x2002 + 2 * i] = v.to_bytes(2, "big")
        b[0x3000:0x3002] = b"\xff\xff"
        return bytes(b)

    rows = [("a", 7, image([100, 200, 300, 400, 500, 600])), ("b", 7, image([100, 208, 300, 400, 520, 600])), ("s", 7, b"\0" * 16)]
    cells = definitions.read_cells(spark.createDataFrame(rows, "image_id string, os_id long, content binary"), axes).cache()
    own = {(r.r, r.c): r for r in cells.filter("image_id = 'a' and table_id = '0x1'").collect()}
    assert [own[k].value for k in sorted(own)] == [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]
    assert own[(1, 2)].x_label == "300.0" and own[(1, 2)].y_label == "bank2"
    assert cells.filter("image_id = 'a' and table_id = '0x2' and c = 0").first().value == -0.1
    assert cells.filter("image_id = 's' and value is not null").count() == 0
    diff = definitions.cell_diff(cells, spark.createDataFrame([("a", "b")], "a string, b string")).cache()
    d = diff.filter("table_id = '0x1'").first()
    assert (d.cells, d.changed, d.max_delta, d.avg_delta) == (6, 2, 2.0, 1.4)
    assert (d.examples[0].x, d.examples[0]["from"], d.examples[0].to) == ("200.0", 20.0, 20.8)
    assert diff.filter("table_id = '0x2'").first().changed == 0
    assert definitions.top_changed_tables(diff).count() == 1
    one = spark.createDataFrame([(b"\x12\x34",)], "c binary")
    read = lambda low: one.select(definitions.raw_value(F.col("c"), F.lit(0), F.lit(16), F.lit(False), F.lit(low))).first()[0]
    assert (read(False), read(True)) == (0x1234, 0x3412)


def test_scanner_files(spark):
    texts = [
        ("a.Channels.xml", '<Channels><Channel ParameterID="12" Interval="00:00:00.1000000"/><Channel ParameterID="99" Interval="00:00:01"><UserParameter DeviceName="AEM"/></Channel></Channels>'),
        ("b.Charts.xml", "<Charts><Chart><Series><Label>RPM</Label><ParameterID>12</ParameterID><Unit>3</Unit></Series></Chart></Charts>"),
        ("c.Graphs.xml", "<Graphs><Table><Label>Engine RPM</Label><ParameterID>12</ParameterID><Unit>4</Unit></Table><Table><Label></Label><ParameterID>5</ParameterID></Table></Graphs>"),
        ("d.MathParameter.xml", '<MathParameter Name="m" Expression="[12.3] * [50030] / [12]"/>'),
        ("e.Layout.xml", '<DocumentContents><Content ID="1" Name="p"><Table><Label>MAP</Label><ParameterID>7</ParameterID></Table><Chart><Series><Label>TPS</Label><ParameterID>8</ParameterID></Series></Chart></Content></DocumentContents>'),
        ("f.txt", "nothing"),
    ]
    df = spark.createDataFrame(texts, "name string, text string")
    kinds = {r.name[0]: r.k for r in df.select("name", scanner.file_kind(F.col("name"), F.col("text")).alias("k")).collect()}
    assert kinds == {"a": "channels", "b": "charts", "c": "graphs", "d": "math", "e": "layout", "f": None}
    ch = scanner.read_channels(df)
    assert [r.interval_ms for r in ch.orderBy("ordinal").collect()] == [100, 1000]
    assert {(r.interval_ms, r.channels) for r in scanner.rate_summary(ch).collect()} == {(100, 1), (1000, 1)}
    book = scanner.build_dictionary(scanner.labelled_entries(df)).cache()
    rpm = book.filter("parameter_id = '12'").first()
    assert (rpm.label, rpm.unit_ids, rpm.sources) == ("Engine RPM", ["3", "4"], ["b.Charts.xml", "c.Graphs.xml"])
    assert {r.parameter_id for r in book.collect()} == {"12", "7", "8"}
    assert {r.parameter_id: r.known for r in scanner.decode_channels(ch, book).collect()} == {"12": True, "99": False}
    math = scanner.read_math(df)
    units_ = spark.createDataFrame([("3", "RPM")], "unit_id string, symbol string")
    d = scanner.decode_expression(math, book, units_).first()
    assert (d.decoded, d.unknown) == ("[Engine RPM] * [50030] / [Engine RPM]", ["50030"])
    counts = {r.name[0]: (r.charts, r.series, r.tables, r.panes) for r in scanner.config_counts(df).collect()}
    assert counts == {"b": (1, 1, 0, 0), "c": (0, 0, 2, 0), "e": (0, 1, 1, 1)}


def test_scanner_files_of_every_kind_in_one_scan(spark, tmp_path):
    texts = [
        ("a.charts.xml", "<Charts><Chart></Chart><Chart><Series><Label>RPM</Label><ParameterID>12</ParameterID></Series></Chart></Charts>"),
        ("b.layout.xml", '<DocumentContents><Content ID="1"/><Content ID="2"><Chart/><Series><Label>TPS</Label><ParameterID>8</ParameterID></Series></Content></DocumentContents>'),
        ("c.math.xml", '<MathParameter Name="m" Expression="[1]"/>'),
        ("d.charts.xml", "<Charts><Chart"),
        ("e.graphs.xml", None),
        ("f.txt", None),
        (None, "<Channels></Channels>"),
    ]
    spark.createDataFrame(texts, "name string, text string").write.parquet(str(tmp_path / "files"))
    scanned = scanner.read_scanner(spark.read.parquet(str(tmp_path / "files")))
    got = {r.name: r for r in scanned.collect()}
    assert {(k, r.kind, r.charts, r.series, r.tables, r.panes, len(r.channels)) for k, r in got.items()} == {
        ("a.charts.xml", "charts", 2, 1, 0, 0, 0), ("b.layout.xml", "layout", 0, 1, 0, 2, 0), ("c.math.xml", "math", 0, 0, 0, 0, 0),
        ("d.charts.xml", "charts", 0, 0, 0, 0, 0), ("e.graphs.xml", "graphs", 0, 0, 0, 0, 0), (None, "channels", 0, 0, 0, 0, 0),
    }
    assert {(r.source, r.parameter_id) for r in scanner.entries_of(scanned).collect()} == {("a.charts.xml", "12"), ("b.layout.xml", "8")}
    assert [r.expression for r in scanner.math_of(scanned).collect()] == ["[1]"]
    assert scanned._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_records(spark, tmp_path):
    (tmp_path / "flash.md").write_text("| date | revision |\n|---|---|\n| 2026-03-09 | v001 | OBDLink | — |\n| 2026-03-10 | v002 | OBDLink | idle |\n")
    flashes = files.read_flash_log(spark, str(tmp_path / "flash.md")).select(F.lit("car").alias("vehicle"), "date", "rev", "adapter", "notes").cache()
    assert [r.rev for r in flashes.orderBy("date").collect()] == ["v001", "v002"]
    names = [("stock", "stock_2026-03-01_read.bin"), ("tune", "v001_2026-03-09_a.bin"), ("tune", "v001_2026-03-09_a.hpt"), ("tune", "v003_2026-03-11_b.bin"), ("datalog", "2026-03-09_v001_x.csv"), ("datalog", "2026-03-06_v000_y.csv"), ("session", "2026-03-09_s.md")]
    f = spark.createDataFrame([("car", k, n) for k, n in names], "vehicle string, kind string, name string")
    goals = spark.createDataFrame([("car", "2026-03-09_s.md", "smooth idle")], "vehicle string, name string, goal string")
    events = history.timeline(f, flashes, goals).orderBy("seq").collect()
    assert [e.type for e in events] == ["revision", "flash", "revision", "datalog", "session", "flash", "datalog", "baseline"]
    assert events[2].detail == "v001_2026-03-09_a.bin, v001_2026-03-09_a.hpt" and events[4].detail == "smooth idle" and events[5].detail == "OBDLink" and events[1].detail == "OBDLink · idle"
    named = history.parse_names(f)
    revs, lg = named.filter("kind = 'tune'"), named.filter("kind = 'datalog'")
    assert [r.rev for r in history.revisions_never_flashed(revs, flashes).collect()] == ["v003"]
    assert [r.rev for r in history.revisions_without_logs(revs, lg).collect()] == ["v003"]
    assert [r.rev for r in history.orphan_log_revs(revs, lg).collect()] == ["v000"]
    assert history.next_revision(revs).first().next == "v004"
    text = spark.createDataFrame([("- Current tune revision: v002\n- Last flashed: — (stock)\n", "# s\n**Goal for this session:** \n**Tune revision flashed:** v002\n")], "p string, s string")
    row = text.select(files.current_state(F.col("p")).alias("c"), files.session_goal(F.col("s")).alias("g")).first()
    assert (row.c.current_revision, row.c.last_flashed, row.g) == ("v002", "", "v002")
    (tmp_path / "m.json").write_text(json.dumps({"parameters": [{"id": "a", "expression": "ltft + stft"}, {"id": "b", "expression": "x"}]}))
    assert files.read_formulas(spark, str(tmp_path / "m.json")).count() == 2


def test_registry_names_match():
    from dynofleet.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 50


def test_report(spark, tmp_path):
    from dynofleet.operators import report

    s = spark.createDataFrame([("a", "rpm", 1.0), ("a", "rpm", 2.0), ("b", "rpm", None)], "log_id string, channel string, value double")
    summary = report.channel_summary(s)
    assert summary.filter("log_id = 'a'").first().mean == 1.5
    report.write_readings({"summary": summary.withColumn("log_date", F.lit("2026-01-01"))}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/summary").count() == 2
    one = report.side_by_side(s, {"x": summary.filter("log_id = 'a'").select("log_id", "mean")})
    assert {r.log_id: r.mean for r in one.collect()} == {"a": 1.5, "b": None}
    assert one.filter("log_id = 'a'").select(report.as_markdown(F.col("log_id"), {"mean": F.col("mean"), "none": F.lit(None).cast("string")})).first()[0] == "## a\n- mean: 1.5"


def test_scanner_files_made_from_one_small_table_are_parsed_by_many_tasks(spark):
    from dynofleet.plans import records

    for name in ("read_scanner_xml", "config_counts", "scanner_files"):
        assert records.QUERIES[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() > 1, name


def test_orders_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    from dynofleet.plans import records

    d = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, records.QUERIES["timeline_counts"](spark, d).collect()))
    few = rows()
    monkeypatch.setattr(records, "ORDERS_A_TASK", 100)
    assert rows() == few and sum(r[2] for r in few) == spark.read.parquet(f"{d}/orders.parquet").count()
    # A vehicle's orders meet in one task, and no task gets many times the average.
    at = records._revisions(spark, d).groupBy("vehicle", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).cache()
    assert at.count() == at.select("vehicle").distinct().count()
    assert at.groupBy("task").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] < 350
    # Distinct revisions are found where the orders stand: nothing is dealt out a second time, packed tighter.
    plan = records.QUERIES["timeline_counts"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


@pytest.mark.parametrize("name", ["convert_units", "convert_delta", "preferred_unit", "format_value"])
def test_unit_queries_equal_their_sql(spark, name):
    import duckdb

    from dynofleet.plans import records

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    got = sorted(map(tuple, records.QUERIES[name](spark, d).collect()))
    assert got == sorted(con.execute(records.SQL[name]).fetchall()) and got


def test_no_name_of_a_module_of_plans_is_defined_twice():
    import ast
    from pathlib import Path

    from dynofleet import plans

    for file in Path(plans.__path__[0]).glob("*.py"):
        body = ast.parse(file.read_text()).body
        names = [n.name for n in body if isinstance(n, ast.FunctionDef) and n.name != "_"]
        names += [t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)]
        assert len(names) == len(set(names)), file
