"""Log files in byte ranges equal whole files; redacted files are written one a log."""

import random

import pytest
from pyspark.sql import functions as F

from dynofleet.operators import report, scrub
from dynofleet.sources import logs, splits


def texts() -> dict[str, str]:
    rng = random.Random(1)
    head = "HP Tuners CSV Log File\r\nVersion: 1.0\r\n\r\n[Log Information]\r\nNotes: hot day\r\n\r\n[Channel Information]\r\n0,12,6\r\nOffset,Engine RPM,Fuel (a,b)\r\ns,rpm,%\r\n\r\n[Channel Data]\r\n"
    rows = [f"{i / 10:.1f},{rng.choice(['', '900', 'x'])},{rng.choice(['', '-5'])}" for i in range(700)]
    return {
        "a/sectioned.csv": head + "\r\n".join(rows) + "\r\n[End]\r\n0.9,1,2",
        "a/plain.csv": "Time,RPM,ECT\ns,rpm,C\n" + "\n".join(f"{i},{i * 3},warm" for i in range(300)) + "\n",
        "b/bare.csv": "\nTime,RPM\n1,2\n\n3,4",
        "b/late.csv": "\n" * 50 + "[Channel Data]\n1,2\n3,4\n",
        "b/marked.csv": "x\n" * 20 + "[Channel Information]\nOffset,RPM\n[Channel Data]\n\n1,2\n",
        "b/one.csv": "Time,RPM",
        "b/long.csv": "Time,Name\n" + "1," + "é" * 5000 + "\n2,b\n",
        "_hidden/no.csv": "Time,RPM\n1,2\n",
    }


@pytest.fixture()
def folder(tmp_path):
    for name, text in texts().items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text.encode())
    return tmp_path


@pytest.mark.parametrize("part", [7, 64, 1000, 1 << 20])
def test_ranges_of_lines_equal_whole_files(spark, folder, part):
    if part == 7:  # thousands of ranges: by the reader itself
        reader = splits.LineReader({"path": str(folder / "in"), "part_bytes": "7"})
        got, counts = {}, {}
        for p in reader.partitions():
            for b in reader.read(p):
                for r in b.to_pylist():
                    got.setdefault(r["log_id"], {}).setdefault(r["part"], []).append(r["line"] + r["ending"])
        reader.mode = "count"
        for p in reader.partitions():
            for b in reader.read(p):
                for r in b.to_pylist():
                    counts[r["log_id"], r["part"]] = r["lines"]
        assert {k: "".join(x for p in sorted(v) for x in v[p]) for k, v in got.items()} == {f"file://{folder}/in/{k}": v for k, v in texts().items() if k[0] != "_"}
        assert all(counts[k, p] == len(got[k].get(p, [])) for k, p in counts)
        return
    got = {}
    for r in splits.read_lines(spark, str(folder / "in"), part).collect():
        got.setdefault(r.log_id, {})[r.line_no] = r.line
    want = {f"file://{folder}/in/{k}": dict(enumerate(v.replace("\r\n", "\n").split("\n"))) for k, v in texts().items() if k[0] != "_"}
    assert got == want


def test_parsed_ranges_equal_parsed_files(spark, folder):
    whole = [df.withColumn("log_id", F.regexp_replace("log_id", "^file:/*", "file:///")) for df in logs.parse_logs(logs.read_text_logs(spark, str(folder / "in" / "[ab]")))]
    parted = splits.read_logs(spark, str(folder / "in"), 500)
    for a, b in zip(whole, parted, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_a_big_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("Time,RPM\n" + "\n".join(f"{i},{i % 7}" for i in range(400_000)))
    lines = splits.read_lines(spark, f"file://{tmp_path}", 200_000)
    assert spark.read.format("log_lines").option("part_bytes", 200_000).load(f"file://{tmp_path}").rdd.getNumPartitions() == (tmp_path / "big.csv").stat().st_size // 200_000 + 1
    row = lines.agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.countDistinct("line_no").alias("all")).first()
    assert tuple(row) == (400_001, 400_000, 400_001)
    wrong = lines.filter("line_no > 0").filter(~F.col("line").startswith(F.concat((F.col("line_no") - 1).cast("string"), F.lit(",")))).count()
    assert wrong == 0


def test_redacted_files_are_the_same_elsewhere(spark, folder):
    (folder / "in" / "a" / "secret.csv").write_bytes(b"Time,RPM,GPS Latitude,ECT\r\n1,2,51.5,90\r\n2,1ZZTEST99Z1234567,51.6,91\nshort,line\r\n  Notes: seen by me\r\n")
    scrub.write_scrubbed(spark, str(folder / "in"), str(folder / "out"), 300)
    scrub.write_scrubbed(spark, str(folder / "in"), str(folder / "out"), 300)  # again: files are replaced
    want = {k: v.replace("Notes: hot day", "Notes:") for k, v in texts().items() if k[0] != "_"}
    want["a/secret.csv"] = "Time,RPM,ECT\r\n1,2,90\r\n2,<VIN>,91\nshort,line\r\n  Notes:\r\n"
    got = {str(p.relative_to(folder / "out")): p.read_bytes().decode() for p in (folder / "out").rglob("*") if p.is_file()}
    assert got == want


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, "x"), ("..", 0, "y")], "log_id string, line_no int, line string")
    with pytest.raises(Exception, match="no file name"):
        splits.write_logs(lines, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_readings_replace_only_their_partitions(spark, tmp_path):
    rows = lambda day, n: spark.createDataFrame([(day, i) for i in range(n)], "log_date string, v int")
    report.write_readings({"bins": rows("2026-01-01", 3).union(rows("2026-01-02", 2))}, str(tmp_path))
    report.write_readings({"bins": rows("2026-01-02", 5)}, str(tmp_path))
    got = {str(r.log_date): r["count"] for r in spark.read.parquet(f"{tmp_path}/bins").groupBy("log_date").count().collect()}
    assert got == {"2026-01-01": 3, "2026-01-02": 5}


def test_a_second_inventory_reads_only_what_changed(spark, tmp_path):
    import hashlib
    import os

    from dynofleet.sources import files

    for k in range(6):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]) * 100)
    first = files.file_inventory(spark, str(tmp_path)).collect()
    assert [r.name for r in first] == [f"{k}.bin" for k in range(5, -1, -1)] and first[-1].sha256 == hashlib.sha256(bytes(100)).hexdigest()
    known = spark.createDataFrame(first)
    stamp = os.stat(tmp_path / "1.bin")
    (tmp_path / "1.bin").write_bytes(b"z" * 100)  # same size and time: not looked at
    os.utime(tmp_path / "1.bin", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (tmp_path / "2.bin").write_bytes(b"new")
    (tmp_path / "7.bin").write_bytes(b"7")
    (tmp_path / "3.bin").unlink()
    second = {r.name: r.sha256 for r in files.file_inventory(spark, str(tmp_path), known).collect()}
    old = {r.name: r.sha256 for r in first}
    assert second == {k: v for k, v in old.items() if k not in ("2.bin", "3.bin")} | {"2.bin": hashlib.sha256(b"new").hexdigest(), "7.bin": hashlib.sha256(b"7").hexdigest()}


def test_tasks_list_folders_and_write_files_so_the_driver_holds_no_names(spark, tmp_path):
    from dynofleet.sources import files

    rows = spark.range(300).select(F.expr("concat(id div 50, '/', id % 3, '/', id, ' a%20.txt')").alias("name"), F.col("id").cast("string").alias("content"))
    splits.write_files(rows, str(tmp_path / "out"))
    (tmp_path / "out" / "_hidden").mkdir()
    (tmp_path / "out" / "_hidden" / "x").write_text("x")
    listed = files.listed_files(spark, str(tmp_path / "out"))
    assert len(listed.inputFiles()) < 100  # tables with the names, not the files
    want = {f"file:{p}": (p.stat().st_size, p.stat().st_mtime_ns // 1_000_000) for p in (tmp_path / "out").rglob("*.txt")}
    got = {r.path: (r.size, r.ms) for r in listed.selectExpr("path", "size", "unix_millis(modified) ms").collect()}
    assert got == want and len(want) == 300
    assert files.hashed_files(listed).filter("sha256 is null").isEmpty()
    assert not list((tmp_path / "out").glob("_staged*"))
    with pytest.raises(ValueError, match="two logs"):
        splits.write_files(rows.limit(2).withColumn("name", F.lit("a.txt")), str(tmp_path / "twice"))
    assert not [p for p in (tmp_path / "twice").rglob("*") if p.is_file()]


def test_redaction_shuffles_no_line_and_heads_hold_what_the_parser_needs(spark, folder, monkeypatch):
    plans, write = [], splits._write
    monkeypatch.setattr(splits, "_write", lambda files, *a: (plans.append(files._jdf.queryExecution().executedPlan().toString()), write(files, *a)))
    scrub.write_scrubbed(spark, str(folder / "in"), str(folder / "out"), 300)
    assert len(plans) == 1 and "Exchange" not in plans[0].split("MapInArrow")[0] and "Sort" not in plans[0].split("MapInArrow")[0]
    heads = {}
    for r in splits.read_heads(spark, str(folder / "in")).collect():
        heads.setdefault(r.log_id.removeprefix(f"file://{folder}/in/"), []).append((r.line_no, r.line))
    assert heads["a/plain.csv"] == [(0, "Time,RPM,ECT"), (1, "s,rpm,C")] and heads["b/bare.csv"] == [(1, "Time,RPM"), (2, "1,2")]
    assert [x for _, x in sorted(heads["b/marked.csv"])[-3:]] == ["Offset,RPM", "[Channel Data]", "1,2"]


def test_texts_are_redacted_in_portions_of_which_nothing_stays(spark, tmp_path, monkeypatch):
    import hashlib
    from pathlib import Path

    from dynofleet.plans import stored

    rows = [(i * 7, f"a,{i}\n" * (i % 50)) for i in range(300)] + [(-5, "first\r\n"), (9000, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    place, scrubbed, seen = Path(stored.shared_folder(spark).removeprefix("file://")), scrub.write_scrubbed, []
    files_there = lambda: {p for p in place.rglob("*.csv")}
    monkeypatch.setattr(scrub, "write_scrubbed", lambda *a: (scrubbed(*a), seen.append(len(files_there() - before))))
    got = {}
    for portion in (stored.PORTION, 4096 * 120):
        monkeypatch.setattr(stored, "PORTION", portion)
        before = files_there()
        seen.clear()
        found = stored.QUERIES["write_scrubbed"](spark, str(tmp_path)).collect()
        got[len(seen)] = sorted(map(tuple, found))
        assert sum(seen) == 2 * 302 and max(seen) <= 2 * (302 // len(seen) + 2)  # one portion's files at a time, in both folders
        assert files_there() == before
    whole = {i: f"Time,RPM\n{i},900\nNotes:\n" + t.replace(",", ";") for i, t in rows if t is not None}
    want = sorted((f"{i}.csv", len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in whole.items())
    assert got == {1: want, 4: want}
    for n, of in ((1, 1), (5, 5), (302, 8)):  # portions hold every row once, and none is empty
        logs = spark.createDataFrame([(i * 3 - 7, f"{i}", "x" * 5000) for i in range(n)], "doc_id long, name string, content string").coalesce(1)
        monkeypatch.setattr(stored, "PORTION", 1)
        some = [[r.doc_id for r in p.collect()] for p in stored.portions(logs)]
        assert len(some) == of and sorted(sum(some, [])) == [i * 3 - 7 for i in range(n)]
        assert n < 300 or all(p.select(F.spark_partition_id()).distinct().count() > 1 for p in stored.portions(logs))  # though one task reads them
    assert stored.QUERIES["write_scrubbed"](spark, f"{tmp_path}/none").collect() == []


def test_a_failed_redaction_leaves_nothing(spark, tmp_path):
    from pathlib import Path

    from dynofleet.plans import stored

    place = Path(stored.shared_folder(spark).removeprefix("file://"))
    before = set(place.rglob("*.csv"))
    spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(ValueError, match="two logs"):
        stored.QUERIES["write_scrubbed"](spark, str(tmp_path))
    assert set(place.rglob("*.csv")) == before
