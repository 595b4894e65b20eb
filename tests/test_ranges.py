"""Windows over ranges of rows, medians and grids equal their plain forms; one giant log spreads over tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dynofleet.operators import align, knock, mixture, ranges, trims
from dynofleet.operators.medians import upper_medians


def rows_of(seed: int, logs: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for log in range(logs):
        n = 0
        for _ in range(rng.choice([1, 2, 7, 60, 300])):
            n += rng.choice([1, 1, 1, 2, 25])  # numbers may be missing, whole ranges too
            out.append((log, n, None if rng.random() < 0.1 else float(rng.randrange(5)), rng.random() < 0.6))
    return out


@pytest.mark.parametrize("rows", [1, 3, 10, 1000])
def test_lag_lead_and_counts_over_ranges(spark, rows):
    df = spark.createDataFrame(rows_of(rows), "log_id int, row_no long, v double, hit boolean")
    w = Window.partitionBy("log_id").orderBy("row_no")
    plain = df.select("log_id", "row_no", F.lag("v").over(w).alias("a"), F.lag("row_no").over(w).alias("b"), F.lead("v").over(w).alias("c"), F.sum(F.col("hit").cast("int")).over(w).alias("d"), F.row_number().over(w).alias("e"))
    out = ranges.lagged(df, ["v"], rows=rows).select("log_id", "row_no", "hit", "v", F.col("near_.v").alias("a"), F.col("near_.row_no").alias("b"))
    out = ranges.led(out, ["v"], rows=rows).withColumn("c", F.col("near_.v")).drop("near_", "range_")
    out = ranges.numbered(ranges.running_count(out, F.col("hit"), "d", rows=rows), "e", order="row_no", rows=rows)
    pick = ["log_id", "row_no", "a", "b", "c", "d", "e"]
    assert sorted(map(str, out.select(pick).collect())) == sorted(map(str, plain.select(*pick[:5], F.col("d").cast("long"), F.col("e").cast("long")).collect()))


def test_upper_medians_against_sorting(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 0.0, -1.0, 1e-9, 0.1, 0.1 + 1e-12 * rng.randrange(50), rng.random() * 10 ** rng.randrange(-3, 9)])) for k in range(30) for _ in range(rng.randrange(1, 200))]
    rows += [(99, 0.25)] * 3000 + [(100, 5.0), (101, None), (101, -2.0)]
    got = {r.k: r.median for r in upper_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    want = {}
    for k, v in rows:
        if v is not None and v > 0:
            want.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in want.items()}


def test_a_log_with_half_of_all_rows_spreads(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 500)
    rows = [(0, i, float(i % 90), float(500 + i % 7), 20.0) for i in range(1, 6001)] + [(1 + i // 20, i % 20, 1.0, 900.0, 20.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "log_id int, row_no long, tps double, rpm double, map double").withColumns({c: F.lit(None).cast("double") for c in ("ltft", "stft", "ect", "iat", "spark")})
    df = df.withColumn("knock_retard", F.when(F.col("row_no") % 501 < 499, F.lit(1.0)).otherwise(0.0))
    w = Window.partitionBy("log_id").orderBy("row_no")
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    out = trims.sample_deltas(df).withColumns({"plain": F.abs(F.col("tps") - F.lag("tps").over(w))})
    assert out.filter(~F.col("d_tps").eqNullSafe(F.col("plain"))).count() == 0
    share = {r[0]: r[1] for r in trims.sample_deltas(df).filter("log_id = 0").groupBy(F.spark_partition_id()).count().collect()}
    assert len(share) >= 6 and max(share.values()) <= 2000, "the giant log is in many tasks"
    spark.conf.set("spark.sql.adaptive.enabled", True)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    events = {(r.log_id, r.start_row): r.samples for r in knock.knock_events(df).filter("log_id = 0").collect()}
    runs, start = {}, None
    for i in range(1, 6002):
        hit = i <= 6000 and i % 501 < 499
        if hit and start is None:
            start = i
        if not hit and start is not None:
            runs[(0, start)] = i - start
            start = None
    assert events == runs and max(runs.values()) > 490, "runs go on across ranges"


def test_many_restarts_in_one_log(spark, monkeypatch):
    """Time starts anew every third row and some stamps are corrupt: the stream over blocks equals a loop."""
    monkeypatch.setattr(ranges, "ROWS", 1000)
    n = 30_000
    rows = [(7, i, (i % 3) * 0.5 + (1e6 if i % 101 == 5 else 0.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "log_id int, row_no long, t double")
    gaps = sorted(b[2] - a[2] for a, b in zip(rows, rows[1:]) if b[2] > a[2])
    med = gaps[len(gaps) // 2]
    limit, last, offset, want, sessions, dropped, marks = max(60.0, med * 1000), None, 0.0, {}, 1, 0, []
    for _, i, t in rows:
        if last is not None and t - last > limit:
            dropped += 1
            continue
        if last is not None and t < last:
            offset = offset + last + med - t
            sessions += 1
            marks.append(t + offset)
        want[i], last = t + offset, t
    got = {r.row_no: r.t for r in align.normalize_time(df).collect()}
    assert got == pytest.approx(want, abs=0.0011)
    report = align.time_report(df).first()
    assert (report.sessions, report.dropped) == (sessions, dropped) and report.boundaries == pytest.approx(marks, abs=0.0011)


def test_numbers_and_words_are_held_together(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 4)
    schema = "log_id int, row_no long, t double, channel int, value_num double, value_str string"
    rows = [(1, i, i / 10, 1, float(i), None) for i in range(40)] + [(1, 0, 0.0, 2, None, "On"), (1, 20, 2.0, 2, 0.0, None), (1, 21, 2.1, 2, None, None)]
    out = align.resample_hold(spark.createDataFrame(rows, schema), values=("value_num", "value_str"))
    got = {(r.k, r.channel): (r.value_num, r.value_str) for r in out.collect()}
    assert all(got[k, 1] == (float(k), None) for k in range(40))
    assert all(got[k, 2] == (None, "On") for k in range(20)) and all(got[k, 2] == (0.0, None) for k in range(20, 40)), "held for three of its intervals"
    assert [r.k for r in align.grid_rows(spark.createDataFrame(rows, schema)).orderBy("k").collect()] == list(range(40))


def test_medians_of_the_first_values(spark):
    rng = random.Random(6)
    rows = [(k, i, None if rng.random() < 0.3 else rng.choice([14.7, 12.5, 1.0, 13.0]), None if rng.random() < 0.5 else rng.random()) for k in range(4) for i in range(900)]
    df = spark.createDataFrame(rows, "log_id int, row_no long, commanded_afr double, wideband_afr double").repartition(7)
    upper = lambda v: sorted(v)[len(v) // 2] if v else None
    for r in mixture.scale_samples(df).collect():
        own = [x for x in rows if x[0] == r.log_id]
        assert r.early_median == upper([x[2] for x in own[:400] if x[2] is not None])
        assert r.commanded_median == upper([x[2] for x in own if x[2] is not None][:400])
        assert r.wideband_median == upper([x[3] for x in own if x[3] is not None][:400])
