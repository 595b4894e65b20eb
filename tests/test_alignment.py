"""Time alignment against plain loops over random logs."""

import random
from collections import defaultdict

import pytest

from dynofleet.operators import align

SCHEMA = "log_id int, row_no long, t double, channel string, value double"


def random_logs(seed, logs=40):
    rng, rows = random.Random(seed), []
    for log in range(logs):
        t = 0.0
        for i in range(rng.choice([1, 2, 5, 40])):
            kind = rng.random()
            t = 0.0 if kind < 0.05 else t + (rng.choice([500, 90000]) if kind < 0.1 else rng.choice([0, 0.1, 0.2, 1]))
            stamp = None if kind > 0.97 else round(t + (1e6 if 0.9 < kind < 0.95 else 0), 3)
            rows.append((log, i, stamp, rng.choice("abc"), None if rng.random() < 0.1 else float(rng.randrange(9))))
    return rows


def upper(v):
    return sorted(v)[len(v) // 2]


def walk(rows):
    """The rule as a loop over one log: kept rows with new times, sessions, dropped."""
    rows = [r for r in rows if r[2] is not None]
    if len(rows) < 3:
        return [(r[1], r[2], r[3], r[4]) for r in rows], 1, 0
    gaps = [b[2] - a[2] for a, b in zip(rows, rows[1:]) if b[2] > a[2]]
    med = upper(gaps) if gaps else 0.1
    limit, out, offset, last, sessions, dropped = max(60, med * 1000), [], 0.0, None, 1, 0
    for _, i, t, c, v in rows:
        if last is not None:
            if t - last > limit:
                dropped += 1
                continue
            if t < last:
                offset += last + med - t
                sessions += 1
        out.append((i, t + offset, c, v))
        last = t
    return out, sessions, dropped


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_and_corrupt_stamps(spark, seed):
    rows = random_logs(seed)
    by_log = defaultdict(list)
    for r in rows:
        by_log[r[0]].append(r)
    df = spark.createDataFrame(rows, SCHEMA)
    got = defaultdict(dict)
    for r in align.normalize_time(df).collect():
        got[r.log_id][r.row_no] = r.t
    report = {r.log_id: r for r in align.time_report(df).collect()}
    for log, own in by_log.items():
        kept, sessions, dropped = walk(own)
        assert got[log] == pytest.approx({i: t for i, t, _, _ in kept}, abs=0.0011)
        assert (report[log].sessions, report[log].dropped) == (sessions, dropped)
        assert report[log].blank == sum(r[2] is None for r in own)


def test_grid_against_a_loop(spark):
    rng, rows = random.Random(4), []
    for log in range(25):
        t = 0
        for i in range(rng.randrange(1, 40)):
            t += rng.choice([0, 30, 100, 170, 2000, 9000])
            rows.append((log, i, t / 1000, rng.choice("ab"), float(i)))
    got = {(r.log_id, r.k, r.channel): (r.t, r.value) for r in align.resample_hold(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for log in range(25):
        own = [(round(t * 1000), c, v) for g, _, t, c, v in rows if g == log]
        t0, t1 = own[0][0], own[-1][0]
        n = (t1 - t0) // 100
        for c in "ab":
            mine = [(t, v) for t, k, v in own if k == c]
            gaps = [b[0] - a[0] for a, b in zip(mine, mine[1:]) if b[0] > a[0]]
            hold = max(1000, 3 * upper(gaps)) if gaps else 5000
            for k in range(n + 1):
                label = t1 if k == n else t0 + 100 * k
                seen = [(t, v) for t, v in mine if min((t - t0) // 100, n) <= k]
                if seen and label - seen[-1][0] <= hold + 1e-6:
                    want[(log, k, c)] = (label / 1000, seen[-1][1])
    assert got == want


def test_a_value_that_comes_once_expires(spark):
    rows = [(1, i, i * 0.1, "rpm", 900.0) for i in range(1001)] + [(1, 2000, 100.0, "rpm", 900.0), (1, 0, 0.0, "ect", 80.0)]
    out = align.resample_hold(spark.createDataFrame(rows, SCHEMA)).groupBy("channel").count().collect()
    count = {r.channel: r["count"] for r in out}
    assert 0 < count["ect"] < 100 and count["rpm"] > 900


def test_one_log_with_half_of_all_rows(spark):
    rows = [(0, i, i * 0.1, "a", 1.0) for i in range(3000)] + [(1 + i // 10, i % 10, (i % 10) * 0.1, "a", 1.0) for i in range(3000)]
    out = align.normalize_time(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 6000
